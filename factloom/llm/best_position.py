"""Ranked lexical search over impact lists by the Best Position Algorithm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored
from factloom.llm.jaccard import word_hashes
from factloom.llm.terms import plain_runs

TOP = 10
#: Different (item, term) pairs whose items are searched in one run over the documents, as expected by hash.
RUN_TERMS = 200_000
#: Postings of the documents whose impact lists are held at once.
BLOCK_POSTINGS = 1_000_000
#: Entries of each list that are read first; each further step reads twice as many.
FIRST_STEP = 32
#: Stands for a missing id in comparisons, which puts it last.
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Query:
    """An item: places of its terms in the vocabulary, and their weights times repeats."""

    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray


@dataclass(frozen=True)
class Collection:
    """What the scores need to know about all documents."""

    n_docs: int
    n_terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def impacts(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What one occurrence of a term in an item adds for each unit of its weight, by whole divisions."""
        if 75 * int(lengths.max(initial=0)) * self.n_docs >= 1 << 63:
            m = np.array([25 + 75 * int(n) * self.n_docs // self.n_terms for n in lengths], np.int64)
        else:
            m = 25 + 75 * lengths * self.n_docs // self.n_terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Block:
    """Postings of some documents, by document and as impact lists.

    Document d owns the postings ``first[d]`` to ``first[d + 1]``, each with owner, term, impact and
    its place in the term's list. The list of term t is ``head[t]`` to ``head[t + 1]`` of ``listed``,
    which names postings by falling impact.
    """

    first: np.ndarray
    owner: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    place: np.ndarray
    head: np.ndarray
    listed: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> Block:
        listed = np.lexsort((-impact, term))
        head = np.searchsorted(term[listed], np.arange(n_terms + 1))
        place = np.empty(len(term), np.int64)
        place[listed] = np.arange(len(term)) - head[term[listed]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return cls(np.concatenate([[0], np.cumsum(sizes)]), owner, term, impact, place, head, listed)

    def postings_of(self, docs: np.ndarray) -> np.ndarray:
        """All postings of the documents, one document after the other."""
        sizes = self.first[docs + 1] - self.first[docs]
        before = np.cumsum(sizes) - sizes
        return np.repeat(self.first[docs] - before, sizes) + np.arange(sizes.sum())


@dataclass
class Best:
    """The highest scores of one query so far; of equal ones those with the smallest ids."""

    top: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hopeful = (scores > 0) & (scores >= self.least)
        scores, ids = np.concatenate([self.scores, scores[hopeful]]), np.concatenate([self.ids, ids[hopeful]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def least(self) -> int:
        """A score below this can't be among the best any more; one that equals it can."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1


def search(block: Block, query: Query, ids: np.ndarray, slots: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with the documents of a block; returns how many were looked up.

    The lists of the query's terms are read in steps. A document met there is looked up in all
    lists at once through its own postings, which gives its whole score and its positions. The best
    position of a list ends its unbroken run of seen positions, whether they were seen by reading
    or by looking up; no unseen document has a higher impact there than the entry behind it. Once
    the weighted sum of those impacts is strictly below the last of the best scores, no unseen
    document can enter, not even by an equal score and a smaller id.
    """
    heads, ends = block.head[query.terms], block.head[query.terms + 1]
    live = (query.weights > 0) & (ends > heads)
    terms, weights, heads = query.terms[live], query.weights[live], heads[live]
    sizes = ends[live] - heads
    slots[terms] = np.arange(len(terms))
    before = np.cumsum(sizes) - sizes
    seen_place, seen_doc = np.zeros(sizes.sum(), bool), np.zeros(len(ids), bool)
    unseen = np.zeros(len(terms), np.int64)
    depth, step, looked = 0, FIRST_STEP, 0
    while True:
        open_lists = np.flatnonzero(unseen < sizes)
        bound = int((weights[open_lists] * block.impact[block.listed[heads[open_lists] + unseen[open_lists]]]).sum())
        if bound < best.least:
            break
        read = [block.listed[heads[s] + depth : heads[s] + min(depth + step, sizes[s])] for s in open_lists]
        docs = np.unique(block.owner[np.concatenate(read)])
        docs = docs[~seen_doc[docs]]
        seen_doc[docs] = True
        looked += len(docs)
        postings = block.postings_of(docs)
        slot = slots[block.term[postings]]
        postings, slot = postings[slot >= 0], slot[slot >= 0]
        scores = np.zeros(len(ids), np.int64)
        np.add.at(scores, block.owner[postings], weights[slot] * block.impact[postings])
        best.add(scores[docs], ids[docs])
        seen_place[before[slot] + block.place[postings]] = True
        for s in open_lists:
            own = seen_place[before[s] + unseen[s] : before[s] + sizes[s]]
            gap = int(own.argmin())
            unseen[s] += gap if not own[gap] else len(own)
        depth, step = depth + step, 2 * step
    slots[terms] = -1
    return looked


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms, repeats) per row with a term: hashes of its different terms, and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in plain_runs(batch.column(1)):
                words, bounds = word_hashes(texts, lower=False)
                own = [np.unique(words[a:b].view(np.int64), return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + len(texts)],
                        pa.array([t for t, _ in own], pa.list_(pa.int64())), pa.array([n for _, n in own], pa.list_(pa.int64())),
                    ],
                    names=["item_id", "terms", "repeats"],
                )
                at += len(texts)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, terms array<long>, repeats array<long>").where(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) per row with a term: its number of terms, and those that the vocabulary holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in plain_runs(batch.column(1)):
                words, bounds = word_hashes(texts, lower=False)
                words = words.view(np.int64)
                place = np.searchsorted(vocabulary, words)
                place[place == len(vocabulary)] = 0
                known = np.flatnonzero(vocabulary[place] == words) if len(vocabulary) else np.empty(0, np.int64)
                doc = np.searchsorted(bounds, known, side="right") - 1
                pairs, tf = np.unique(doc * max(len(vocabulary), 1) + place[known], return_counts=True)
                doc, term = np.divmod(pairs, max(len(vocabulary), 1))
                offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + len(texts)], pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that hold about BLOCK_POSTINGS postings."""
    held, size = [], 0
    for batch in batches:
        for a in range(0, len(batch), 1000):
            part = batch.slice(a, 1000)
            held.append(part)
            size += len(part.column(2).flatten())
            if size >= BLOCK_POSTINGS:
                yield held
                held, size = [], 0
    if held:
        yield held


def best_of_tasks(rows: DataFrame, queries: list[Query], n_vocabulary: int, collection: Collection, top: int) -> DataFrame:
    """(query, item_id, doc_id, score): the best documents of each task, whose blocks share what they have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        slots = np.full(max(n_vocabulary, 1), -1)
        for held in blocks(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["doc_id"].fill_null(NO_ID).to_numpy()
            terms = pa.concat_arrays([c for c in table["terms"].chunks])
            sizes = terms.value_lengths().to_numpy()
            tf = pa.concat_arrays(table["tfs"].chunks).flatten().to_numpy()
            impact = collection.impacts(tf, np.repeat(table["n"].to_numpy(), sizes))
            block = Block.of(sizes, terms.flatten().to_numpy(), impact, n_vocabulary)
            for query, own in zip(queries, best, strict=True):
                search(block, query, ids, slots, own)
        for number, (query, own) in enumerate(zip(queries, best, strict=True)):
            found = pa.array(own.ids, mask=own.ids == NO_ID)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(found), pa.int32()), pa.array([query.item_id] * len(found), pa.int64()), found, pa.array(own.scores)],
                names=["query", "item_id", "doc_id", "score"],
            )

    return rows.mapInArrow(run, "query int, item_id long, doc_id long, score long")


def weighted_queries(items: list, vocabulary: np.ndarray, df: dict[int, int], collection: Collection) -> list[Query]:
    out = []
    for item in items:
        terms = np.searchsorted(vocabulary, np.array(item["terms"], np.int64))
        weights = np.array([collection.weight(df.get(int(t), 0)) for t in terms], np.int64)
        out.append(Query(item["item_id"], terms, weights * np.array(item["repeats"], np.int64)))
    return out


def search_run(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """The best documents of the items of one run, whose terms fit into every task."""
    found = items.collect()
    vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in found]))
    rows = stored(postings(docs, vocabulary), "postings")
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most the vocabulary
    collection = Collection(totals["docs"], totals["terms"] or 0)
    queries = weighted_queries(found, vocabulary, {r["term"]: r["count"] for r in counts}, collection)
    each = best_of_tasks(rows, queries, len(vocabulary), collection, top)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Rank all documents for each item, and return the ``top`` of them with a score above 0.

    Documents are dealt by rows: a scan leaves the number of terms of each text and its counts of
    the items' terms; those rows give the statistics and are then searched where they lie, in blocks
    of bounded size, each an index of its own: impact lists by term, and postings by document for
    direct access. What a task has found in its earlier blocks lets it stop earlier in later ones. A
    task sends at most ``top`` rows an item, and a window per item takes the best of these. Items
    are taken in runs whose terms are bounded by RUN_TERMS; each run reads all documents.

    Returns item_id, rank (from 1), doc_id and score, equal scores by doc_id. Every row is a document
    of its own, so a repeated row takes a rank of its own; one without an id comes last among equal
    scores. A null or empty text has no term and counts nowhere. A repeated item is answered
    repeatedly, one without terms not at all, one without an id like any other. Without documents or
    without items there are no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    listed = stored(item_terms(items), "item-terms")
    size = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    runs = -(-size // RUN_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(runs):
        own = listed.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(runs)) == number)
        if not own.isEmpty():
            out = out.unionByName(search_run(docs, own, top))
    return out
