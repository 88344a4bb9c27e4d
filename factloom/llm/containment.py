"""Benchmark decontamination: a prefix-filtered set join of item windows with document windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored
from factloom.llm.jaccard import list_array, window_hashes, word_hashes
from factloom.llm.terms import plain_runs

#: Words of a window of an item.
WINDOW_WORDS = 10
#: Words of the shingles by which windows are found; shorter windows are one shingle.
SHINGLE_WORDS = 3
#: Bits of a membership filter: sixteen for each shingle, and at most so many as a power of two (16 MB).
MOST_FILTER_BITS = 27


def item_windows(items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, window, n, longest, shingles): the different windows of each item.

    ``window`` is its words joined by blanks, ``longest`` the bytes of its longest word, and shingle
    i begins at its word i.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in plain_runs(batch.column(1)):
                words, bounds = word_hashes(texts, lower=False)
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own, n = texts[k].split(), min(int(b - a), window_words)
                    size = min(n, SHINGLE_WORDS)
                    grams = window_hashes(words[a:b], size) if n else words[:0]
                    windows = {b" ".join(own[i : i + n]): i for i in range(len(own) - n + 1)} if n else {}
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column(0)[at + k].as_py()] * len(windows), pa.int64()),
                            pa.array([w.decode("utf-8", "surrogatepass") for w in windows], pa.string()),
                            pa.array([n] * len(windows), pa.int32()),
                            pa.array([max(map(len, own[i : i + n])) for i in windows.values()], pa.int32()),
                            list_array([grams[i : i + n - size + 1] for i in windows.values()]),
                        ],
                        names=["item_id", "window", "n", "longest", "shingles"],
                    )
                at += len(texts)

    schema = "item_id long, window string, n int, longest int, shingles array<long>"
    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, schema)


def membership(tokens: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test that passes every hash in ``column``, and of others the few that share their low bits.

    The bits are put together by Spark and have a fixed upper size, so they can go to every task
    however many tokens there are; callers join what passes with the tokens themselves.
    """
    count = tokens.select(column).distinct().count()
    low = (1 << min(MOST_FILTER_BITS, max(12, (16 * count).bit_length()))) - 1
    place = F.col(column).bitwiseAND(F.lit(low))
    rows = tokens.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({column} & 63 AS int)))").alias("bits")
    ).toPandas()  # at most low / 64 rows
    bits = np.zeros((low + 1) // 64, np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)

    def passes(hashes: np.ndarray) -> np.ndarray:
        return (bits[(hashes & np.uint64(low)) >> np.uint64(6)] >> (hashes & np.uint64(63))) & np.uint64(1) == 1

    return passes


def shingles_inside(words: np.ndarray, bounds: np.ndarray, size: int, passes: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and hash of the shingles of ``size`` words that pass and lie inside one text."""
    hashes = window_hashes(words, size)
    at = np.flatnonzero(passes(hashes))
    text = np.searchsorted(bounds, at, side="right") - 1
    inside = at + size <= bounds[text + 1]
    return text[inside], at[inside], hashes[at[inside]]


def shingle_counts(docs: DataFrame, sizes: list[int], passes: Callable) -> DataFrame:
    """(shingle, n): how often the documents hold each shingle that passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in plain_runs(batch.column(0)):
                words, bounds = word_hashes(texts, lower=False)
                found = np.concatenate([shingles_inside(words, bounds, s, passes)[2] for s in sizes])
                hashes, counts = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

    counted = docs.select("text").mapInArrow(run, "shingle long, n long")
    return counted.groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest_shingles(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, offset, window, n) of the prefix of every window.

    Its shingles are ordered by rarity in the documents. A document window that contains all n of
    them contains each of the first n - n + 1, so a prefix of one, the rarest, is necessary.
    """
    placed = windows.select("window", "n", F.posexplode("shingles").alias("offset", "shingle"))
    ranked = placed.join(counts.withColumnRenamed("n", "found"), "shingle", "left").withColumn(
        "rarity", F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("found", F.lit(0)), "shingle", "offset"))
    )
    return ranked.where("rarity = 1").select(F.col("shingle").alias("token"), "offset", "window", "n")


def prefix_places(docs: DataFrame, sizes: list[int], passes: Callable, reach: int, longest: int) -> DataFrame:
    """(doc_id, n_words, places) per row: where prefix tokens stand, with the words around them.

    A token of a full shingle brings ``reach`` words on both sides, from word ``low`` on; a shorter
    shingle is a whole window and brings itself. Words longer than any of an item are left empty.
    """
    place = pa.struct([("at", pa.int32()), ("token", pa.int64()), ("low", pa.int32()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in plain_runs(batch.column(1)):
                words, bounds = word_hashes(texts, lower=False)
                places: list[list[dict]] = [[] for _ in texts]
                split: dict[int, list[bytes]] = {}
                for size in sizes:
                    for k, at, token in zip(*shingles_inside(words, bounds, size, passes), strict=True):
                        if k not in split:
                            split[k] = [w if len(w) <= longest else b"" for w in texts[k].split()]
                        i = int(at - bounds[k])
                        low, high = (max(0, i - reach), i + reach + 1) if size == SHINGLE_WORDS else (i, i + size)
                        around = b" ".join(split[k][low:high]).decode("utf-8", "surrogatepass")
                        places[k].append({"at": i, "token": int(token.view(np.int64)), "low": low, "around": around})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[done : done + len(texts)], pa.array(np.diff(bounds), pa.int64()), pa.array(places, pa.list_(place))],
                    names=["doc_id", "n_words", "places"],
                )
                done += len(texts)

    schema = "doc_id long, n_words long, places array<struct<at:int,token:long,low:int,around:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def covered_words(spans):
    """Words inside any of the spans, which are sorted by start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(done, span):
        fresh = span["end"] - F.greatest(span["start"], done["end"])
        return F.struct((done["n"] + F.greatest(fresh, F.lit(0))).alias("n"), F.greatest(span["end"], done["end"]).alias("end"))

    return F.aggregate(spans, start, step, lambda done: done["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """Find the windows of benchmark items in documents: a set join with a prefix filter.

    A window is ``window_words`` consecutive words of an item (a shorter item is one window), taken
    as the set of its shingles with their places. One scan of the documents counts the shingles of
    the items; the rarest of each window is its prefix. A second scan keeps the places of prefix
    tokens with the words around them. Joined by token, a place gives the one start the window can
    have; bounds drop those that would begin before or end after the document, and the rest is
    compared word by word. Copies of a window and of an item are compared once.

    Returns one row per row of ``docs``: doc_id, n_words, n_hit (words inside any window found),
    spans (start, end in words) and items (ids as sorted strings). A null or empty text has no words
    and no hit; repeated rows are judged alike, rows without an id too; items without words match
    nothing, an item without an id marks words but is not listed; rows of one item_id are one item;
    an empty table of documents gives no rows, one of items no hits; other columns are ignored.
    """
    windows = stored(item_windows(items, window_words), "item-windows")
    listed = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    different = windows.groupBy("window", "n").agg(F.first("shingles").alias("shingles"), F.max("longest").alias("longest"), listed.alias("items"))
    different = stored(different.withColumn("owners", F.xxhash64(F.array_join("items", ","))), "different-windows")
    sizes = sorted(r.size for r in different.select(F.least("n", F.lit(SHINGLE_WORDS)).alias("size")).distinct().collect())  # at most SHINGLE_WORDS
    longest = different.agg(F.max("longest")).first()[0] or 0
    shingles = different.select(F.explode("shingles").alias("shingle")).distinct()
    if sizes:
        passes = membership(shingles, "shingle")
        counts = shingle_counts(docs, sizes, passes).join(shingles, "shingle")
    else:
        def passes(hashes: np.ndarray) -> np.ndarray:
            return np.zeros(len(hashes), bool)

        counts = shingles.withColumn("n", F.lit(0))
    prefixes = rarest_shingles(different, counts).join(different.select("window", "owners"), "window")
    prefixes = stored(prefixes, "prefixes")
    if sizes:
        passes = membership(prefixes, "token")
    rows = prefix_places(docs, sizes, passes, window_words - 1, longest).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "prefix-places")

    placed = rows.where(F.size("places") > 0).select("row", "n_words", F.inline("places"))
    start = F.col("at") - F.col("offset")
    candidates = placed.join(prefixes, "token").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("around", " "), start - F.col("low") + 1, F.col("n")), " ") == F.col("window")
    found = candidates.where(same).groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct(start.alias("start"), (start + F.col("n")).alias("end")))).alias("spans"),
        F.collect_set("owners").alias("owners"),
    )
    found = stored(found, "found-windows")
    names = different.groupBy("owners").agg(F.first("items").alias("items"))
    named = found.select("row", F.explode("owners").alias("owners")).join(names, "owners").groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = rows.select("row", "doc_id", "n_words").join(found.select("row", "spans"), "row", "left").join(named, "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return joined.select(
        "doc_id", "n_words", covered_words(spans).alias("n_hit"), spans.alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
