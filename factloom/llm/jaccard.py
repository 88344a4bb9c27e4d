"""Exact n-gram Jaccard join: blocked products of the document by n-gram incidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, stored, text_of
from factloom.llm.components import components, local_components, tree_edges

N_GRAM = 5
PERCENT = 80
#: Texts are hashed in runs of about so many bytes, which bounds the memory of a task.
RUN_BYTES = 1_000_000
#: A block of the product has at most about so many documents and n-grams a side.
BLOCK_DOCS = 4096
BLOCK_GRAMS = 2_000_000
#: Part of a document's grams that two linked prefixes share, first of short ones and then of longer ones.
SHORT, LONG = 40, 4
#: Times that documents without enough shared grams in short prefixes are dropped.
PASSES = 2
#: Documents of a column that is added pair by pair.
FEW = 32
#: Columns of the incidence matrix that are multiplied at once.
STRIP = 2048

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
_PRIME_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread one-to-one map of 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin and end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    values = _BYTE[data] * _powers(_PRIME, len(data) - 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    hashes = mixed((total[ends] - total[starts]) * _powers(_PRIME_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    count = len(words) - n + 1
    out = np.full(count, np.uint64(n))
    for k in range(n):
        shift = np.uint64((k + 1) * int(_GOLD) % (1 << 64))
        out = out * _PRIME + mixed(words[k : k + count] + shift)
    return mixed(out)


def gram_sets(texts: list[bytes], n: int = N_GRAM) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes per text; a shorter text is one gram, one without words has none."""
    words, bounds = word_hashes(texts, lower=True)
    grams = window_hashes(words, n)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = grams[a : b - n + 1] if b - a >= n else window_hashes(words[a:b], b - a) if b > a else grams[:0]
        sets.append(np.unique(own))
    return sets


def byte_runs(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column as bytes, in runs of bounded size; null is empty."""
    run, size = [], 0
    for low in range(0, len(texts), 256):
        for t in texts[low : low + 256].to_pylist():
            encoded = (t or "").encode("utf-8", "surrogatepass")
            if run and size + len(encoded) > RUN_BYTES:
                yield run
                run, size = [], 0
            run.append(encoded)
            size += len(encoded)
    if run:
        yield run


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts as compressed bytes, which halves what a shuffle of whole texts moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = 0
            for texts in byte_runs(batch.column(1)):
                ids = batch.column(0)[at : at + len(texts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(pack, texts), pa.binary())], names=["doc_id", "packed"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, packed binary"
    )


def unpacked_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a batch whose second column is packed, with the row each run starts at."""
    unpack = zstandard.ZstdDecompressor()
    run, size, start = [], 0, 0
    for i, value in enumerate(batch.column(1)):
        text = unpack.decompress(value.as_py())
        if run and size + len(text) > RUN_BYTES:
            yield start, run
            run, size, start = [], 0, i
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def shared_floor(n: Column | int, part: int):
    """Least number of prefix grams that two linked documents share, for the smaller one's size."""
    return max(1, n // part) if isinstance(n, int) else F.greatest(F.lit(1), F.floor(n / part))


def required(n: int, percent: int) -> int:
    """Least overlap of a document of n grams with any that it links to: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def gram_profiles(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, prefix) per row.

    The keys name the set of grams. The prefix holds its lowest hashes in order: of two linked sets
    x and y, at most |x| - percent * |x| / 100 grams of x are missing in y, so with so many and k
    more, the prefixes of both hold their k lowest common grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in byte_runs(batch.column(1)):
                sets = gram_sets(texts)
                sizes = [len(s) for s in sets]
                keys = [
                    pa.array([int(mixed(s * m + m).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64())
                    for m in (_GOLD, _PRIME)
                ]
                prefix = [s[: n - required(n, percent) + shared_floor(n, LONG)] for s, n in zip(sets, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + len(texts)], pa.array(sizes, pa.int64()), *keys, list_array(prefix)],
                    names=["doc_id", "n_shingles", "key1", "key2", "prefix"],
                )
                at += len(texts)

    schema = "doc_id long, n_shingles long, key1 long, key2 long, prefix array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def candidate_blocks(profiles: DataFrame, percent: int) -> DataFrame:
    """(leader, doc_id): blocks of different gram sets, such that linked ones meet in a block.

    Linked sets share grams of their prefixes, and a block is led by the smallest document of such
    a gram. Before that, documents go that share fewer grams of a short prefix with anything than any
    link needs: nearly all. What is left, mostly for a common passage, is asked for its long prefix,
    of which a link shares far more than a passage does. A document also leaves the blocks that hold
    the fewest of its grams: if two linked ones share k, each may give up less than half of k.
    """
    held = profiles.where("n_shingles > 0")
    firsts = held.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    firsts = stored(firsts.where("doc_id IS NOT NULL").select("doc_id", "n_shingles"), "gram-sets")
    least = F.ceil(F.col("n_shingles") * percent / 100)
    short = (F.col("n_shingles") - least + shared_floor(F.col("n_shingles"), SHORT)).cast("int")
    grams = held.select("doc_id", F.explode(F.slice("prefix", F.lit(1), short)).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    shared = stored(shared, "shared-grams")
    rows = stored(grams.join(shared, "gram"), "shared-rows")
    floor = shared_floor(least, SHORT)
    alive = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(firsts, "doc_id").where(F.col("n") >= floor)
    # Copies made grams look shared; among different sets fewer are, and each pass drops documents that gave grams to others.
    for _ in range(PASSES):
        alive = stored(alive.select("doc_id"), "near-sets")
        rows = stored(rows.select("gram", "doc_id").join(alive, "doc_id").distinct(), "near-rows")
        common = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        common = stored(common.select("gram"), "common-grams")
        near, rows = rows, stored(rows.join(common, "gram"), "common-rows")
        discard(near)
        alive = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(firsts, "doc_id").where(F.col("n") >= floor)
    # A doc_id of several sets is judged by the smallest, and by the grams of all.
    alive = stored(alive.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles")), "near-sets")
    rows = stored(held.join(alive.select("doc_id"), "doc_id").select("doc_id", F.explode("prefix").alias("gram")), "long-rows")
    led = rows.groupBy("gram").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last")
    led = stored(led.select("gram", "leader"), "leaders")
    shares = rows.join(led, "gram").groupBy("doc_id", "leader").agg(F.count(F.lit(1)).alias("n"))
    shares = stored(shares, "shares")
    discard(rows)
    needed = shared_floor(least, LONG)
    by_doc = Window.partitionBy("doc_id")
    fewest = by_doc.orderBy("n", "leader").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shares.withColumns({"all": F.sum("n").over(by_doc), "given": F.sum("n").over(fewest)}).join(alive, "doc_id")
    return placed.where((F.col("all") >= needed) & (F.col("given") > F.floor((needed - 1) / 2))).select("leader", "doc_id")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common grams of every two documents of a block: incidence matrix times its transpose.

    Columns of few documents add their pairs one by one; fuller ones are multiplied in dense strips.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    sparse = (held[column] > 1) & (held[column] <= FEW)
    light, at = owner[sparse], column[sparse]
    for d in range(1, FEW):
        k = np.flatnonzero(at[:-d] == at[d:])
        if not len(k):
            break
        np.add.at(total, (light[k], light[k + d]), np.float32(1))
    total += total.T  # each pair was added once
    heavy = held > FEW
    number = np.cumsum(heavy) - 1
    keep = heavy[column]
    owner, column = owner[keep], number[column[keep]]
    n_columns = int(heavy.sum())
    for low in range(0, n_columns, STRIP):
        a, b = np.searchsorted(column, [low, low + STRIP])
        strip = np.zeros((len(sets), min(STRIP, n_columns - low)), np.float32)
        strip[owner[a:b], column[a:b] - low] = 1
        total += strip @ strip.T
    return total


def block_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which two documents of a block are linked; compared a few rows at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    common = _overlaps(sets)
    linked = np.zeros(common.shape, bool)
    for low in range(0, len(sets), 256):
        own, shared = sizes[low : low + 256, None], common[low : low + 256].astype(np.int64)
        fits = 100 * np.minimum(own, sizes[None, :]) >= percent * np.maximum(own, sizes[None, :])
        linked[low : low + 256] = fits & (100 * shared >= percent * (own + sizes[None, :] - shared))
    np.fill_diagonal(linked, False)
    return linked


def jaccard_edges(docs: DataFrame, members: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): enough links between different gram sets to connect all that are connected.

    ``members`` has the blocks of :func:`candidate_blocks` and ``sizes`` (doc_id, n_shingles) of their
    documents. Blocks are cut by size class (linked sizes are in one class or in neighbouring ones)
    and then into parts of bounded size; each pair of parts is one product. Texts travel to their
    blocks compressed, which is less than their grams. Only a tree over each group that the product
    connects leaves a block, so no group's pairs are ever rows.
    """
    ratio = float(np.log(100 / percent)) if percent < 100 else 1e-9
    sized = members.join(sizes.withColumnRenamed("n_shingles", "n"), "doc_id").withColumn(
        "class", F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).cast("int")
    )
    whole = sized.groupBy("leader").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("grams") <= BLOCK_GRAMS)
    whole = stored(whole.where("docs > 1").select("leader", small.alias("small")), "blocks")
    sized = stored(
        sized.join(whole, "leader").withColumn("class", F.when(F.col("small"), F.lit(-1)).otherwise(F.col("class"))), "sized"
    )
    parts = sized.groupBy("leader", "class").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / (BLOCK_DOCS // 2)), F.ceil(F.sum("n") / (BLOCK_GRAMS // 2)), F.lit(1)
        ).cast("int").alias("parts")
    )
    parts = parts.withColumn("parts", F.when(F.col("class") < 0, F.lit(1)).otherwise(F.col("parts")))
    above = parts.select("leader", (F.col("class") - 1).alias("class"), F.col("parts").alias("above"))
    below = parts.select("leader", (F.col("class") + 1).alias("class"), F.col("parts").alias("below"))
    grid = stored(parts.join(above, ["leader", "class"], "left").join(below, ["leader", "class"], "left"), "grid")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")

    def cell(low: Column, high: Column, i: Column, j: Column) -> Column:
        return F.struct(low.alias("class"), high.alias("other"), i.alias("i"), j.alias("j"))

    def pairs(count: Column, of) -> Column:
        none = F.array().cast("array<struct<class:int,other:int,i:int,j:int>>")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), of)).otherwise(none)

    own = F.col("class")
    same = pairs(F.col("parts"), lambda k: cell(own, own, F.least(k, F.col("part")), F.greatest(k, F.col("part"))))
    up = pairs(F.coalesce("above", F.lit(0)), lambda k: cell(own, own + 1, F.col("part"), k))
    down = pairs(F.coalesce("below", F.lit(0)), lambda k: cell(own - 1, own, k, F.col("part")))
    cells = sized.join(grid, ["leader", "class"]).withColumn("part", part).select(
        "doc_id", "leader", F.explode(F.concat(same, up, down)).alias("cell")
    )
    cells = stored(cells.select("doc_id", "leader", "cell.*"), "cells")
    blocks = cells.join(packed_texts(docs.where("doc_id IS NOT NULL")), "doc_id")

    def multiply(block: pa.Table) -> pa.Table:
        ids = block.column("doc_id").to_numpy()
        unpack = zstandard.ZstdDecompressor().decompress
        sets: list[np.ndarray] = []
        for low in range(0, len(ids), 100):
            sets += gram_sets([unpack(t.as_py()) for t in block.column("packed")[low : low + 100]])
        label = local_components(linked := block_links(sets, percent))
        trees = [tree_edges(np.unique(ids[label == k])) for k in np.unique(label[linked.any(axis=1)])]
        a, b = (np.concatenate([t[side] for t in trees]) if trees else np.empty(0, np.int64) for side in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("leader", "class", "other", "i", "j").applyInArrow(multiply, "a long, b long")


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Documents link when the Jaccard similarity of their sets of five-word shingles (A-Z in lower
    case) is at least ``percent`` hundredths; no link between different texts is lost, as the
    candidates come from exact bounds. Equal sets form one class, so copies are never paired. A null
    text, or one without words, has no shingles and links with nothing. A row without doc_id gets no
    component and links nothing. Repeated rows get equal results; an empty table gives no rows;
    other columns are ignored.
    """
    profiles = stored(gram_profiles(docs, percent), "grams")
    rows = stored(profiles.select("doc_id", "n_shingles", "key1", "key2"), "gram-keys")
    members = stored(candidate_blocks(profiles, percent), "members")
    discard(profiles)
    sizes = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    found = components(jaccard_edges(docs, members, sizes, percent))
    classes = rows.where("n_shingles > 0").groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("first"))
    named = stored(
        classes.join(found.withColumnRenamed("node", "first"), "first", "left").select(
            "key1", "key2", "n_shingles", F.coalesce("component", "first").alias("component")
        ),
        "classes",
    )
    joined = rows.join(named, ["key1", "key2", "n_shingles"], "left")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id.

    Rows with one doc_id and one text are the same document and stay once. A doc_id that stands for
    different texts is no name for them: each of its texts is a document of its own, which links as
    any other and comes before the others of its group. Rows without doc_id stay; a null or empty
    text links with nothing; an empty table gives no rows; other columns, whatever their names, stay
    as they are.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("content"))
    several = keyed.where("id IS NOT NULL").select("id", "content").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("texts"))
    several = stored(several.where("texts > 1").select("id", F.lit(True).alias("several")), "several-texts")
    own = F.xxhash64("id", "content").bitwiseOR(F.lit(-(1 << 63)))
    rows = keyed.join(several, "id", "left").select("doc", F.when(F.col("several"), own).otherwise(F.col("id")).alias("node"))
    groups = jaccard_groups(rows.select(F.col("node").alias("doc_id"), F.col("doc.text").alias("text")), percent)
    kept = stored(groups.where("doc_id = component_id").select(F.col("doc_id").alias("node")).distinct(), "kept")
    named = rows.join(kept, "node", "left_semi").dropDuplicates(["node"])
    return named.unionByName(rows.where("node IS NULL")).select("doc.*")
