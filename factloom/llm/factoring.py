"""Substring deduplication: documents factored against everything that comes before them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored, text_of
from factloom.llm.jaccard import byte_runs, list_array, mixed, packed_texts, unpacked_runs, window_hashes, word_hashes

#: Words of the shortest factor that counts as a duplicate.
LEAST_WORDS = 20
#: Words of the anchors by which the reference is indexed.
ANCHOR_WORDS = 6


def anchors_of_windows(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` grams, where its lowest gram is; of equal ones the first."""
    if len(grams) < span:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, span)
    out = [windows[i : i + 100_000].argmin(axis=1) + np.arange(i, min(i + 100_000, len(windows))) for i in range(0, len(windows), 100_000)]
    return np.concatenate(out)


def anchor_profiles(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, key1, key2, anchors, starts) per row.

    Every window of ``least`` words is represented by its lowest gram of ANCHOR_WORDS words, so equal
    windows have equal anchors at equal places, and a seventh or so of all grams is indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in byte_runs(batch.column(1)):
                words, bounds = word_hashes(texts, lower=False)
                keys: tuple[list[int], list[int]] = ([], [])
                anchors, starts = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = words[a:b]
                    place = np.arange(1, len(own) + 1, dtype=np.uint64)
                    for key, odd in zip(keys, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), strict=True):
                        key.append(int(mixed(own + place * np.uint64(odd)).sum(dtype=np.uint64).view(np.int64)))
                    grams = window_hashes(own, ANCHOR_WORDS)
                    chosen = np.unique(anchors_of_windows(grams, least - ANCHOR_WORDS + 1))
                    anchors.append(grams[chosen])
                    starts.append(chosen.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + len(texts)], pa.array(np.diff(bounds), pa.int64()),
                        pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()),
                        list_array(anchors), list_array(starts).cast(pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_words", "key1", "key2", "anchors", "starts"],
                )
                at += len(texts)

    schema = "doc_id long, n_words long, key1 long, key2 long, anchors array<long>, starts array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def _candidates(words: np.ndarray, live: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose anchor is found elsewhere too, and the windows' hashes."""
    place = anchors_of_windows(window_hashes(words, ANCHOR_WORDS), least - ANCHOR_WORDS + 1)
    starts = np.flatnonzero(np.isin(place, live))
    return starts, window_hashes(words, least)[starts] if len(starts) else np.empty(0, np.uint64)


def reference_windows(packed: DataFrame, live: DataFrame, least: int) -> DataFrame:
    """(window, doc_id, start) of all windows that may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column(0).to_numpy(), batch.column(2)
            for at, texts in unpacked_runs(batch):
                words, bounds = word_hashes(texts, lower=False)
                hashes, starts, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own, found = _candidates(words[a:b], places[at + k].values.to_numpy(), least)
                    starts.append(own)
                    hashes.append(found)
                    owners.append(np.full(len(own), ids[at + k]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(owners)),
                        pa.array(np.concatenate(starts).astype(np.int32)),
                    ],
                    names=["window", "doc_id", "start"],
                )

    joined = packed.join(live, "doc_id").select("doc_id", "packed", "live")
    return joined.mapInArrow(run, "window long, doc_id long, start int")


def factor_spans(repeated: np.ndarray, least: int) -> np.ndarray:
    """Maximal runs of words that windows starting at ``repeated`` cover, as (start, end) rows.

    The parse is greedy: a factor goes on while the next window is found in the reference, and also
    across the border to another factor when the windows over that border are found.
    """
    if not len(repeated):
        return np.empty((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(repeated) > least)
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(repeated) - 1]])
    return np.column_stack([repeated[first], repeated[last] + least])


def duplicate_spans(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (start, end in words), kept_text.

    A span is a stretch of words covered by windows of ``least`` words that also start earlier: in a
    smaller doc_id, or before in the same document. The reference is everything earlier, indexed by
    anchors in hashed blocks over the cluster; each document is parsed into factors of at least
    ``least`` words found there. Documents with the same words are one entry of the index; all but
    the first are covered whole. ``kept_text`` holds the other words, joined by single blanks.

    A null text has no words. A row without doc_id is left whole and is no reference. Rows with one
    doc_id are one document and should hold one text; they get equal results. An empty table gives
    no rows; other columns are ignored.
    """
    profiles = stored(anchor_profiles(docs, least), "anchors").where("doc_id IS NOT NULL")
    long = profiles.where(F.col("n_words") >= least)
    classes = long.groupBy("key1", "key2", "n_words").agg(F.min("doc_id").alias("first"))
    classes = stored(classes, "word-sequences")
    rows = long.select("doc_id", F.explode(F.arrays_zip("anchors", "starts")).alias("x")).select(
        "doc_id", F.col("x.anchors").alias("anchor"), F.col("x.starts").alias("start")
    )
    shared = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = stored(shared, "shared-anchors")
    alive = rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("start").alias("live"))
    alive = stored(alive.join(classes.select(F.col("first").alias("doc_id")), "doc_id"), "live-anchors")
    packed = packed_texts(docs.where("doc_id IS NOT NULL"))
    windows = reference_windows(packed, alive, least)
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("x"))
    firsts = firsts.groupBy("x.doc_id").agg(F.collect_list("x.start").alias("firsts"))
    again = long.select("doc_id", "key1", "key2", "n_words").distinct().join(classes, ["key1", "key2", "n_words"])
    again = again.where("doc_id <> first").select("doc_id").distinct()
    marks = alive.join(firsts, "doc_id", "left").select("doc_id", "live", "firsts").unionByName(
        again.select("doc_id", F.lit(None).cast("array<int>").alias("live"), F.lit(None).cast("array<int>").alias("firsts"))
    )
    marks = stored(marks.withColumn("marked", F.lit(True)), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live, firsts, marked = (batch.column(i) for i in (2, 3, 4))
            for at, texts in unpacked_runs(batch):
                words, bounds = word_hashes(texts, lower=False)
                counts, removed, spans, kept = [], [], [], []
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    row, n = at + k, int(b - a)
                    found = np.empty((0, 2), np.int64)
                    if marked[row].as_py() and live[row].is_valid:
                        starts, _ = _candidates(words[a:b], live[row].values.to_numpy(), least)
                        known = firsts[row].values.to_numpy() if firsts[row].is_valid else np.empty(0, np.int32)
                        found = factor_spans(starts[~np.isin(starts, known)], least)
                    elif marked[row].as_py():
                        found = np.array([[0, n]])
                    own = texts[k].split()
                    for start, end in found[::-1]:
                        del own[start:end]
                    counts.append(n)
                    removed.append(n - len(own))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in found])
                    kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + len(texts)], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
                )

    joined = packed_texts(docs).join(marks, "doc_id", "left").select("doc_id", "packed", "live", "firsts", "marked")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
    return joined.mapInArrow(run, schema)
