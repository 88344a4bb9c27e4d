"""State between cycles as Structured Streaming, each with a batch form of equal results."""

from __future__ import annotations

import heapq
import pickle
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.operators import delta, ledger

# Layers of the score state machine and its limits.
LAYERS = ["conservative_scan", "exploratory_probe", "greedy_exploit", "balanced_adaptive", "fallback_cascade"]
HISTORY, PATIENCE, EPSILON = 15, 15, 0.005
BOOST_LAYER = 1
SCORE_STATE = (
    "history array<double>, stall int, layer int, entries array<int>, totals array<double>, steps long"
)
SCORE_OUTPUT = (
    "key long, step long, score double, velocity double, acceleration double, stall_cycles int, anomaly boolean, "
    "signal string, state string"
)


class ScoreMachine:
    """One key's state: bounded score history, stall counter, current layer, averages per layer."""

    def __init__(
        self, state: tuple | None = None, patience: int = PATIENCE, epsilon: float = EPSILON, confidence: float = 0.3,
        exploration: float = 0.1, bias: float = 1.0,
    ):
        history, self.stall, self.layer, entries, totals, self.steps = state or ([], 0, 0, [0] * 5, [0.0] * 5, 0)
        self.history: deque[float] = deque(history, maxlen=HISTORY)
        self.entries, self.totals = list(entries), list(totals)
        self.patience, self.epsilon = patience, epsilon
        self.confidence, self.exploration, self.bias = confidence, exploration, bias

    def as_state(self) -> tuple:
        return (list(self.history), self.stall, self.layer, self.entries, self.totals, self.steps)

    def _signal(self, score: float, anomaly: bool) -> str:
        last = len(LAYERS) - 1
        if anomaly:
            return "boost_mutation_sigma"
        if score < self.confidence:
            return "restart" if self.layer >= last else "escalate"
        scaled = score * self.bias
        if scaled > 1.0 - self.exploration:
            return "hold"
        if scaled < self.exploration:
            return "escalate"
        average = self.totals[self.layer] / max(self.entries[self.layer], 1)
        return "demote" if average > score else "hold"

    def _move(self, signal: str, score: float) -> None:
        last = len(LAYERS) - 1
        target = {
            "escalate": min(self.layer + 1, last), "demote": max(self.layer - 1, 0),
            "restart": 0 if self.layer == last else self.layer, "boost_mutation_sigma": BOOST_LAYER,
        }
        self.layer = target.get(signal, self.layer)
        self.entries[self.layer] += 1
        self.totals[self.layer] += score

    def push(self, score: float) -> tuple:
        value = score if score is not None and score == score and abs(score) != float("inf") else 0.0
        self.history.append(value)
        recent = list(self.history)[-3:]
        velocity = recent[-1] - recent[-2] if len(recent) >= 2 else 0.0
        acceleration = velocity - (recent[-2] - recent[-3]) if len(recent) == 3 else 0.0
        flat = len(recent) == 3 and abs(velocity) < self.epsilon and abs(acceleration) < self.epsilon
        self.stall = self.stall + 1 if flat else 0
        stalled, anomaly = self.stall, self.stall >= self.patience
        signal = self._signal(value, anomaly)
        if anomaly:  # acknowledged once, so one plateau gives one boost
            self.stall = 0
        self._move(signal, value)
        self.steps += 1
        return self.steps, value, velocity, acceleration, stalled, anomaly, signal, LAYERS[self.layer]


_OUTPUT_NAMES = [c.strip().split()[0] for c in SCORE_OUTPUT.split(",")]


def score_states_batch(scores: DataFrame, order: Sequence[str], **limits: float) -> DataFrame:
    """Transitions per key of (key, score) rows in ``order``.

    The machine is a recurrence without a shortcut, so a key is folded in order. Its rows arrive
    as an iterator of batches and leave as one, so a task holds one batch and not a key's history.
    """
    def fold(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, current = None, None
        for page in pages:
            rows = []
            for key, score in zip(page["key"], page["score"], strict=True):
                if machine is None or key != current:
                    machine, current = ScoreMachine(**limits), key
                rows.append((key, *machine.push(score)))
            yield pd.DataFrame(rows, columns=_OUTPUT_NAMES)

    # Sorted within partitions by (key, order): mapInPandas then sees each key as one run.
    return (
        scores.repartition("key").sortWithinPartitions("key", *order).select("key", "score").mapInPandas(fold, SCORE_OUTPUT)
    )


#: Rows of a chunk of a sorted page, of an append to list state, and of a page that leaves a processor.
CHUNK_ROWS, APPEND_ROWS, PAGE_ROWS = 200, 1000, 5000


class _SortedPages:
    """A key's rows of one micro-batch in order, although they come in any order and page by page.

    One page is sorted in memory. Of several, each is sorted and kept in map state in small chunks,
    and the pages are merged chunk by chunk, so that memory holds a chunk of each and never the
    key's rows. The state is empty again when the rows are through.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, order: Sequence[str], columns: Sequence[str]) -> None:
        self.held = handle.getMapState(name, "page int, chunk int", "rows binary")
        self.order, self.columns = list(order), list(columns)

    def _tuples(self, page: pd.DataFrame) -> list[tuple]:
        """(order values, columns) of the sorted page."""
        page = page.sort_values(self.order, kind="stable")
        return list(zip(page[self.order].itertuples(index=False, name=None), page[self.columns].itertuples(index=False, name=None), strict=True))

    def _read(self, page: int, chunks: int) -> Iterator[tuple]:
        for chunk in range(chunks):
            yield from pickle.loads(self.held.getValue((page, chunk))[0])

    def merged(self, pages: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        first = next(pages, None)
        second = next(pages, None)
        if first is None:
            return
        if second is None:
            yield from (row for _, row in self._tuples(first))
            return
        sizes = []
        for number, page in enumerate(_chain(first, second, pages)):
            rows = self._tuples(page)
            for chunk, low in enumerate(range(0, len(rows), CHUNK_ROWS)):
                self.held.updateValue((number, chunk), (pickle.dumps(rows[low : low + CHUNK_ROWS]),))
            sizes.append(-(-len(rows) // CHUNK_ROWS))
        runs = [self._read(number, chunks) for number, chunks in enumerate(sizes)]
        yield from (row for _, row in heapq.merge(*runs, key=lambda r: r[0]))
        self.held.clear()


def _chain(first: pd.DataFrame, second: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield first
    yield second
    yield from rest


def _paged(rows: Iterator[tuple], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    page: list[tuple] = []
    for row in rows:
        page.append(row)
        if len(page) == PAGE_ROWS:
            yield pd.DataFrame(page, columns=columns)
            page = []
    if page:
        yield pd.DataFrame(page, columns=columns)


class _ScoreProcessor(StatefulProcessor):
    def __init__(self, order: Sequence[str], limits: dict):
        self.order, self.limits = list(order), limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("score", SCORE_STATE)
        self.pages = _SortedPages(handle, "scores", self.order, ["score"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = ScoreMachine(self.state.get() if self.state.exists() else None, **self.limits)
        steps = ((key[0], *machine.push(score)) for (score,) in self.pages.merged(rows))
        yield from _paged(steps, _OUTPUT_NAMES)
        self.state.update(machine.as_state())

    def close(self) -> None:
        pass


def score_states_stream(scores: DataFrame, order: Sequence[str], **limits: float) -> DataFrame:
    """Streaming form over micro-batches that arrive in order; needs the RocksDB state store."""
    return scores.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_ScoreProcessor(order, limits), outputStructType=SCORE_OUTPUT, outputMode="append", timeMode="None"
    )


class _FeedProcessor(StatefulProcessor):
    """Diagnostics per file in list state, emitted and cleared by a drain row.

    Messages are appended to the state in runs and read from it when they are drained, so neither a
    micro-batch nor what is pending is ever in memory as a whole.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "position long, message string")
        self.pages = _SortedPages(handle, "feed", ["position"], ["position", "message", "drain"])

    def _drained(self, file: int, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        fresh: list[tuple] = []
        for position, message, drain in self.pages.merged(rows):
            if drain:
                if self.pending.exists():
                    yield from ((file, int(position), *item) for item in self.pending.get())
                    self.pending.clear()
                yield from ((file, int(position), *item) for item in fresh)
                fresh = []
                continue
            fresh.append((int(position), message))
            if len(fresh) == APPEND_ROWS:
                self.pending.appendList(fresh)
                fresh = []
        if fresh:
            self.pending.appendList(fresh)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _paged(self._drained(key[0], rows), ["file", "drained_at", "position", "message"])

    def close(self) -> None:
        pass


FEED_OUTPUT = "file long, drained_at long, position long, message string"


def feed_stream(rows: DataFrame) -> DataFrame:
    """(file, position, message, drain) rows to drained diagnostics."""
    return rows.groupBy("file").transformWithStateInPandas(
        statefulProcessor=_FeedProcessor(), outputStructType=FEED_OUTPUT, outputMode="append", timeMode="None"
    )


def feed_batch(rows: DataFrame) -> DataFrame:
    """Batch form: every message belongs to the first drain of its file after it.

    The next drain is a running minimum from behind, computed in buckets of the position.
    """
    from factloom.operators import ordered

    cut = rows.withColumn("_back", -F.col("position"))
    drain = F.when(F.col("drain"), F.col("position"))
    near = ordered.running(cut, ["file"], ["_back"], drain, F.min, F.least, "drained_at")
    return near.where("NOT drain AND drained_at IS NOT NULL").select("file", "drained_at", "position", "message")


def changed_only_stream(
    files: DataFrame, cache_root: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], key: str = "key",
    version: str | None = None, compact_every: int = 10,
):
    """Process only what changed: each micro-batch of (key, fingerprint, ...) rows meets the cache.

    Of a key's rows in one batch the highest counts, by the column ``version`` and then by all others.
    Results are versions under ``cache_root``, one per batch, so a restarted batch rewrites its
    own version and readers never see a half-written one. Every ``compact_every`` batches the latest
    rows are written as one compact state, and a batch reads that and the versions since.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        recompute_changed(batch, batch_id, cache_root, compute, key, version, compact_every)

    return files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def recompute_changed(
    batch: DataFrame, batch_id: int, cache_root: str, compute: Callable[[DataFrame], DataFrame], key: str = "key",
    version: str | None = None, compact_every: int = 10,
) -> None:
    """One batch of :func:`changed_only_stream`; running it again gives the same version."""
    spark = batch.sparkSession
    cached = read_versions(spark, cache_root, batch_id, key)
    order = F.struct(*([version] if version else []), *[c for c in batch.columns if c != version])
    latest = batch.groupBy(key).agg(F.max(F.struct(order.alias("o"))).alias("m")).select("m.o.*").select(*batch.columns)
    fresh = latest if cached is None else latest.join(delta.stale_keys(cached, latest), key, "left_semi")
    compute(fresh).withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{cache_root}/batch={batch_id}")
    if (batch_id + 1) % compact_every == 0:
        whole = _latest(spark, cache_root, batch_id + 1, key)
        whole.write.mode("overwrite").parquet(f"{cache_root}/{COMPACT}/upto={batch_id}")
        _forget(spark, cache_root, batch_id - compact_every)


#: Folder of the compact states; its leading underscore keeps it out of a scan of the versions.
COMPACT = "_compact"


def _numbered(spark: SparkSession, folder: str, prefix: str, finished: bool = False) -> list[int]:
    """Numbers of the subfolders ``prefix=n``; of finished writes only, if asked for."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    found = [n for n in names if n.startswith(f"{prefix}=") and (not finished or system.exists(jvm.Path(f"{folder}/{n}/_SUCCESS")))]
    return sorted(int(n.split("=")[1]) for n in found)


def _latest(spark: SparkSession, root: str, before: int | None, key: str) -> DataFrame | None:
    """Latest row per key with the ``batch`` it is from: the last compact state and the versions after it."""
    states = [n for n in _numbered(spark, f"{root}/{COMPACT}", "upto", finished=True) if before is None or n < before]
    start = states[-1] if states else -1
    versions = [n for n in _numbered(spark, root, "batch") if n > start and (before is None or n < before)]
    parts = [spark.read.parquet(f"{root}/{COMPACT}/upto={start}")] if states else []
    if versions:
        fresh = spark.read.option("basePath", root).parquet(*[f"{root}/batch={n}" for n in versions])
        parts.append(fresh.withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        return None
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    payload = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*payload), "batch").alias("v")).select(key, "v.*")


def _forget(spark: SparkSession, root: str, upto: int) -> None:
    """Drop what the compact state before the last one already holds; that one stays for a batch that is run again."""
    jvm = spark._jvm.org.apache.hadoop.fs
    old = [f"{root}/batch={n}" for n in _numbered(spark, root, "batch") if n <= upto]
    old += [f"{root}/{COMPACT}/upto={n}" for n in _numbered(spark, f"{root}/{COMPACT}", "upto") if n < upto]
    for path in map(jvm.Path, old):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_versions(spark: SparkSession, root: str, before: int | None = None, key: str = "key") -> DataFrame | None:
    """Latest cached row per key over the versions written so far (before a batch)."""
    latest = _latest(spark, root, before, key)
    return None if latest is None else latest.drop("batch")


def bounded_ledger_stream(trajectories: DataFrame, root: str, checkpoint: str, order: Sequence[str], capacity: int = ledger.MAX_SIZE):
    """Best ``capacity`` rows under appends: each batch writes the next ledger version.

    The ledger holds ``capacity`` rows, so a version is small however long the stream runs.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        previous = f"{root}/version={batch_id - 1}"
        rows = batch
        if batch_id > 0:
            rows = batch.unionByName(batch.sparkSession.read.parquet(previous))
        kept = ledger.record(rows.limit(0), rows, order, capacity)
        kept.write.mode("overwrite").parquet(f"{root}/version={batch_id}")

    return trajectories.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True)
