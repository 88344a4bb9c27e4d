"""Mixing sources to target weights by proportionate-fair scheduling of blocks of documents."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stored

#: Documents of one source that are scheduled together.
BLOCK_DOCS = 100
#: The periodic form (:func:`phases`) takes weights in whole parts of so many; :func:`mix` does not use it.
PERIOD = 1000
#: Documents that are numbered together.
BUCKET = 1000
#: Scheduled blocks that leave the scheduler together.
BATCH = 50_000


def whole_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Weights as whole parts of PERIOD, one at least, by largest remainders."""
    total = sum(weights.values())
    exact = {s: w / total * (PERIOD - len(weights)) for s, w in weights.items()}
    parts = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: PERIOD - sum(parts.values())]:
        parts[s] += 1
    return parts


def period_slots(parts: Mapping[str | None, int]) -> dict[str | None, list[int]]:
    """Slots of each source's blocks in one period.

    Block k of a source with w parts is released at slot floor(k * PERIOD / w) and is due before
    ceil((k + 1) * PERIOD / w); each slot goes to the released block with the earliest deadline.
    So a source is never a whole block ahead of its share or behind it.
    """
    done = dict.fromkeys(parts, 0)
    slots: dict[str | None, list[int]] = {s: [] for s in parts}
    for t in range(PERIOD):
        ready = [s for s, w in parts.items() if done[s] < w and done[s] * PERIOD // w <= t]
        first = min(ready, key=lambda s: (-(-(done[s] + 1) * PERIOD // parts[s]), str(s)))
        slots[first].append(t)
        done[first] += 1
    return slots


@dataclass(frozen=True)
class Phase:
    """Until the first source runs out: where it starts, and per source the first block, one past the last, and its slots."""

    base: int
    blocks: dict[str | None, tuple[int, int]]
    slots: dict[str | None, list[int]]


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> list[Phase]:
    """The whole schedule in at most as many phases as there are sources.

    When a source has no blocks left, the others go on with their weights in proportion, so every
    block gets a slot exactly once.
    """
    left = {s: n for s, n in blocks.items() if n}
    base, used, out = 0, dict.fromkeys(left, 0), []
    while left:
        slots = period_slots(whole_weights({s: weights[s] for s in left}))
        ends = [(n - 1) // len(slots[s]) * PERIOD + slots[s][(n - 1) % len(slots[s])] + 1 for s, n in left.items()]
        length = min(ends)
        taken = {s: length // PERIOD * len(slots[s]) + sum(t < length % PERIOD for t in slots[s]) for s in left}
        out.append(Phase(base, {s: (used[s], used[s] + taken[s]) for s in left}, slots))
        base += length
        for s in taken:
            used[s] += taken[s]
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
    return out


def whole_ratios(weights: Sequence[float]) -> list[int]:
    """Positive weights times one common power of two that makes all of them whole, so nothing is rounded."""
    pairs = [float(w).as_integer_ratio() for w in weights]
    common = max((d for _, d in pairs), default=1)
    return [n * (common // d) for n, d in pairs]


def schedule(blocks: Sequence[int], weights: Sequence[float]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source's place, block, release, deadline, slot) of every block, in the order of the slots.

    The targets are those of a fluid in which every source that is not used up flows with its
    weight: at time v it has given min(w * v, its blocks), and all together T(v), which is the slot.
    Block k is released at slot floor(T(k / w)) and is due before ceil(T((k + 1) / w)); each slot
    goes to the released block with the earliest deadline. The fluid is a fractional schedule within
    the same windows, so no deadline is missed and no slot stays free, and a source is never a whole
    block ahead of its target or behind it. All of it is in whole numbers, so no weight is rounded.
    Sources of weight 0 share the slots after all others.
    """
    if any(not 0 <= w < float("inf") for w in weights):
        raise ValueError("weights must be finite and not negative")
    base = 0
    for some in (True, False):
        places = [i for i, (n, w) in enumerate(zip(blocks, weights, strict=True)) if n and (w > 0) == some]
        own = [blocks[i] for i in places]
        for i, block, release, deadline, slot in _scheduled(own, whole_ratios([weights[i] if some else 1.0 for i in places])):
            yield places[i], block, base + release, base + deadline, base + slot
        base += sum(own)


def _scheduled(blocks: list[int], parts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    # Times as whole numbers so fine that different ones stay different.
    fine = 2 * max(parts, default=1).bit_length() + 2
    order = sorted(range(len(blocks)), key=lambda i: (blocks[i] << fine) // parts[i])
    ends = [(blocks[i] << fine) // parts[i] for i in order]
    given = [0, *accumulate(blocks[i] for i in order)]
    flow = list(accumulate((parts[i] for i in order), lambda left, w: left - w, initial=sum(parts)))

    def window_end(i: int, k: int) -> tuple[int, int]:
        """T(k / w), rounded down and up."""
        gone = bisect_right(ends, (k << fine) // parts[i])
        whole, rest = divmod(k * flow[gone], parts[i])
        return given[gone] + whole, given[gone] + whole + (rest > 0)

    ready, later = [], []
    for i in range(len(blocks)):
        release, due = window_end(i, 1)
        ready.append((due, i, 0, 0, release))
    heapq.heapify(ready)
    for slot in range(given[-1]):
        while later and later[0][0] <= slot:
            release, i, k = heapq.heappop(later)
            following, due = window_end(i, k + 1)
            heapq.heappush(ready, (due, i, k, release, following))
        due, i, k, release, following = heapq.heappop(ready)
        yield i, k, release, due, slot
        if k + 1 < blocks[i]:
            heapq.heappush(later, (following, i, k + 1))


def block_slots(sizes: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, block_docs: int) -> DataFrame:
    """(source, rest, block, release, deadline, slot) per block of ``sizes`` (source, rest, n).

    One task goes through the blocks, since each slot depends on the one before; it holds a few
    numbers per source and no document.
    """
    least = min(weights.values(), default=1.0) if weights is not None else 0.0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, counts = [], []
        for batch in batches:
            sources += [None if rest else s for s, rest in zip(batch.column("source").to_pylist(), batch.column("rest").to_pylist(), strict=True)]
            counts += batch.column("n").to_pylist()
        targets = [float(n) ** alpha for n in counts] if weights is None else [weights.get(s, least) for s in sources]
        rows: list[tuple[int, int, int, int, int]] = []

        def batch_of() -> pa.RecordBatch:
            i, *numbers = zip(*rows, strict=True)
            own = [sources[k] for k in i]
            return pa.RecordBatch.from_arrays(
                [pa.array([s or "" for s in own], pa.string()), pa.array([s is None for s in own]), *[pa.array(x, pa.int64()) for x in numbers]],
                ["source", "rest", "block", "release", "deadline", "slot"],
            )

        for row in schedule([-(-n // block_docs) for n in counts], targets):
            rows.append(row)
            if len(rows) == BATCH:
                yield batch_of()
                rows = []
        if rows:
            yield batch_of()

    ordered = sizes.repartition(1).sortWithinPartitions("rest", "source")
    return ordered.mapInArrow(assign, "source string, rest boolean, block long, release long, deadline long, slot long")


def grouped(docs: DataFrame, weights: Mapping[str | None, float] | None) -> DataFrame:
    """With mix_source: the source, or null where ``weights`` are given and do not name it."""
    if weights is None:
        return docs.withColumn("mix_source", F.col("source"))
    named = docs.sparkSession.createDataFrame([(s,) for s in weights if s is not None], "mix_source string")
    return docs.join(F.broadcast(named), F.col("source") == F.col("mix_source"), "left")  # as many as the mapping has


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = 0.5, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """The rows with mix_source, mix_block, mix_release, mix_deadline, mix_slot and mix_position.

    ``weights`` gives targets per source; the key None is for all other sources and rows without
    one, together. Without it, every source gets the power ``alpha`` of its size, and so do the rows
    without one; no number of sources is too large, as sizes and slots are tables.
    Documents of a source are numbered in the order of a hash of their id and cut into blocks. Rows
    sorted by mix_position are the mixture; every row is in it once, also repeated ones, whose order
    among themselves is open. A text is not read. An empty table gives no rows; columns of the
    table with these names are replaced.
    """
    made = ["mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position"]
    # the row travels as one struct, so no column of it meets a name used here
    whole = docs.select(F.struct(*[c for c in docs.columns if c not in made]).alias("doc"), "source", "doc_id")
    own = [F.coalesce("mix_source", F.lit("")).alias("_source"), F.col("mix_source").isNull().alias("_rest")]
    rows = grouped(whole, weights).select("doc", "doc_id", "mix_source", *own, F.xxhash64("doc_id").alias("_hash"))
    sizes = rows.groupBy(F.col("_source").alias("source"), F.col("_rest").alias("rest")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "mix-sizes")
    slots = stored(block_slots(sizes, weights, alpha, block_docs), "mix-slots")

    def keyed(table: DataFrame) -> DataFrame:
        """The table under names that no column of the documents has."""
        return table.select(*[F.col(c).alias(f"_{c}") for c in table.columns])

    rows = rows.join(keyed(sizes), ["_source", "_rest"])
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.ceil(F.col("_n") / BUCKET))).drop("_n")
    held = rows.groupBy("_source", "_rest", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = held.select(
        "_source", "_rest", "_bucket", (F.sum("_n").over(Window.partitionBy("_source", "_rest").orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    inside = Window.partitionBy("_source", "_rest", "_bucket").orderBy("_hash", "doc_id")
    numbered = rows.withColumn("_row", F.row_number().over(inside)).join(before, ["_source", "_rest", "_bucket"])
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_row") - 1)
    numbered = numbered.withColumn("_block", F.floor(F.col("_number") / block_docs))
    timed = numbered.join(keyed(slots), ["_source", "_rest", "_block"])
    return timed.select(
        "doc.*",
        "mix_source",
        F.col("_block").alias("mix_block"),
        F.col("_release").alias("mix_release"),
        F.col("_deadline").alias("mix_deadline"),
        F.col("_slot").alias("mix_slot"),
        (F.col("_slot") * block_docs + F.pmod("_number", F.lit(block_docs))).alias("mix_position"),
    )


def in_mix_order(mixed: DataFrame, rows: int) -> DataFrame:
    """The rows of :func:`mix` without its columns, in the order of the mixture over the partitions.

    Positions are dealt to partitions in even ranges, so no sample of them is taken. ``rows`` is
    about the number of rows.
    """
    made = ["mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot"]
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(parts - 1), F.floor(F.col("mix_position") * parts / max(rows, 1))).cast("int")
    ordered = mixed.drop(*made).repartitionById(parts, part).sortWithinPartitions("mix_position")
    return ordered.drop("mix_position")
