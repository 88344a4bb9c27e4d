"""The trajectory ledger: state, action, result and parameter matrix of past runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_SIZE = 200
MAX_STATE_CHARS = 256


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def coerce_result(text: Column) -> Column:
    """A result as a finite double: true and false count as 1 and 0, anything else gives null."""
    number = F.when(F.lower(text) == "true", F.lit(1.0)).when(F.lower(text) == "false", F.lit(0.0)).otherwise(
        text.try_cast("double")
    )
    return F.when(finite(number), number)


def sanitize_matrix(matrix: Column) -> Column:
    """Only finite numbers of a string map; booleans are not numbers."""
    typed = F.transform_values(matrix, lambda _, v: v.try_cast("double"))
    return F.map_filter(typed, lambda _, v: finite(v))


def sanitize_state(state: Column, max_chars: int = MAX_STATE_CHARS) -> Column:
    """String state: numbers must be finite, long strings are cut as the ledger stores them."""
    kept = F.map_filter(state, lambda _, v: v.isNotNull() & (v.try_cast("double").isNull() | finite(v.try_cast("double"))))
    return F.transform_values(kept, lambda _, v: F.when(v.try_cast("double").isNull(), F.left(v, F.lit(max_chars))).otherwise(v))


def top(ledger: DataFrame, count: int, order: Sequence[str], action: str | None = None, result: str = "result") -> DataFrame:
    """Best results, ties in ``order``; a top-k sort, so only k rows leave each task."""
    rows = ledger if action is None else ledger.where(F.col("action") == action)
    return rows.orderBy(F.desc(result), *order).limit(count)


def record(ledger: DataFrame, batch: DataFrame, order: Sequence[str], capacity: int = MAX_SIZE, result: str = "result") -> DataFrame:
    """Ledger after a batch: the best ``capacity`` of both."""
    return top(ledger.unionByName(batch.where(finite(F.col(result)))), capacity, order, result=result)


def state_similarity(target: Mapping[str, float | str], numbers: Mapping[str, str], texts: Mapping[str, str]) -> Column:
    """Similarity in [0, 1] of a row's state to ``target`` over the keys both have.

    ``target`` is one query state (a parameter), so scoring a ledger is one projection.
    ``numbers`` and ``texts`` map state keys to columns; a null column counts as absent.
    """
    shares: list[Column] = []
    for key, column in numbers.items():
        if isinstance(target.get(key), (int, float)):
            want = F.lit(float(target[key]))
            scale = F.greatest(F.abs(F.col(column)), F.abs(want), F.lit(1.0))
            shares.append(F.greatest(F.lit(0.0), 1.0 - F.abs(F.col(column) - want) / scale))
    for key, column in texts.items():
        if key in target:
            shares.append(F.when(F.col(column).isNotNull(), (F.col(column) == str(target[key])).cast("double")))
    if not shares:
        return F.lit(0.0)
    present = F.array_compact(F.array(*shares))
    total = F.aggregate(present, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(present) > 0, total / F.size(present)).otherwise(F.lit(0.0))


def best_matching(
    ledger: DataFrame, queries: Mapping[str, Mapping[str, float | str]], numbers: Mapping[str, str], texts: Mapping[str, str],
    count: int, order: Sequence[str], result: str = "result",
) -> DataFrame:
    """Best ``count`` rows per named query state: similarity first, then result.

    The query states are parameters; their scores become an array per row, and the rank filter
    lets each task keep only ``count`` rows per query before the shuffle.
    """
    scored = F.array(
        *[F.struct(F.lit(n).alias("query"), state_similarity(s, numbers, texts).alias("similarity")) for n, s in queries.items()]
    )
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), F.desc(result), *order)
    return (
        ledger.select("*", F.inline(scored)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)
    )


def best_matrices(ledger: DataFrame, count: int, order: Sequence[str], matrix: str, result: str = "result") -> DataFrame:
    """First ``count`` non-empty matrices of a four times larger fetch."""
    return (
        top(ledger, count * 4, order, result=result)
        .where(F.size(matrix) > 0)
        .orderBy(F.desc(result), *order)
        .limit(count)
    )


def stats(ledger: DataFrame, keys: Sequence[str], matrix: str, result: str = "result") -> DataFrame:
    good = F.when(finite(F.col(result)), F.col(result))
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.round(F.coalesce(F.max(good), F.lit(0.0)), 6).alias("best_result"),
        F.round(F.coalesce(F.avg(good), F.lit(0.0)), 6).alias("mean_result"),
        F.count_if(F.size(matrix) > 0).alias("with_parameter_matrix"),
    )


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """Best k per group; the rank limit is applied before the shuffle, so hot groups shrink first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
