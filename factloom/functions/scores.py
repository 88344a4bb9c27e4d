"""Score arithmetic on columns: benefits, decays, objectives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of objective vectors and defaults of the decay schedules.
INVERSE_WALL_CAP = 1e9
OBJECTIVES = 3
GAMMA, PENALTY = 0.97, 0.02
INITIAL_RATE, MIN_RATE, WARMUP, PERIOD = 0.01, 1e-5, 50, 100
DECAY_RATE, DROP_FACTOR, DROP_EVERY = 0.995, 0.5, 100
HOT_THRESHOLD = 5.0


def net_benefit(score: Column, cost: Column, step: Column, transitions: Column, gamma: float = GAMMA, penalty: float = PENALTY) -> Column:
    """Discounted score minus penalised cost."""
    return score * F.pow(F.lit(gamma), step) - (cost + penalty * transitions)


def inverse_seconds(seconds: Column, cap: float = INVERSE_WALL_CAP) -> Column:
    """Speed objective: 0 seconds saturates at the cap; invalid or endless durations give 0."""
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    return F.when(bad, F.lit(0.0)).when(seconds == 0, F.lit(cap)).otherwise(F.least(F.lit(cap), F.try_divide(F.lit(1.0), seconds)))


def objective_vector(values: Column, size: int = OBJECTIVES, cap: float = INVERSE_WALL_CAP) -> Column:
    """Array padded with zeros or cut to ``size``, clamped to [0, cap], without NaN."""

    def clamp(v: Column) -> Column:
        return F.when(v.isNull() | F.isnan(v) | (v < 0), F.lit(0.0)).otherwise(F.least(v, F.lit(cap)))

    padded = F.slice(F.concat(F.coalesce(values, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), size)), 1, size)
    return F.transform(padded, clamp)


def seeded_score(coverage: Column, anomalies: Column, targets: Column) -> Column:
    """Coverage damped by the share of anomalies."""
    share = F.least(F.lit(1.0), anomalies / F.greatest(targets, F.lit(1)))
    return F.greatest(F.lit(0.0), coverage * (1.0 - share * 0.5))


def comment_free_share(comment_tokens: Column, code_tokens: Column) -> Column:
    ratio = comment_tokens / F.when(code_tokens == 0, F.lit(1.0)).otherwise(code_tokens)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - ratio))


def _warmup(cycle: Column) -> Column:
    return MIN_RATE + (INITIAL_RATE - MIN_RATE) * (cycle / WARMUP)


def cosine_rate(cycle: Column) -> Column:
    """Warm-up, then cosine decay with restarts whose periods grow."""
    effective = cycle - WARMUP
    # Periods double, so period k starts at PERIOD * (2**k - 1); the logarithm may miss k by rounding.
    guess = F.floor(F.log2(effective.cast("double") / PERIOD + 1) + 1e-9)
    start = lambda k: PERIOD * (F.pow(F.lit(2.0), k) - 1)
    k = F.when(start(guess) > effective, guess - 1).otherwise(guess)
    fraction = (effective - start(k)) / (PERIOD * F.pow(F.lit(2.0), k))
    rate = MIN_RATE + (INITIAL_RATE - MIN_RATE) * 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * fraction))
    return F.when(cycle < WARMUP, _warmup(cycle)).otherwise(F.greatest(F.lit(MIN_RATE), rate))


def exponential_rate(cycle: Column) -> Column:
    rate = INITIAL_RATE * F.pow(F.lit(DECAY_RATE), cycle - WARMUP)
    return F.when(cycle < WARMUP, _warmup(cycle)).otherwise(F.greatest(F.lit(MIN_RATE), rate))


def step_rate(cycle: Column) -> Column:
    rate = INITIAL_RATE * F.pow(F.lit(DROP_FACTOR), F.floor((cycle - WARMUP) / DROP_EVERY))
    return F.when(cycle < WARMUP, _warmup(cycle)).otherwise(F.greatest(F.lit(MIN_RATE), rate))


def weighted_objectives(weights: Mapping[str, float]) -> tuple[dict[str, Column], Column]:
    """Weighted columns (missing counts as infinite) and their total, infinite if one is."""
    infinite = F.lit(float("inf"))
    parts = {name: F.coalesce(F.col(name).cast("double"), infinite) * w for name, w in weights.items()}
    total: Column = F.lit(0.0)
    for part in parts.values():
        total = total + part
    return parts, total


def trace_accuracy(accuracy: Column, metric_accuracy: Column, successes: Column, total: Column) -> Column:
    ratio = F.when(total > 0, F.coalesce(successes, F.lit(0)) / total).otherwise(F.lit(0.0))
    return F.coalesce(accuracy, metric_accuracy, ratio)


def trace_velocity(average_latency_us: Column) -> Column:
    return F.when(average_latency_us > 0, 1e6 / average_latency_us).otherwise(F.lit(0.0))


def function_score(depth: Column, operations: Column, recursive: Column, calls: Column, span: Column) -> Column:
    """Linear cost estimate of a function."""
    return F.round(
        depth * 3.0 + operations * 1.5 + F.when(recursive, 5.0).otherwise(0.0) + calls * 0.2 + span * 0.05, 2
    )


def hot_or_cold(density: Column, cold_by_name: Column, threshold: float = HOT_THRESHOLD) -> Column:
    return F.when(~cold_by_name & (density >= threshold), "hot").otherwise("cold")


def first_numeric(fields: Column, keys: Sequence[str]) -> Column:
    """First of several alias keys of a string map that holds a number; booleans count as 1 and 0."""

    def number(key: Column) -> Column:
        text = F.try_element_at(fields, key)
        flag = F.when(F.lower(text) == "true", F.lit(1.0)).when(F.lower(text) == "false", F.lit(0.0))
        return F.coalesce(flag, text.try_cast("double"))

    found = F.transform(F.array(*[F.lit(k) for k in keys]), number)
    return F.get(F.filter(found, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(0))
