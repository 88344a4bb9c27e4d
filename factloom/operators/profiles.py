"""Token profiles of texts, corpus baselines and z-score anomalies."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.functions import fixed
from factloom.functions import text as T
from factloom.operators.pages import text_pages
from factloom.session import cut_lineage


def pattern_count(text: Column, pattern: str) -> Column:
    """Matches of a pattern, with Unicode classes and ``\\n`` as the only line end."""
    return F.regexp_count(text, F.lit(f"(?Umd){pattern}")).cast("long")


def token_profile(
    docs: DataFrame, text: str = "text", patterns: Mapping[str, str] = fixed.TOKEN_PATTERNS
) -> DataFrame:
    """One count column per token category, all in a single projection."""
    return docs.withColumns({name: pattern_count(F.col(text), p) for name, p in patterns.items()}).drop(text)


def aggregate_profile(profiles: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return profiles.agg(*[F.sum(m).alias(m) for m in metrics])


def long_profile(profiles: DataFrame, id_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unpivot metric columns to (id, metric, value) rows."""
    return profiles.unpivot(list(id_cols), list(metrics), "metric", "value").withColumn(
        "value", F.col("value").cast("double")
    )


def baseline(measures: DataFrame) -> DataFrame:
    """Mean and sample deviation per metric; a single value gets deviation 1."""
    return measures.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.when(F.count("value") == 1, F.lit(1.0)).otherwise(F.stddev_samp("value")).alias("stdev"),
    )


def anomalies(
    measures: DataFrame,
    rules: Sequence[tuple[str, str, bool]] = fixed.ANOMALY_RULES,
    threshold: float = fixed.ANOMALY_THRESHOLD,
) -> DataFrame:
    """Rows whose z-score leaves the baseline of their metric.

    ``rules`` is the parameter list (category, metric, inverted), so the baseline joined back
    has at most one row per rule metric: that is the size bound behind the broadcast.
    """
    spark = measures.sparkSession
    rule_rows = spark.createDataFrame(list(rules), "category string, metric string, inverted boolean")
    # written once: the baseline and the scores read these narrow rows, not the texts again
    wanted = cut_lineage(measures.where(F.col("metric").isin([m for _, m, _ in rules])))
    stats = rule_rows.join(baseline(wanted), "metric").where(F.col("stdev") >= fixed.MIN_STDEV)
    z = (F.col("value") - F.col("mean")) / F.col("stdev")
    return (
        wanted.join(F.broadcast(stats), "metric")
        .withColumn("zscore", z)
        .where(F.when(F.col("inverted"), F.col("zscore") < -threshold).otherwise(F.col("zscore") > threshold))
        .withColumn("severity", F.when(F.abs("zscore") > threshold * 2, "critical").otherwise("warning"))
        .drop("mean", "stdev", "inverted")
    )


def capped_anomalies(found: DataFrame, order: Sequence[str], ceiling: int = fixed.ANOMALY_CEILING) -> DataFrame:
    """The report's top-k: largest absolute z first."""
    return found.orderBy(F.abs("zscore").desc(), *order).limit(ceiling)


def severity_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def scan_status(docs: DataFrame, text: str = "text", max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Status, character count, fingerprint and line count; oversized texts are only marked."""
    size = F.octet_length(text)
    body = F.col(text)
    scanned = size <= max_bytes
    return docs.withColumns(
        {
            "status": F.when(body.isNull(), "unreadable").when(scanned, "scanned").otherwise("skipped_too_large"),
            "file_size": F.when(scanned, F.length(body)).otherwise(size).cast("long"),
            "fingerprint": F.when(scanned, F.sha2(body, 256)),
            "line_count": F.when(
                scanned,
                F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + F.when(body != "", 1).otherwise(0),
            ).cast("long"),
        }
    ).drop(text)


def scan_summary(scanned: DataFrame, target: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    ok = F.count_if(F.col("status") == "scanned")
    total = F.count(F.lit(1))
    coverage = F.round(ok / F.greatest(total, F.lit(1)), 6)
    return scanned.groupBy(*keys).agg(
        ok.alias("scanned"), (total - ok).alias("failed"), total.alias("total"), coverage.alias("coverage"),
        (ok / F.greatest(total, F.lit(1)) >= target).alias("coverage_passed"),
    )


def token_events(
    docs: DataFrame, text: str = "text", patterns: Mapping[str, str] = fixed.TOKEN_PATTERNS
) -> DataFrame:
    """Array column ``events`` of (start, end, category), ordered by start, then category order.

    Spark returns matches without offsets, so this one step runs in Arrow batches: pages of bounded text, whose
    events are kept as flat columns.
    """
    compiled = [(name, re.compile(p, re.MULTILINE)) for name, p in patterns.items()]
    labels = pa.array([name for name, _ in compiled], pa.string())
    kept = [c for c in docs.columns if c not in (text, "events")]
    event = StructType.fromDDL("events array<struct<start:int,end:int,category:string>>")
    schema = StructType([*docs.select(*kept).schema.fields, *event.fields])
    of_event = to_arrow_schema(event).field("events").type

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in text_pages(batches, text):
            starts, ends, ranks, offsets = array("i"), array("i"), array("i"), array("i", [0])
            for body in page.column(text):
                hits = [(m.start(), rank, m.end()) for rank, (_, pattern) in enumerate(compiled) for m in pattern.finditer(body.as_py() or "")]
                for start, rank, end in sorted(hits):
                    starts.append(start)
                    ends.append(end)
                    ranks.append(rank)
                offsets.append(len(starts))
            places = pa.array(np.array(ranks, np.int32))
            columns = [pa.array(np.array(starts, np.int32)), pa.array(np.array(ends, np.int32)), labels.take(places)]
            rows = pa.StructArray.from_arrays(columns, fields=list(of_event.value_type))
            found = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), rows).cast(of_event)
            yield pa.RecordBatch.from_arrays([*[page.column(c) for c in kept], found], names=[*kept, "events"])

    return docs.select(*kept, text).mapInArrow(find, schema)


def ngram_counts(docs: DataFrame, items: str, keys: Sequence[str] = (), window: int = fixed.NGRAM_WINDOW) -> DataFrame:
    """Counts of n-grams over an array column, per ``keys`` (or over the corpus)."""
    return (
        docs.select(*keys, F.explode(ngrams(F.col(items), window)).alias("gram"))
        .groupBy(*keys, "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ngrams(items: Column, window: int = fixed.NGRAM_WINDOW) -> Column:
    """All runs of ``window`` neighbouring items, joined by a blank; none when too few."""
    starts = F.when(F.size(items) >= window, F.sequence(F.lit(1), F.size(items) - (window - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, window), " "))


def ngram_totals(docs: DataFrame, items: str, window: int = fixed.NGRAM_WINDOW) -> DataFrame:
    """Total and unique n-grams per row, without leaving the row."""
    grams = ngrams(F.col(items), window)
    return docs.withColumns(
        {
            "total_ngrams": F.size(grams).cast("long"),
            "unique_ngrams": F.size(F.array_distinct(grams)).cast("long"),
        }
    ).drop(items)


def top_ngrams(counts: DataFrame, top: int = fixed.NGRAM_TOP) -> DataFrame:
    return counts.orderBy(F.desc("n"), "gram").limit(top)


def entropy_gate(
    docs: DataFrame,
    text: str = "text",
    min_token_entropy: float = T.MIN_TOKEN_ENTROPY,
    min_line_entropy: float = T.MIN_LINE_ENTROPY,
    min_diversity: float = T.MIN_DIVERSITY,
) -> DataFrame:
    """Pass/fail with the three measures, the parameter fingerprint and the reasons for failing."""
    body = F.col(text)
    measured = docs.withColumns(
        {
            "token_entropy": T.token_entropy(body),
            "line_entropy": T.line_entropy(body),
            "structural_diversity": T.structural_diversity(body),
            "param_fingerprint": T.parameter_fingerprint(body),
        }
    ).drop(text)

    def reason(label: str, column: str, limit: float) -> Column:
        note = F.format_string(f"{label} %.2f below threshold {limit}", F.col(column))
        return F.when(F.col(column) < limit, note)

    reasons = F.array_compact(
        F.array(
            reason("Token entropy", "token_entropy", min_token_entropy),
            reason("Line entropy", "line_entropy", min_line_entropy),
            reason("Structural diversity", "structural_diversity", min_diversity),
        )
    )
    return measured.withColumn("reasons", reasons).withColumns(
        {
            "passed": F.size("reasons") == 0,
            "token_entropy": F.round("token_entropy", 3),
            "line_entropy": F.round("line_entropy", 3),
            "structural_diversity": F.round("structural_diversity", 3),
        }
    )


def line_delta(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Changed flag, lines added and removed (as sets) and character delta of two text columns."""
    a, b = T.split_lines(F.col(old)), T.split_lines(F.col(new))
    return pairs.withColumns(
        {
            "changed": F.sha2(old, 256) != F.sha2(new, 256),
            "old_line_count": F.size(a).cast("long"),
            "new_line_count": F.size(b).cast("long"),
            "lines_added": F.size(F.array_except(b, a)).cast("long"),
            "lines_removed": F.size(F.array_except(a, b)).cast("long"),
            "size_delta_chars": (F.length(new) - F.length(old)).cast("long"),
        }
    ).drop(old, new)


def line_lint(
    docs: DataFrame, rules: Sequence[tuple[str, str]], text: str = "text", separator: str = "\n"
) -> DataFrame:
    """One row per (line, rule) hit; ``rules`` is the parameter list (rule, pattern)."""
    numbered = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(text, separator)).alias("pos", "line"))
    checks = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in rules]))
    return (
        numbered.withColumn("line_no", F.col("pos") + 1)
        .withColumn("rule", F.explode(checks))
        .drop("pos", "line")
    )
