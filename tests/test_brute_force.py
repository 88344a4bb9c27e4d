"""Operators without a SQL twin, and the exactness of the scalable forms, against plain loops."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import extract, ranking, similarity
from factloom.streaming import cycles


def test_similar_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 5)]) for i in range(150)]
    got = {(r.id_a, r.id_b) for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.9).collect()}
    want = set()
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        if na and nb and sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) >= 0.9 - 1e-12:
            want.add((i, j))
    assert got == want


def test_three_objectives(spark):
    rnd = random.Random(5)
    rows = [(i, i % 2, *(float(rnd.randint(0, 6)) for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, c double")
    got = {r.id for r in ranking.dominated(df, ["a", "b", "c"], ["g"]).where("dominated").collect()}
    want = {
        p[0] for p in rows
        if any(q[1] == p[1] and all(x <= y for x, y in zip(q[2:], p[2:], strict=True)) and q[2:] != p[2:] for q in rows)
    }
    assert got == want


def test_chosen_spans(spark):
    text = "ABCDE 123456 a@b.cd XYZQ 999999999"
    hits = extract.pattern_hits(spark.createDataFrame([(1, text)], "id int, text string"), extract.PROSE_RISKS)
    row = extract.chosen_spans(hits).first()
    taken = []
    for category, start, end in sorted((h.category, h.start, h.end) for h in hits.first().hits):
        if all(end < s or start > e for _, s, e in taken):
            taken.append((category, start, end))
    assert [(c.category, c.start, c.end) for c in row.chosen] == taken


def test_score_machine_batch_equals_stream(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    rows = spark.range(120).select((F.col("id") % 3).alias("key"), F.col("id").alias("pos"), (F.col("id") % 10 / 10.0).alias("score"))
    batch = sorted(map(tuple, cycles.score_states_batch(rows, ["pos"]).collect()))
    for part in range(3):  # one file per micro-batch, in order
        rows.where(F.floor(F.col("pos") / 40) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        cycles.score_states_stream(source, ["pos"]).writeStream.format("memory").queryName("score_states")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("score_states").collect())) == batch


def test_feed_stream_equals_batch(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    rows = spark.range(60).select((F.col("id") % 4).alias("file"), F.col("id").alias("position"), F.format_string("m%d", "id").alias("message"), (F.col("id") % 11 == 5).alias("drain"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (
        cycles.feed_stream(source).writeStream.format("memory").queryName("feed")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("feed").collect())) == sorted(map(tuple, cycles.feed_batch(rows).collect()))


def test_changed_only_and_ledger_streams(spark, tmp_path):
    def measure(df):
        return df.select("key", "fingerprint", F.length("fingerprint").alias("n"))

    def cycle(rows, version):
        spark.createDataFrame(rows, "key long, fingerprint string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("key long, fingerprint string").parquet(str(tmp_path / "in"))
        assert cycles.changed_only_stream(source, str(tmp_path / "cache"), str(tmp_path / "cp"), measure).start().awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "cache")).where(F.col("batch") == version).count()

    assert cycle([(i, "a") for i in range(50)], 0) == 50
    assert cycle([(i, "a") for i in range(50)], 1) == 0
    assert cycle([(i, "b" if i == 7 else "a") for i in range(50)], 2) == 1
    assert cycles.read_versions(spark, str(tmp_path / "cache")).where("key = 7").first().fingerprint == "b"

    spark.range(20).select("id", F.col("id").cast("double").alias("result")).repartition(2).write.parquet(str(tmp_path / "t"))
    source = spark.readStream.schema("id long, result double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    assert cycles.bounded_ledger_stream(source, str(tmp_path / "ledger"), str(tmp_path / "lcp"), ["id"], 5).start().awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "ledger")).where("version = 1")
    assert {r.result for r in last.collect()} == {15.0, 16.0, 17.0, 18.0, 19.0}
