"""Streams that take a key page by page, and a state table that is compacted."""

import pytest
from pyspark.sql import functions as F

from factloom.streaming import cycles


@pytest.fixture
def small_pages(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_streams_merge_pages_in_order(spark, tmp_path, small_pages, monkeypatch):
    monkeypatch.setattr(cycles, "CHUNK_ROWS", 3)
    monkeypatch.setattr(cycles, "APPEND_ROWS", 4)
    shuffled = spark.range(200).select(((F.col("id") * 77) % 200).alias("pos")).withColumn("key", F.col("pos") % 2)
    scores = shuffled.select("key", "pos", (F.col("pos") % 10 / 10.0).alias("score"))
    feed = shuffled.select(F.col("key").alias("file"), F.col("pos").alias("position"), F.format_string("m%d", "pos").alias("message"), (F.col("pos") % 31 == 5).alias("drain"))
    for name, rows, batch, stream in (
        ("paged_scores", scores, cycles.score_states_batch(scores, ["pos"]), lambda s: cycles.score_states_stream(s, ["pos"])),
        ("paged_feed", feed, cycles.feed_batch(feed), cycles.feed_stream),
    ):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
        query = (
            stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
            .trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))


def test_state_table_stays_compact(spark, tmp_path):
    root, files, want = str(tmp_path / "cache"), [], {}

    def measure(df):
        return df.select("key", "fingerprint", F.length("fingerprint").alias("n"))

    for number in range(13):
        rows = [(k, f"{k % 5 * number // 4}") for k in range(number % 3, 30, 2)]
        want |= dict(rows)
        batch = spark.createDataFrame(rows, "key long, fingerprint string").coalesce(1)
        for _ in range(2 if number in (3, 4) else 1):  # a batch that is run again
            cycles.recompute_changed(batch, number, root, measure, compact_every=4)
        files.append(len(cycles.read_versions(spark, root).inputFiles()))
        assert {r.key: r.fingerprint for r in cycles.read_versions(spark, root).collect()} == want
    assert max(files[4:8]) >= max(files[8:12])
    assert not (tmp_path / "cache" / "batch=0").exists() and (tmp_path / "cache" / "batch=12").exists()
    assert cycles.read_versions(spark, str(tmp_path / "none")) is None
