from pathlib import Path

from pyspark.sql import functions as F

from quantloom.streaming.upsert import current, upsert_stream, windowed_counts
from tests.conftest import SMALL


def test_upsert_stream(spark, tmp_path):
    source, target, log = (f"{tmp_path}/{x}" for x in ("in", "out", "log"))
    first = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 1), (1, 7.0, 2)], "k int, v double, at int").coalesce(1)
    first.write.parquet(source)
    upsert_stream(spark, source, first.schema, target, log, ["k"], "at").awaitTermination()
    spark.createDataFrame([(2, 8.0, 3), (3, 9.0, 3)], "k int, v double, at int").coalesce(1).write.mode("append").parquet(source)
    upsert_stream(spark, source, first.schema, target, log, ["k"], "at").awaitTermination()
    assert sorted((r["k"], r["v"]) for r in current(spark, target).collect()) == [(1, 7.0), (2, 8.0), (3, 9.0)]
    # a batch writes only the buckets of its keys, and of these two versions stay
    written = sorted(p.parent.name for p in Path(target).glob("v=*/bucket=*"))
    assert written == ["v=000000000"] * 2 + ["v=000000001"] * 2
    for v in (4.0, 5.0):
        spark.createDataFrame([(3, v, 9)], "k int, v double, at int").coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark, source, first.schema, target, log, ["k"], "at").awaitTermination()
    assert sorted((r["k"], r["v"]) for r in current(spark, target).collect()) == [(1, 7.0), (2, 8.0), (3, 5.0)]
    buckets = [p.name for p in Path(target).glob("v=*/bucket=*")]
    assert max(buckets.count(b) for b in buckets) == 2


def test_windowed_counts_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted((str(r["window"]), r["event_type"], r["n"]) for r in df.collect())
    assert rows(spark.table("counts")) == rows(windowed_counts(batch))


def test_late_and_repeated_rows_change_nothing(spark, tmp_path):
    source, target, log = (f"{tmp_path}/{x}" for x in ("in", "out", "log"))
    kind = "k int, v double, at int"
    for k, rows in enumerate(([(1, 5.0, 10), (2, 6.0, 10)], [(1, 4.0, 9), (2, 7.0, 11)], [(1, 5.0, 10), (2, 6.0, 10)], [(1, 5.5, 10)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark, source, spark.createDataFrame([], kind).schema, target, log, ["k"], "at").awaitTermination()
        state = sorted((r["k"], r["v"], r["at"]) for r in current(spark, target).collect())
        assert state == [(1, 5.5 if k == 3 else 5.0, 10), (2, 6.0, 10) if k == 0 else (2, 7.0, 11)]
