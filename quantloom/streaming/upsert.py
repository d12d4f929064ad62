"""Micro-batch upserts with Structured Streaming: files arrive, the newest row of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources.buckets import bucket, current, dealt, drop_older, put_dealt


def newest(batch: DataFrame, keys: Sequence[str], collected_at: str) -> DataFrame:
    top = Window.partitionBy(*keys).orderBy(F.desc(collected_at), *[F.desc(c) for c in batch.columns if c not in (*keys, collected_at)])
    return batch.withColumn("__rn", F.row_number().over(top)).filter("__rn = 1").drop("__rn")


def upsert_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: Sequence[str], collected_at: str, files_a_batch: int | None = None):
    """Start a query that takes the Parquet files of source as they come and keeps the state under target up to date: of each key
    the row that was collected last, whenever it arrives.

    The state is dealt by a hash of the keys into buckets. A batch reads and writes only the buckets that its rows fall
    into, so a batch that is repeated after a failure writes the same folder again; readers take the newest complete
    version of each bucket, and older ones but the one before are removed. A row that is older than the state's, or
    comes a second time, changes nothing; of rows collected at the same time the greatest stays.
    """
    def merge(batch: DataFrame, number: int) -> None:
        arrived = newest(batch, keys, collected_at).persist()
        touched = [r["bucket"] for r in arrived.select(bucket(keys).alias("bucket")).distinct().collect()]  # BUCKETS at most
        if touched:
            old = current(batch.sparkSession, target, number, touched)
            both = dealt(arrived if old is None else old.unionByName(arrived), keys)  # one shuffle for the choice and the files
            put_dealt(newest(both, ["bucket", *keys], collected_at), target, number)
            drop_older(batch.sparkSession, target, number, touched)
        arrived.unpersist()

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by event type over tumbling windows; with a stream, events later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
