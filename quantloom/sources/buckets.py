"""A table kept in buckets of its key, of which a change writes only those that it falls into, as a new version."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def versions(spark: SparkSession, target: str) -> tuple:
    """The file system, and of each bucket the numbers of its complete versions with their paths, newest first."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    store = make(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list] = {}
    if store.exists(make(target)):
        for folder in (s.getPath() for s in store.listStatus(make(target)) if s.getPath().getName().startswith("v=")):
            if store.exists(make(folder, "_SUCCESS")):
                for part in (s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("bucket=")):
                    found.setdefault(int(part.getName()[7:]), []).append((int(folder.getName()[2:]), part))
    return store, {k: sorted(v, key=lambda x: -x[0]) for k, v in found.items()}


def drop_older(spark: SparkSession, target: str, number: int, touched: Sequence[int]) -> None:
    """Remove the versions of buckets that stand before the last one before `number`."""
    store, found = versions(spark, target)
    for n in touched:
        for _, path in [x for x in found.get(n, []) if x[0] < number][1:]:
            store.delete(path, True)


def current(spark: SparkSession, target: str, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The state after the last complete change, or after the last one before a given number; of some buckets, or all."""
    _, found = versions(spark, target)
    paths = []
    for n, of_bucket in found.items():
        kept = [path for number, path in of_bucket if before is None or number < before]
        if kept and (buckets is None or n in buckets):
            paths.append(kept[0].toString())
    return spark.read.parquet(*paths) if paths else None


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the column bucket, each bucket in one task."""
    return rows.withColumn("bucket", bucket(keys)).repartition("bucket")


def put_dealt(rows: DataFrame, target: str, number: int) -> None:
    """Write rows that are dealt as version `number` of the buckets that they fall into. A change that is repeated writes the same
    folder."""
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number:09d}")


def put(rows: DataFrame, target: str, number: int, keys: Sequence[str]) -> None:
    """The same for rows as they are."""
    put_dealt(dealt(rows, keys), target, number)


def rewrite(spark: SparkSession, target: str, number: int, keys: Sequence[str], touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Write change of the buckets' rows, as version `number`, for the buckets that the touched keys fall into: BUCKETS at most."""
    numbers = [r["bucket"] for r in touched.select(bucket(keys).alias("bucket")).distinct().collect()]
    old = current(spark, target, number, numbers) if numbers else None
    if old is not None:
        put(change(old), target, number, keys)
        drop_older(spark, target, number, numbers)
    return numbers
