"""A store of fetched rows with an age for each key, and reads that fetch only what it lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.joins import spread_join


def stored(spark: SparkSession, store: str, keys: list[str], before: int | None = None) -> DataFrame | None:
    """The newest rows of each key in the store, with fetched_at, as it was before a run, or as it is; None for an empty store."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(store).getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath() for s in files.listStatus(make(store))] if files.exists(make(store)) else []
    runs = [p for p in runs if p.getName().startswith("run=") and (before is None or int(p.getName()[4:]) < before)]
    whole = [p.toString() for p in runs if files.exists(make(p, "_SUCCESS"))]
    if not whole:
        return None
    rows = spark.read.option("basePath", store).parquet(*whole).drop("run")
    newest = rows.groupBy(*keys).agg(F.max("fetched_at").alias("fetched_at"))
    return spread_join(rows, newest, [*keys, "fetched_at"], [c for c in rows.columns if c not in keys])


def read_through(asked: DataFrame, store: str, run: int, fetch: Callable[[DataFrame], DataFrame], keys: list[str], now: str, max_age_days: int) -> tuple[DataFrame, DataFrame]:
    """The rows of all asked keys, and the keys that had to be fetched for that.

    Keys that the store lacks, or has older than max_age_days before now, go to fetch, a function of a table of keys, and
    what it gives is added to the store as the folder of this run; nothing that is stored is written again, and a run that
    is repeated after a failure writes its own folder anew. A fetched key replaces all of its older rows. Keys that
    fetch knows nothing of come back each time.
    """
    spark = asked.sparkSession
    at = F.lit(now).cast("timestamp")
    wanted, known = asked.select(*keys).distinct(), stored(spark, store, keys, run)
    absent = wanted
    if known is not None:
        fresh = known.filter(F.col("fetched_at") >= at - F.make_dt_interval(F.lit(max_age_days)))
        absent = wanted.join(fresh.select(*keys).distinct(), keys, "left_anti")
    absent.write.mode("overwrite").parquet(f"{store}-asked/run={run}")
    absent = spark.read.schema(absent.schema).parquet(f"{store}-asked/run={run}")
    fetch(absent).withColumn("fetched_at", at).write.mode("overwrite").parquet(f"{store}/run={run}")
    return stored(spark, store, keys, run + 1).join(wanted, keys, "left_semi"), absent


def padded_key(number, width: int = 10):
    """A register's key: the number with zeros before it."""
    return F.lpad(number.cast("string"), width, "0")
