"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session, as in tests,
    gets a temporary one; on a cluster that is an error, as executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # a plain path belongs to the cluster's own file system
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


#: The folders that this session's operators have written to, in order.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it operators write their tables as ever; on leaving, all that were written go, but those that were handed to
    what the context gives, which returns its argument. For results that no longer depend on what they came from."""
    since, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(path for path in _made[since:] if any(path.split("/")[-1] in f for f in df.inputFiles()))
        return df

    try:
        yield keep
    finally:
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        for path in _made[since:]:
            if path not in kept:
                path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_of(path), True)
        _made[since:] = sorted(kept)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(col: str = "text") -> tuple:
    """Two 64-bit hashes that together identify a text; equal texts get equal outcomes, so they are the join key."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(7)).alias("k2")


#: Bytes of an Arrow batch for Python workers, where the session sets no limit.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers batches of about a megabyte, so that very long texts come few at a time, down to one.

    Spark's default has no limit by bytes. A session that has its own keeps it; what a query returns depends on neither.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str((1 << 31) - 1))) == (1 << 31) - 1:
        spark.conf.set(key, str(BATCH_BYTES))


#: Rows of one key in one task that are never split.
KEY_ROWS = 1000


def join_split(many: DataFrame, one: DataFrame, keys: Sequence[str], deal: Sequence[str], how: str = "inner") -> DataFrame:
    """many joined with one, as by many.join(one, keys, how), where a few keys may hold most rows of many.

    Rows of a key with more rows than half an average partition are dealt over several tasks by a hash of the columns
    deal, and one's rows of that key, of which there should be few, go to each. So there are at most twice as many such
    keys as shuffle partitions; their list, which is broadcast, has that bound. Both inputs should be tables, as
    many is read twice. Null keys match nothing.
    """
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = many.agg(F.count(F.lit(1)).alias("__total"))  # one row
    least = F.greatest(F.lit(KEY_ROWS), F.ceil(F.col("__total") / (2 * parts)))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("__n") > least).select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.ceil(F.col("__n") / least).cast("int").alias("__parts"))

    def dealt(side: DataFrame) -> DataFrame:
        same = [side[k] == hot[f"__k{i}"] for i, k in enumerate(keys)]
        return side.join(F.broadcast(hot), same, "left").drop(*(f"__k{i}" for i in range(len(keys))))

    left = dealt(many).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*deal), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = dealt(one).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str | Column], name: str) -> DataFrame:
    """df with, for each item of sums, a column by its name: the sum of its expression over all rows before in order.

    Rows are dealt by ranges of order and written; each range's totals, a row a partition, pass through the driver, and
    no task holds more than its range. Rows that tie keep the order that they were written in. df has few columns.
    """
    cast = lambda n, x: F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(0)).alias(f"__{n}")
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialize(cut.select("*", *(cast(n, x) for n, x in sums.items()), F.monotonically_increasing_id().alias("__at")), name)
    laid = laid.withColumn("__part", F.shiftright("__at", 33))
    totals = sorted(laid.groupBy("__part").agg(*(F.sum(f"__{n}").alias(n) for n in sums)).collect())
    before, so_far = [], [type(x)() for x in totals[0][1:]] if totals else []
    for part, *own in totals:
        before.append((part, *so_far))
        so_far = [a + b for a, b in zip(so_far, own)]
    kinds = ", ".join(f"__b_{n} {laid.schema[f'__{n}'].dataType.simpleString()}" for n in sums)
    offsets = df.sparkSession.createDataFrame(before, f"__part long, {kinds}")
    upto = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    found = laid.join(F.broadcast(offsets), "__part").select(
        *df.columns, *((F.col(f"__b_{n}") + F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0))).alias(n) for n in sums))
    return found


_state: dict = {}


def worker_state(key, make: Callable):
    """What an operator keeps in a Python worker between tasks: made once, and in place of any other operator's, whose
    memory goes back to the machine first. Workers outlive stages, so what they hold would add up."""
    if key not in _state:
        _state.clear()
        give_back()
        _state[key] = make()
        give_back()  # what only the making took
    return _state[key]


def give_back() -> None:
    """Free memory goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
