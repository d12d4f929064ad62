"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of long texts, where the session sets no limit.
BATCH_BYTES = 1 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def session_folder(spark: SparkSession) -> str:
    """The application's own folder under spark.checkpoint.dir, which holds all that it writes on the way. A local session
    without that setting gets a temporary folder; on a cluster it has to be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/tables-{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove what this application has written on the way. Results that aren't read yet may need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what reads it several times doesn't compute it again."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Python workers get batches of about a megabyte, so that long texts come few at a time. A session that
    has a limit keeps it; afterwards the setting is as it was."""
    before = spark.conf.get(_LIMIT, None)
    unset = before is None or int(before) == (1 << 31) - 1
    if unset:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        if unset and before is None:
            spark.conf.unset(_LIMIT)
        elif unset:
            spark.conf.set(_LIMIT, before)


#: Bytes of code from which the JVM interprets a method and never compiles it.
METHOD_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def small_methods(spark: SparkSession) -> None:
    """Have stages whose generated method would be too long to be compiled run operator by operator, whose methods are short: for
    projections of very many expressions. A session that has its own limit keeps it; results depend on neither."""
    if int(spark.conf.get(_METHOD_LIMIT, "65535")) == 65535:
        spark.conf.set(_METHOD_LIMIT, str(METHOD_BYTES))
