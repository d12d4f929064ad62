"""As-of joins without a range join: probes and observations in one stream, the last observation carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quantloom.sources.store import written


def _carried(ranges: list, ahead: bool) -> list[tuple]:
    """(part, its first key, the observation of that key before the part), from each part's first and last key and its last
    observation; going the other way, last and first change places and the observation is the next one."""
    out, key, seen = [], object(), None
    for r in ranges:
        enter, leave, own = (r["last_key"], r["first_key"], r["first_seen"]) if ahead else (r["first_key"], r["last_key"], r["last_seen"])
        out.append((r["__part"], enter, seen if enter == key else None))
        if own is not None and own["k"] == leave:
            seen = own["s"]
        elif leave != enter or enter != key:
            seen = None
        key = leave
    return [row for row in out if row[2] is not None]


def asof_join(probes: DataFrame, observed: DataFrame, by: str, at: str, value: str, tolerance_days: int | None = None,
              or_earliest: bool = False) -> DataFrame:
    """probes (with `by` and `at`) and the observed `value` at the latest time not after `at`, with its time in `<value>_at`.

    Probes and observations are cut together by ranges of key and time and written, and the last observation runs on
    within a range; what a range begins with comes from the ranges before it, a row a partition through the driver. So a
    key that holds nearly all rows is many tasks. An observation at the probe's own time counts. Older values than the
    tolerance, in days, are null; with or_earliest a probe before all observations takes the first. Observations have
    one value a key and time; null keys are a key.
    """
    marks = observed.select(F.col(by), F.col(at), F.lit(0).alias("__probe"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("__seen"))
    asks = probes.select(F.col(by), F.col(at), F.lit(1).alias("__probe"), F.struct(*probes.columns).alias("__row"))
    order = [by, at, "__probe"]
    cut = marks.unionByName(asks, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = written(cut.withColumn("__i", F.monotonically_increasing_id()), "as-of").withColumn("__part", F.shiftright("__i", 33))
    known = F.when(F.col("__seen").isNotNull(), F.struct(F.col(by).alias("k"), F.col("__seen").alias("s")))
    ranges = sorted(laid.groupBy("__part").agg(
        F.min_by(F.struct(F.col(by).alias("k")), "__i")["k"].alias("first_key"), F.max_by(F.struct(F.col(by).alias("k")), "__i")["k"].alias("last_key"),
        F.min_by(known, F.when(known.isNotNull(), F.col("__i"))).alias("first_seen"), F.max_by(known, F.when(known.isNotNull(), F.col("__i"))).alias("last_seen")).collect(),
        key=lambda r: r["__part"])
    key, seen = laid.schema[by].dataType, laid.schema["__seen"].dataType

    def entering(rows: list[tuple], name: str) -> DataFrame:
        return laid.sparkSession.createDataFrame(rows, StructType([StructField("__part", LongType()), StructField("__k", key), StructField(name, seen)])).withColumnRenamed("__k", f"{name}_k")

    def with_entering(rows: DataFrame, found: list[tuple], name: str) -> DataFrame:
        met = F.when(F.col(by).eqNullSafe(F.col(f"{name}_k")), F.col(name))
        return rows.join(F.broadcast(entering(found, name)), "__part", "left").withColumn(name, met)

    group = Window.partitionBy("__part", by).orderBy("__i")
    both = with_entering(laid, _carried(ranges, False), "__before")
    both = both.withColumn("__last", F.coalesce(F.last("__seen", ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, 0)), "__before"))
    if or_earliest:
        both = with_entering(both, _carried(ranges[::-1], True), "__after")
        following = F.first("__seen", ignorenulls=True).over(group.rowsBetween(0, Window.unboundedFollowing))
        both = both.withColumn("__last", F.coalesce("__last", following, "__after"))
    found = both.filter("__probe = 1")
    fresh = F.lit(True) if tolerance_days is None else F.datediff(F.col(at), F.col("__last.t")) <= tolerance_days
    return found.select("__row.*", F.when(fresh, F.col("__last.v")).alias(value), F.when(fresh, F.col("__last.t")).alias(f"{value}_at"))


def asof_one(observed: DataFrame, by: str, at: str, value: str, when) -> DataFrame:
    """The value of each key at one time: an aggregate, which combines before the shuffle."""
    return observed.filter(F.col(at) <= when).groupBy(by).agg(F.max_by(value, at).alias(value))
