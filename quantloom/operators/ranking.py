"""Row numbers, conditional aggregates over them, and tie-aware percentiles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.joins import spread_join
from quantloom.sources.store import written

SENTINEL = 999999.0


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def latest_per(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in order."""
    return numbered(df, by, order, "__rn").filter("__rn = 1").drop("__rn")


def at_row(value: Column, k: int, rn: str = "rn") -> Column:
    """Aggregate: the value of the k-th row."""
    return F.max(F.when(F.col(rn) == k, value))


def over_rows(agg, value: Column, low: int, high: int, rn: str = "rn") -> Column:
    """Aggregate of the rows from the low-th to the high-th."""
    return agg(F.when(F.col(rn).between(low, high), value))


@dataclass(frozen=True)
class Factor:
    """How a key is turned into a percentile: lower may be better, a missing key has a fixed value, a sentinel gets 0."""

    missing: float = 0.3
    lower_is_better: bool = False


def with_running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str = "before", total: str | None = None) -> DataFrame:
    """df with, for each row, the sum of value over the rows of its group (by) that stand before it in order, and with
    total the sum over its group.

    Groups are cut by ranges of by and order, which are written, so a group that holds everything is no single task; a
    row for each group in each range passes through the driver. Few groups are meant, as for factors of a score.
    """
    cut = df.repartitionByRange(*map(F.col, by), *order).sortWithinPartitions(*map(F.col, by), *order)
    laid = written(cut.withColumns({"__v": value, "__at": F.monotonically_increasing_id()}), "running").withColumn("__part", F.shiftright("__at", 33))
    sums = laid.groupBy("__part", *by).agg(F.sum("__v").alias("v")).collect()
    so_far: dict = {}
    rows = []
    for r in sorted(sums, key=lambda r: r["__part"]):
        key = tuple(r[b] for b in by)
        rows.append((r["__part"], *key, so_far.get(key, type(r["v"])())))
        so_far[key] = rows[-1][-1] + r["v"]
    kind = laid.schema["__v"].dataType.simpleString()
    keys = "".join(f", {b} {laid.schema[b].dataType.simpleString()}" for b in by)
    ahead = df.sparkSession.createDataFrame([(*r, so_far[r[1:-1]]) for r in rows], f"__part long{keys}, __ahead {kind}, __total {kind}")
    upto = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = laid.join(F.broadcast(ahead), ["__part", *by]).withColumn(name, F.col("__ahead") + F.coalesce(F.sum("__v").over(upto), F.lit(0)))
    return out.select(*df.columns, name, *([F.col("__total").alias(total)] if total else []))


def numbered_all(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with the place, from 1 on, of each row in the order of the whole table."""
    return with_running(df, [], order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) + 1)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's rows (key, g, value) with the place in its group at which a row's equal values begin, and how many these
    are, both within the partition. Rows of one value wait until it has ended."""
    part = TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    group, seen = None, 0  # the last group, and its rows that have been passed on

    def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal group, seen
        key, g, value = rows
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (value[1:] != value[:-1])]))
        sizes = np.diff(np.append(starts, len(g)))
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        at = np.where(np.arange(len(heads)) > 0, heads, -seen if g[0] == group else 0)
        below = starts - at[np.searchsorted(heads, starts, "right") - 1]
        group, seen = g[-1], len(g) - at[-1]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(g), pa.array(value), pa.array(np.repeat(below, sizes)), pa.array(np.repeat(sizes, sizes)),
                                           pa.array(np.full(len(g), part, np.int64))], ["key", "g", "value", "below", "same", "part"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and (new[1][-1], new[2][-1]) == (held[0][1][-1], held[0][2][-1]):  # the batch goes on with the same value
            held.append(new)
            continue
        rows = [np.concatenate(c) for c in zip(*held, new)]
        end = np.flatnonzero((rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
        cut = end[-1] + 1 if len(end) else 0
        if cut:
            yield passed([c[:cut] for c in rows])
        held = [[c[cut:] for c in rows]]
    if held:
        yield passed([np.concatenate(c) for c in zip(*held)])


def with_places(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Rows key, group, below, same, n of df (whole numbers key and group, a double value, no nulls): how many rows of the group have
    a lesser value and how many the same, itself included, and the rows of the group.

    Rows are cut by ranges of (group, value, key) and written, so neither a group nor a value is one task, and no row is
    joined with the rows of its group. A row for each group in each range, and for the values at a range's ends, passes
    through the driver.
    """
    names = [F.col(key).cast("long").alias("key"), F.col(group).cast("long").alias("g"), (F.col(value) + 0.0).alias("value")]  # no zero below zero
    order = ["g", "value", "key"]
    cut = df.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = written(cut.mapInArrow(_placed, "key long, g long, value double, below long, same long, part long"), "places")
    ends = F.struct("value", "same")
    sums = laid.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"), F.min(ends).alias("low"), F.max(ends).alias("high")).collect()
    total, equal = Counter(), Counter()
    for r in sums:
        total[r["g"]] += r["n"]
        for x in {r["low"], r["high"]}:
            equal[r["g"], x["value"]] += x["same"]
    ahead, met, rows = Counter(), Counter(), []
    for r in sorted(sums, key=lambda r: r["part"]):
        g, low, high = r["g"], r["low"], r["high"]
        rows.append((r["part"], g, ahead[g], total[g], low["value"], met[g, low["value"]], equal[g, low["value"]], high["value"], equal[g, high["value"]]))
        ahead[g] += r["n"]
        for x in {low, high}:
            met[g, x["value"]] += x["same"]
    offsets = df.sparkSession.createDataFrame(rows, "part long, g long, __ahead long, n long, __low double, __met long, __low_same long, __high double, __high_same long")
    c, at_low = F.col, F.col("value") == F.col("__low")  # a range's first value may have begun before it
    out = laid.join(F.broadcast(offsets), ["part", "g"])
    return out.select(c("key").alias(key), c("g").alias(group), (c("__ahead") + c("below") - F.when(at_low, c("__met")).otherwise(0)).alias("below"),
                      F.when(at_low, c("__low_same")).when(c("value") == c("__high"), c("__high_same")).otherwise(c("same")).alias("same"), "n")


def percentiles(df: DataFrame, key: str, factors: Mapping[str, Factor]) -> DataFrame:
    """df with `<factor>_rank` for each factor column: the mid-rank percentile among all rows.

    (2 * smaller + equal - 1) / (2 * (known - 1)), 0.5 where only one is known. Ranking each factor over all rows would
    put them all into one task once a factor. Here the factors become rows, equal values combine before the shuffle, and
    the running counts over the distinct values of all factors go by ranges. A value that very many rows share is dealt over
    several tasks, and the sentinel takes no part in the join. df is read several times, so it should be a table.
    """
    names = list(factors)
    long = df.select(key, *names).unpivot([key], names, "factor", "value").filter("value IS NOT NULL")
    invalid = long.filter(F.col("value") >= SENTINEL).select(key, "factor", F.lit(0.0).alias("p"))  # needs no rank, and many share it
    ties = long.groupBy("factor", "value").agg(F.count(F.lit(1)).alias("ties"))
    placed = with_running(ties, ["factor"], [F.col("value").asc()], F.col("ties"), "smaller", "known")
    share = F.coalesce((2.0 * F.col("smaller") + F.col("ties") - 1.0) / F.nullif(2.0 * (F.col("known") - 1), F.lit(0.0)), F.lit(0.5))
    lower = [n for n, f in factors.items() if f.lower_is_better]
    flipped = F.when(F.col("factor").isin(*lower) & (F.col("known") > 1), 1.0 - share).otherwise(share) if lower else share
    scored = placed.filter(F.col("value") < SENTINEL).select("factor", "value", flipped.alias("p"))
    valid = spread_join(long.filter(F.col("value") < SENTINEL), scored, ["factor", "value"], [key]).select(key, "factor", "p")
    wide = valid.unionAll(invalid).groupBy(key).pivot("factor", names).agg(F.max("p"))
    wide = wide.select(F.col(key).alias("__key"), *(F.col(n).alias(f"__{n}") for n in names))
    return df.join(wide, df[key] == wide["__key"], "left").drop("__key").select(
        *df.columns, *(F.coalesce(F.col(f"__{n}"), F.lit(f.missing)).alias(f"{n}_rank") for n, f in factors.items()))
