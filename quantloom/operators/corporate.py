"""Corporate events in price series, and prices adjusted back for them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.numeric import ratio

PRICES = ("close", "last", "first", "high", "low", "yesterday")


def _order() -> Window:
    return Window.partitionBy("company_id").orderBy("day")


def is_event(change_pct: Column, days: Column, threshold_pct: float = 12.0, limit_pct: float = 6.0, most: int = 6) -> Column:
    """Whether a change, up or down, is beyond the threshold and beyond what daily limits allow over the gap: five trading
    days in seven, whole ones, and one more; the allowance grows up to `most` days."""
    gap = F.when(days > 0, F.least(F.lit(most), F.floor(days * 5 / F.lit(7.0)) + 1)).otherwise(1)
    allowed = (F.pow(F.lit(1.0 + limit_pct / 100.0), gap) - 1.0) * 100.0
    return F.abs(change_pct) > F.greatest(allowed, F.lit(abs(threshold_pct)))


def find_events(prices: DataFrame, threshold_pct: float = 12.0, last: int | None = None) -> DataFrame:
    """company_id, day, change_pct, factor of the days that are events against the row before; with last, among the latest
    `last` rows of each company. A row whose close is null, or follows a close that is null or not above zero, is none."""
    order = _order()
    days = prices.withColumns({"before": F.lag("close").over(order), "gap": F.datediff("day", F.lag("day").over(order))})
    if last:
        days = days.withColumn("back", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("day")))).filter(F.col("back") <= last)
    change = (F.col("close") - F.col("before")) / F.col("before") * 100.0
    return days.filter(F.col("before") > 0).withColumn("change_pct", change).filter(is_event(F.col("change_pct"), F.col("gap"), threshold_pct)).select(
        "company_id", "day", "change_pct", (F.col("close") / F.col("before")).alias("factor"))


def back_adjust(prices: DataFrame, threshold_pct: float = 12.0, least_effect: float = 0.02, columns: Sequence[str] = PRICES) -> DataFrame:
    """prices with each of columns times the factors of all later events, from the oldest on, rounded half to even each
    time; yesterday is then the adjusted close of the row before.

    An event with a close of zero has no factor, and one that changes prices by less than least_effect is none. Values that
    are null or not above zero stay. A value is rounded after each factor, so factors can't be put together: an instrument's
    events go over the rows before them as arrays, one after another.
    """
    order = _order()
    before = F.lag("close").over(order)
    factor = F.col("close") / before
    event = is_event((F.col("close") - before) / before * 100.0, F.datediff("day", F.lag("day").over(order)), threshold_pct)
    real = F.when((before > 0) & (F.col("close") > 0) & event & (F.abs(factor - 1.0) >= least_effect), factor)
    names = list(columns)
    kept = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in names else f.dataType) for f in prices.schema.fields])
    rows = prices.withColumns({c: F.col(c).cast("double") for c in names} | {"__factor": real})

    def adjusted(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("day", "ascending")], null_placement="at_start"))
        factors = table["__factor"].to_numpy()
        table = table.drop_columns(["__factor"])
        events = np.flatnonzero(~np.isnan(factors))
        if not len(events):
            return table
        was = np.stack([table[c].to_numpy() for c in names])
        positive = (was > 0) | np.isnan(was)
        now = np.where(positive, was, 0.0)
        for e in events.tolist():
            head = now[:, :e]
            head *= factors[e]
            np.rint(head, out=head)
        now = np.where(positive, now, was)
        missing = {c: table[c].is_null().to_numpy() for c in names}
        if "yesterday" in names:
            own, k = table["close"].to_numpy(), names.index("yesterday")
            close, none = (now[names.index("close")], missing["close"]) if "close" in names else (own, table["close"].is_null().to_numpy())
            last, known = np.append(np.nan, close[:-1]), np.append(False, ~none[:-1])
            last_fine = known & ((last > 0) | np.isnan(last))
            now[k] = np.where(none, now[k], last)
            missing["yesterday"] = np.where(none, missing["yesterday"], ~last_fine)
        for c, x in zip(names, now):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(x, pa.float64(), mask=missing[c]))
        return table

    return rows.groupBy("company_id").applyInArrow(adjusted, kept)


def yesterday(prices: DataFrame, value: str = "close") -> DataFrame:
    """prices with the value of the day before and the change in percent; null starts anew."""
    before = F.lag(value).over(_order())
    return prices.withColumn("yesterday", before).withColumn("change_pct", ratio(F.col(value) - before, before) * 100.0)


def price_index(prices: DataFrame) -> DataFrame:
    """prices with log_index, the logarithm of the running product of daily returns, every day included.

    Where a day opens at less than 85 % of the last close, a corporate event, its return is from the opening price on;
    a fall of over 15 % without an opening price counts as no change. The first day, and days after a close that is not
    above zero, count as no change too.
    """
    before = F.lag("close").over(_order())
    opened = F.when(before > 0, F.col("first") / before)
    raw = F.when(before > 0, F.col("close") / before - 1.0).otherwise(0.0)
    own = F.when((opened < 0.85) & (F.col("first") > 0), F.col("close") / F.col("first") - 1.0).when(opened.isNull() & (raw < -0.15), 0.0).otherwise(raw)
    rows = prices.withColumn("day_return", F.coalesce(F.when(F.abs(own) < float("inf"), own), F.lit(0.0)))
    step = F.when(F.col("day_return") > -1.0, F.log(1.0 + F.col("day_return"))).otherwise(float("-inf"))
    return rows.withColumn("log_index", F.sum(step).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
