"""Technical indicators as windows over one instrument's days; the exponential mean folds the ordered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import ratio


class Series:
    """Windows of one instrument, in order of the day."""

    def __init__(self, by: str, at: str) -> None:
        self.order = Window.partitionBy(by).orderBy(at)
        self.index = F.row_number().over(self.order)

    def trailing(self, n: int):
        return self.order.rowsBetween(1 - n, 0)

    def full(self, value: Column, n: int) -> Column:
        """value from the n-th row on, 0 before."""
        return F.when(self.index >= n, value).otherwise(0.0)

    def mean(self, x: Column, n: int) -> Column:
        return self.full(F.avg(x).over(self.trailing(n)), n)

    def deviation(self, x: Column, n: int) -> Column:
        return self.full(F.stddev_pop(x).over(self.trailing(n)), n)

    def slope(self, x: Column, n: int) -> Column:
        """Least squares over the last n rows; a constant shift of the row number does not matter."""
        w, i = self.trailing(n), self.index.cast("double")
        return self.full(F.regr_slope(x, i).over(w), n)

    def before(self, x: Column, n: int = 1) -> Column:
        return F.coalesce(F.lag(x, n).over(self.order), F.lit(0.0))

    def change(self, x: Column) -> Column:
        last = F.lag(x).over(self.order)
        return F.coalesce(ratio(x - last, last), F.lit(0.0))


def rsi(gain: Column, loss: Column) -> Column:
    return F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0))))


def _step(last: Column, x: Column, span: int) -> Column:
    """The next exponential mean; the first is the value itself."""
    alpha = 2.0 / (span + 1.0)
    return F.coalesce(alpha * x + (1.0 - alpha) * last, x)


def macd(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """The last line (fast less slow exponential mean) and signal (the line's own mean) of an array, folded once."""
    start = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("fast", "slow", "signal")))

    def step(s: Column, x: Column) -> Column:
        quick, late = _step(s["fast"], x, fast), _step(s["slow"], x, slow)
        return F.struct(quick.alias("fast"), late.alias("slow"), _step(s["signal"], quick - late, signal).alias("signal"))

    return F.aggregate(values, start, step, lambda s: F.struct((s["fast"] - s["slow"]).alias("macd"), s["signal"].alias("signal")))


def technical(prices: DataFrame, by: str = "company_id", at: str = "day", close: str = "close", volume: str = "volume") -> DataFrame:
    """One row an instrument: its last day, indicators and the score of five votes of 20 each."""
    s, price = Series(by, at), F.col(close)
    days = prices.select(by, at, price, F.col(volume).cast("double").alias("volume")).withColumns({
        "n": s.index, "ma20": s.mean(price, 20), "ma50": s.mean(price, 50), "last": s.before(price), "delta": price - F.coalesce(F.lag(price).over(s.order), price),
        "mean_volume": s.mean(F.col("volume"), 20), "change": s.change(price), "momentum": price - s.before(price, 10), "trend": s.slope(price, 20)})
    days = days.withColumns({"gain": s.mean(F.greatest("delta", F.lit(0.0)), 14), "loss": s.mean(F.greatest(-F.col("delta"), F.lit(0.0)), 14),
                             "volatility": s.deviation(F.col("change"), 20)})
    ends = days.groupBy(by).agg(F.max_by(F.struct(at, close, "ma20", "ma50", "last", "volume", "mean_volume", "gain", "loss", "volatility", "momentum", "trend"), "n").alias("e"),
                                F.array_sort(F.collect_list(F.struct("n", price.alias("x")))).alias("x"))
    out = ends.select(by, "e.*", macd(F.transform("x", lambda r: r["x"])).alias("m")).select("*", "m.macd", "m.signal")
    out = out.withColumn("rsi", rsi(F.col("gain"), F.col("loss")))
    votes = (F.col("ma20") > F.col("ma50"), F.col(close) > F.col("last"), F.col("volume") > F.col("mean_volume"),
             (F.col("rsi") > 30) & (F.col("rsi") < 70), F.col("macd") > F.col("signal"))
    score = sum((v.cast("int") * 20 for v in votes), F.lit(0))
    return out.select(by, at, close, "rsi", "macd", "signal", "volatility", "momentum", "trend", score.cast("double").alias("score"))
