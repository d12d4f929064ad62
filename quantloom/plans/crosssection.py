"""The backtest's cross sections: sixteen factors of each company at each month end, their score, and what came of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.numeric import clip, pct_of, ratio, round_half, within
from quantloom.operators.corporate import price_index
from quantloom.operators.ranking import with_places
from quantloom.plans.backtest import LAG_DAYS, STALE_DAYS, month_ends, rank_correlation
from quantloom.plans.registry import query
from quantloom.plans.score import PROFIT_SQL, reports, tiers
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables
from quantloom.sources.store import small_methods, written

HORIZONS, TOPS = (3, 6, 12), (10, 20)
MIN_UNIVERSE, MIN_FORWARD, MIN_VALUES, MIN_DATES = 30, 20, 10, 6
#: Weights by category, bounds of the ranked values, factors of which less is better, and what a missing one ranks; fixed values.
WEIGHTS = {"growth_s": {"sg12": 9, "sg3": 4, "rg": 5, "opg": 8, "npg": 10}, "prof_s": {"om": 4, "nm": 3, "mt": 3, "ic": 3, "eq": 4},
           "val_s": {"pe": 10, "ps": 3}, "mkt_s": {"liq": 6, "stability": 3, "vol": 3, "mom": 3}}
CAPS = {"sg12": 150, "sg3": 150, "rg": 200, "opg": 250, "npg": 300, "om": 80, "nm": 60, "mt": 25, "ic": 20, "eq": 150}
LESS_IS_BETTER = ("eq", "pe", "ps", "vol")
NEUTRAL = {"ic": 0.5, "eq": 0.5, "pe": 0.0, "ps": 0.0, "liq": 0.0}
FACTORS = [n for names in WEIGHTS.values() for n in names]


@dataclass(frozen=True)
class Rule:
    """How a factor is ranked: between which bounds values differ, whether less is better, and what a missing one gets."""

    bounds: tuple[float | None, float | None] = (None, None)
    less_is_better: bool = False
    missing: float = 0.3


RULES = {f: Rule((-CAPS[f], CAPS[f]) if f in CAPS else (None, None), f in LESS_IS_BETTER, NEUTRAL.get(f, 0.3)) for f in FACTORS}


#: What is added to each price, in cents, so that days differ about as much as on an exchange with daily limits.
BASE_PRICE = 3_000_000


def steady_prices(t: Tables) -> DataFrame:
    return domain.market_prices(t, ["company_id"]).withColumns({c: F.col(c) + float(BASE_PRICE) for c in ("close", "first")})


def _month(day: Column) -> Column:
    """A day's month as one number."""
    return F.year(day) * 12 + F.month(day)


def _month_end(month: Column) -> Column:
    return F.last_day(F.make_date(F.floor((month - 1) / 12).cast("int"), (month - 1) % 12 + 1, F.lit(1)))


#: Rows over which volatility and traded value go.
RECENT = 30


def _month_rows(prices: pa.Table) -> pa.Table:
    """Of a company's rows, in any order, those of month ends, with vol and liq of RECENT rows; null where there are no more rows."""
    prices = prices.sort_by("i")
    ends = np.flatnonzero(prices["end"].to_numpy())
    out = prices.select(["company_id", "day", "close", "i", "log_index", "mom"]).take(ends)
    late = ends >= RECENT
    vol, liq = np.full(len(ends), np.nan), np.full(len(ends), np.nan)
    if late.any():
        over = lambda c: sliding_window_view(prices[c].to_numpy(), RECENT)[ends[late] - RECENT + 1]
        value = over("trade_value")
        n = np.count_nonzero(~np.isnan(value), axis=1)
        vol[late], liq[late] = over("change").std(axis=1, ddof=1), np.where(n > 0, np.nansum(value, axis=1) / np.maximum(n, 1), np.nan)
    return out.append_column("vol", pa.array(vol, mask=np.isnan(vol))).append_column("liq", pa.array(liq, mask=np.isnan(liq)))


def _prices(t: Tables) -> DataFrame:
    """company_id, day, p of the last day of each month with prices: its close, its number, the price index, and momentum, volatility
    and value of thirty rows, which are worked out for these days alone."""
    order = Window.partitionBy("company_id").orderBy("day")
    i, c = F.row_number().over(order), F.col("close")
    rows = price_index(steady_prices(t)).withColumns({"i": i, "c0": F.lag("close", RECENT).over(order), "next": F.lead("day").over(order)})
    mom = F.when((F.col("c0") > 0) & (F.col("i") > RECENT), clip((c / F.col("c0") - 1.0) * 100.0, -50, 40))
    end = F.coalesce(F.col("next").isNull() | (_month(F.col("next")) > _month(F.col("day"))), F.lit(False))
    rows = rows.select("company_id", "day", "close", "i", "log_index", mom.alias("mom"), (F.col("day_return") * 100.0).alias("change"), "trade_value", end.alias("end"))
    kept = T.StructType([*rows.drop("change", "trade_value", "end").schema.fields, *(T.StructField(n, T.DoubleType()) for n in ("vol", "liq"))])
    rows = rows.groupBy("company_id").applyInArrow(_month_rows, kept)
    return rows.select("company_id", "day", F.struct("day", "close", "i", "log_index", "mom", "vol", "liq").alias("p"))


#: What a report says itself of profits, cash and its balance sheet.
FILED = ("npa", "npa_ly", "npa_fyprev", "op_raw", "op_ly_raw", "op_fyprev", "revenue_fyprev", "cash_flow", "cash_flow_ly", "cash_flow_fyprev",
         "total_assets", "current_assets", "total_liabilities", "current_liabilities", "total_equity")


def _reports(t: Tables, filed: Iterable[str] = FILED) -> DataFrame:
    """company_id, day (of publication), r: each report with last year's and the year before's figures, and its own in filed. A company
    has a report a month, so one range of months or years finds each of them."""
    rows = reports(domain.interim_reports(t)).withColumn("k", F.col("jyear") * 12 + F.col("jmonth"))
    whole, kept = Window.partitionBy("company_id"), F.struct("p1", "op", "revenue")
    back = lambda by, n, x: F.max(x).over(whole.orderBy(by).rangeBetween(-n, -n))
    full = F.when(F.col("jmonth") == 12, kept)
    at = {"lyp": back("k", 12, kept), "fy": back("jyear", 1, full), "lyp2": back("k", 24, kept), "fy2": back("jyear", 2, full)}
    rows = rows.withColumns({"n": F.row_number().over(whole.orderBy("k")), **at})
    out = F.date_add(F.last_day(F.make_date("jyear", "jmonth", F.lit(1))), LAG_DAYS)
    return rows.select("company_id", out.alias("day"), F.struct("k", "jmonth", "n", "eps", "p1", "op", "op_ly", "revenue", "revenue_ly", "finance_costs", "other_non_op", *filed, *at).alias("r"))


def _sales(t: Tables) -> DataFrame:
    """company_id, k (year and month as one number), s: sums of the rows up to each month."""
    rows = domain.monthly_sales(t).withColumn("k", F.floor(F.col("report_key") / 100).cast("int") * 12 + F.col("report_key") % 100)
    order, v = Window.partitionBy("company_id").orderBy("k"), F.col("value3")
    over = lambda a, b: order.rowsBetween(-a, -b)
    return rows.select("company_id", "k", F.struct(
        F.row_number().over(order).alias("n"), F.sum(v).over(over(11, 0)).alias("s12"), F.sum(v).over(over(23, 12)).alias("p12"), F.sum(v).over(over(2, 0)).alias("s3"),
        F.sum(v).over(over(5, 3)).alias("p3"), F.avg(v).over(over(11, 0)).alias("mean"), F.stddev_samp(v).over(over(11, 0)).alias("sd")).alias("s"))


def _growth(now: Column, before: Column, most: float) -> Column:
    """Change against the magnitude of a value that isn't zero, in percent, null beyond `most` times it."""
    share = ratio(now - before, F.abs(before))
    return F.when(F.abs(share) <= most, share * 100.0)


def _known(t: Tables, filed: Iterable[str]) -> DataFrame:
    """company_id, day (month end), key (its month), and the latest price p, report r and sales s of that time; later3 and so on, the
    price index as many months on, null where its price is older than STALE_DAYS.

    Prices, reports and sales come one a company and month at most, and run on over the months in one shuffle; the price of a
    horizon is that of the month so many rows on.
    """
    span = month_ends(t).select(_month(F.col("day")).alias("m")).agg(F.min("m").alias("first"), F.max("m").alias("last"))
    months = span.select("last", F.explode(F.sequence("first", F.col("last") + max(HORIZONS))).alias("key"))  # a fixed list
    marks = domain.companies(t).select("company_id").distinct().crossJoin(F.broadcast(months)).withColumns({"probe": F.lit(1), "day": F.lit(None).cast("date")})
    dated = lambda df: df.withColumns({"key": _month(F.col("day")), "probe": F.lit(0)})
    sold = _sales(t).withColumnRenamed("k", "key").withColumn("probe", F.lit(0))
    rows = marks
    for seen in (dated(_prices(t)), dated(_reports(t, filed)), sold):
        rows = rows.unionByName(seen, allowMissingColumns=True)
    group = Window.partitionBy("company_id")
    so_far = group.orderBy("key", "probe", "day").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("p", "r", "s")}).filter("probe = 1")
    ahead = {f"next{h}": F.lead(F.struct("p.day", "p.log_index"), h).over(group.orderBy("key")) for h in HORIZONS}
    rows = rows.withColumns(ahead).filter("key <= last").withColumn("day", _month_end(F.col("key")))
    fresh = lambda h: F.datediff(_month_end(F.col("key") + h), F.col(f"next{h}.day")) <= STALE_DAYS
    return rows.select("company_id", "day", "key", "p", "r", "s", F.datediff("day", "p.day").alias("price_age"),
                       *(F.when(fresh(h), F.col(f"next{h}.log_index")).alias(f"later{h}") for h in HORIZONS))


def cross_sections(t: Tables, filed: Iterable[str] = ()) -> DataFrame:
    """A row a company and month end: factors, ages and counts as known on that day, and returns over three horizons.

    Reports are known LAG_DAYS after their period; a price older than STALE_DAYS at a horizon gives no return. The latest
    report itself, with the figures in filed, is in column r.
    """
    small_methods(t.spark)  # factors are one projection of hundreds of expressions
    rows = _known(t, filed).filter("p.close > 0 AND r IS NOT NULL AND s.n >= 12 AND p.i >= 30")
    c, r, s, december = F.col, (lambda x: F.col(f"r.{x}")), (lambda x: F.col(f"s.{x}")), F.col("r.jmonth") == 12
    near = lambda *xs: (F.greatest(*map(F.abs, xs)) <= 100.0 * F.least(*map(F.abs, xs))) | (F.least(*map(F.abs, xs)) == 0)
    known = lambda *xs: sum((x.isNotNull().cast("int") for x in xs), F.lit(0)) == len(xs)
    np_ok = F.coalesce(F.abs(r("fy.p1") / F.nullif(r("fy2.p1"), F.lit(0.0))).between(0.02, 50.0), ~known(r("fy.p1"), r("fy2.p1")))
    ttm_op = F.when(december, r("op")).when(near(r("fy.op"), r("op"), r("lyp.op")) & known(r("fy.op"), r("op"), r("lyp.op")), r("op") + r("fy.op") - r("lyp.op"))
    op_prev = F.when(december, r("lyp.op")).when(near(r("lyp.op"), r("fy2.op"), r("lyp2.op")) & known(r("lyp.op"), r("fy2.op"), r("lyp2.op")), r("lyp.op") + r("fy2.op") - r("lyp2.op"))
    ttm_rev = F.when(december, r("revenue")).when(
        (F.greatest(F.abs(r("revenue")), F.abs(r("fy.revenue")), F.abs(r("lyp.revenue"))) <= 100.0 * F.least(F.abs(r("revenue")), F.abs(r("fy.revenue")), F.abs(r("lyp.revenue"))))
        & known(r("revenue"), r("fy.revenue"), r("lyp.revenue")), r("revenue") + r("fy.revenue") - r("lyp.revenue"))
    whole = r("p1") + r("fy.p1") - r("lyp.p1")
    rows = rows.withColumns({
        "ttm_np": F.when(np_ok, F.when(december, r("p1")).otherwise(whole)),
        "np_prev": F.when(np_ok, F.when(december, r("fy.p1")).when(whole.isNotNull(), r("lyp.p1") + r("fy2.p1") - r("lyp2.p1"))), "ttm_op": ttm_op, "op_prev": op_prev, "ttm_rev": ttm_rev})
    share = lambda a, b: within(pct_of(a, b), -200, 200)
    cover = ratio(r("op"), F.abs(r("finance_costs")))
    eps = F.when((r("eps") > 0) & (r("p1") > 0), c("ttm_np") / (r("p1") / r("eps")))
    rows = rows.withColumns({
        "npg": _growth(c("ttm_np"), c("np_prev"), 300.0), "opg": _growth(c("ttm_op"), c("op_prev"), 250.0),
        "rg": ratio(r("revenue") - r("revenue_ly"), F.abs(r("revenue_ly"))) * 100.0,
        "sg12": F.when(s("n") >= 24, (ratio(s("s12"), s("p12")) - 1.0) * 100.0), "sg3": (ratio(s("s3"), s("p3")) - 1.0) * 100.0, "stability": 1.0 - ratio(s("sd"), F.abs(s("mean"))),
        "om": share(r("op"), r("revenue")), "nm": share(r("p1"), r("revenue")), "om_ly": share(r("op_ly"), r("revenue_ly")),
        "ic": F.when((cover > 0) & (cover <= 10000), cover), "eq": F.least(ratio(F.abs(r("other_non_op")), F.abs(r("op"))) * 100.0, F.lit(150.0)),
        "nm12": share(c("ttm_np"), c("ttm_rev")), "pe_any": F.when(eps > 0, c("p.close") / eps), "mom": c("p.mom"), "vol": c("p.vol"), "liq": c("p.liq"),
        **{f"fwd{h}": F.exp(c(f"later{h}") - c("p.log_index")) - 1.0 for h in HORIZONS}})
    rows = rows.withColumns({"eq": F.when(ratio(F.lit(1.0), F.abs(r("op"))).isNotNull() & r("other_non_op").isNotNull(), c("eq")), "mt": c("om") - c("om_ly"),
                             "pe": F.when((c("pe_any") > 0) & (c("pe_any") <= 60), c("pe_any"))})
    rows = rows.withColumn("ps", F.when(c("nm12") > 0, c("pe") * c("nm12") / 100.0)).withColumn("ps", F.when(c("ps") <= 100, c("ps")))
    return rows.select("company_id", "day", "ttm_np", *(round_half(c(f), 6).alias(f) for f in FACTORS), *(round_half(c(f"fwd{h}"), 8).alias(f"fwd{h}") for h in HORIZONS), "price_age",
                       (c("key") - r("k")).alias("report_age"), r("n").alias("n_reports"), s("n").alias("n_sales"), c("p.i").alias("n_days"), F.lit(True).alias("priced"), "r")


def ranks(rows: DataFrame, factors: Mapping[str, Rule]) -> DataFrame:
    """rows, a table with a row a company and day, with the rank of each factor among the day's companies: the mid-rank share.

    Days with fewer than MIN_UNIVERSE companies are left out. Places are counted by ranges of (day and factor, value, company), so a
    value that many companies share is several tasks, and go back to their rows in one shuffle.
    """
    c = F.col
    many = rows.groupBy("day").agg(F.count(F.lit(1)).alias("__many")).filter(c("__many") >= MIN_UNIVERSE)
    rows = rows.join(F.broadcast(many.drop("__many")), "day")  # a row a day
    values = F.posexplode(F.array(*(clip(c(f), *rule.bounds) for f, rule in factors.items()))).alias("f", "value")
    long = rows.select("company_id", F.unix_date("day").alias("d"), values).filter("value IS NOT NULL")
    placed = with_places(long.select("company_id", (c("d") * len(factors) + c("f")).alias("g"), "value"), "g", "value", "company_id")
    p = (2.0 * c("below") + c("same") - 1.0) / F.nullif(2.0 * (c("n") - 1.0), F.lit(0.0))
    f = F.pmod("g", F.lit(len(factors)))
    lower = [i for i, rule in enumerate(factors.values()) if rule.less_is_better]
    rank = F.when(c("n") == 1, 0.5).otherwise(F.when(f.isin(*lower), 1.0 - p).otherwise(p))
    # dealt before they are put together: ranks of a company and day lie far apart, so there is nothing to combine
    dealt = placed.select("company_id", F.date_from_unix_date(F.floor(c("g") / len(factors)).cast("int")).alias("day"), f.alias("f"), rank.alias("rank")).repartition("company_id", "day")
    wide = dealt.groupBy("company_id", "day").agg(*(F.max(F.when(c("f") == i, c("rank"))).alias(f"r_{name}") for i, name in enumerate(factors)))
    return rows.join(wide, ["company_id", "day"], "left").withColumns({f"r_{f}": F.coalesce(f"r_{f}", F.lit(rule.missing)) for f, rule in factors.items()})


def penalties(stale: Column) -> dict[str, Column]:
    """What each part of the score loses; old prices and reports count where stale."""
    c = F.col
    flag = lambda x, worth: F.coalesce(F.when(x, worth), F.lit(0.0))
    ramp = F.coalesce(clip((c("eq") - 20.0) / 80.0, 0.0, 1.0) * 8.0, F.lit(0.0))
    return {"growth_s": flag(clip(c("sg12"), -150, 150) < -20, 6.0) + flag(clip(c("opg"), -250, 250) < -25, 5.0),
            "prof_s": flag(c("ttm_np") < 0, 10.0) + flag(c("ic") < 1.5, 4.0) + flag(clip(c("mt"), -25, 25) < -2, 3.0) + ramp,
            "val_s": F.when(c("pe").isNull(), 8.0).otherwise(0.0),
            "mkt_s": F.when(stale, flag(c("price_age") > 14, 4.0) + flag(c("report_age") > 8, 3.0)).otherwise(0.0)}


def with_quality(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumn("dq", tiers(c("n_sales"), (24, 0.28), (12, 0.16), (6, 0.09)) + tiers(c("n_reports"), (16, 0.28), (8, 0.16), (4, 0.09))
                           + tiers(c("n_days"), (90, 0.21), (30, 0.13), (10, 0.06)) + F.when(c("priced"), 0.09).otherwise(0.0)
                           + tiers(c("report_age"), (5, 0.08), (8, 0.045), at_most=True) + tiers(c("price_age"), (7, 0.06), (14, 0.035), at_most=True))


def part_scores(ranked: DataFrame, weight: Callable[[str], Column], stale: Column, parts: Mapping[str, Iterable[str]]) -> DataFrame:
    """ranked with four parts of the score and the score: weighted ranks less penalties, none below zero, times data quality."""
    lost = penalties(stale)
    rows = ranked.withColumns({name: F.greatest(sum((F.col(f"r_{f}") * weight(f) for f in names), F.lit(0.0)) - lost[name], F.lit(0.0)) for name, names in parts.items()})
    return rows.withColumn("score", round_half(F.col("dq") * sum((F.col(name) for name in parts), F.lit(0.0)), 6))


def scored(rows: DataFrame) -> DataFrame:
    """rows, a table, with the ranks, four parts of the score, its data quality and the score by the fixed weights."""
    fixed = {f: w for ws in WEIGHTS.values() for f, w in ws.items()}
    return part_scores(with_quality(ranks(rows, RULES)), lambda f: F.lit(float(fixed[f])), F.lit(True), WEIGHTS)


def portfolios(rows: DataFrame) -> DataFrame:
    """day, h, n, bench, and of the first ten and twenty by score the mean return and what it is over all: days with at least
    MIN_UNIVERSE returns over a horizon."""
    rows = written(rows.select("day", "company_id", "score", *(f"fwd{h}" for h in HORIZONS)), "scores")
    long = rows.select("day", "company_id", "score", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"fwd{h}").alias("fwd")) for h in HORIZONS))).alias("f"))
    long = long.select("day", "company_id", "score", "f.h", "f.fwd").filter("fwd IS NOT NULL")
    means = long.groupBy("day", "h").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("bench"))
    place = F.row_number().over(Window.partitionBy("day", "h").orderBy(F.desc("score"), "company_id"))
    first = long.withColumn("rn", place).filter(F.col("rn") <= max(TOPS))  # each task passes on no more than these
    means = means.join(first.groupBy("day", "h").agg(*(F.avg(F.when(F.col("rn") <= k, F.col("fwd"))).alias(f"top{k}") for k in TOPS)), ["day", "h"])
    means = means.filter(F.col("n") >= MIN_UNIVERSE)
    return means.withColumns({f"top{k}_excess": F.col(f"top{k}") - F.col("bench") for k in TOPS})


def _section(t: Tables) -> DataFrame:
    return written(cross_sections(t).drop("r"), "cross-sections")


_SERIES = (*FACTORS, *WEIGHTS, "dq", "score")


# ---- the same in SQL ----------------------------------------------------------------------------------------------
def _r(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits}e0 + 5e-1) / {10**digits}e0"


def _near(*xs: str) -> str:
    low, high = f"least({', '.join(f'abs({x})' for x in xs)})", f"greatest({', '.join(f'abs({x})' for x in xs)})"
    return f"({' AND '.join(f'{x} IS NOT NULL' for x in xs)} AND ({high} <= 1e2 * {low} OR {low} = 0))"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {a} / nullif(abs({b}), 0) * 1e2 BETWEEN -200 AND 200 THEN {a} / nullif(abs({b}), 0) * 1e2 END"


def _cap(f: str) -> str:
    return f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, -{CAPS[f]}e0), {CAPS[f]}e0) END" if f in CAPS else f


def _step(x: str, sign: str, *steps) -> str:
    return "CASE " + " ".join(f"WHEN {x} {sign} {b} THEN {w}e0" for b, w in steps) + " ELSE 0e0 END"


def _ranked(f: str) -> str:
    n = f"count(k_{f}) OVER (PARTITION BY day)"
    p = f"(2e0 * (rank() OVER (PARTITION BY day ORDER BY k_{f} NULLS LAST) - 1) + count(*) OVER (PARTITION BY day, k_{f}) - 1e0) / nullif(2e0 * ({n} - 1e0), 0)"
    return f"CASE WHEN k_{f} IS NULL THEN {NEUTRAL.get(f, 0.3)}e0 WHEN {n} = 1 THEN 5e-1 ELSE {'1e0 - ' if f in LESS_IS_BETTER else ''}{p} END AS r_{f}"


_PEN = {"growth_s": "CASE WHEN sg12 < -20 THEN 6e0 ELSE 0e0 END + CASE WHEN opg < -25 THEN 5e0 ELSE 0e0 END",
        "prof_s": "CASE WHEN ttm_np < 0 THEN 10e0 ELSE 0e0 END + CASE WHEN ic < 1.5 THEN 4e0 ELSE 0e0 END + CASE WHEN mt < -2 THEN 3e0 ELSE 0e0 END"
                  " + coalesce(least(greatest((eq - 2e1) / 8e1, 0e0), 1e0) * 8e0, 0e0)",
        "val_s": "CASE WHEN pe IS NULL THEN 8e0 ELSE 0e0 END", "mkt_s": "CASE WHEN price_age > 14 THEN 4e0 ELSE 0e0 END + CASE WHEN report_age > 8 THEN 3e0 ELSE 0e0 END"}
_SECTION_SQL = f"""
calendar AS (SELECT last_day((DATE '1995-07-01' + INTERVAL (i) MONTH)::DATE) AS day FROM range(72) r(i)),
steady AS (SELECT company_id, day, close + {BASE_PRICE}e0 AS close, first + {BASE_PRICE}e0 AS first, trade_value FROM market),
indexed AS (
  SELECT *, sum(ln(1e0 + dr)) OVER d AS log_index, row_number() OVER d AS i, lag(close, 30) OVER d AS c0
  FROM (SELECT *, CASE WHEN e IS NULL OR e <= 0 THEN 0e0 WHEN first / e < 85e-2 AND first > 0 THEN close / first - 1e0 ELSE close / e - 1e0 END AS dr
        FROM (SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY day) AS e FROM steady)) WINDOW d AS (PARTITION BY company_id ORDER BY day)),
quotes AS (
  SELECT company_id, day, close, i, log_index, CASE WHEN i >= 31 AND c0 > 0 THEN least(greatest((close / c0 - 1e0) * 1e2, -5e1), 4e1) END AS mom,
         CASE WHEN i >= 31 THEN stddev_samp(dr * 1e2) OVER w END AS vol, CASE WHEN i >= 31 THEN avg(trade_value) OVER w END AS liq
  FROM indexed WINDOW w AS (PARTITION BY company_id ORDER BY day ROWS 29 PRECEDING)),
published AS (
  SELECT a.*, a.jyear * 12 + a.jmonth AS k, row_number() OVER (PARTITION BY a.company_id ORDER BY a.jyear, a.jmonth) AS n, last_day(make_date(a.jyear, a.jmonth, 1)) + {LAG_DAYS} AS pub,
         {", ".join(f"{x}.{c} AS {n}_{c}" for x, n in (("b", "lyp"), ("f", "fy"), ("d", "lyp2"), ("e", "fy2")) for c in ("p1", "op", "revenue"))}
  FROM clean a LEFT JOIN clean b ON b.company_id = a.company_id AND b.jyear = a.jyear - 1 AND b.jmonth = a.jmonth LEFT JOIN clean f ON f.company_id = a.company_id AND f.jyear = a.jyear - 1 AND f.jmonth = 12
               LEFT JOIN clean d ON d.company_id = a.company_id AND d.jyear = a.jyear - 2 AND d.jmonth = a.jmonth LEFT JOIN clean e ON e.company_id = a.company_id AND e.jyear = a.jyear - 2 AND e.jmonth = 12),
sold AS (
  SELECT company_id, report_key // 100 * 12 + report_key % 100 AS k, row_number() OVER d AS n, sum(value3) OVER (d ROWS 11 PRECEDING) AS s12,
         sum(value3) OVER (d ROWS BETWEEN 23 PRECEDING AND 12 PRECEDING) AS p12, sum(value3) OVER (d ROWS 2 PRECEDING) AS s3,
         sum(value3) OVER (d ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS p3, avg(value3) OVER (d ROWS 11 PRECEDING) AS mean, stddev_samp(value3) OVER (d ROWS 11 PRECEDING) AS sd
  FROM monthly WINDOW d AS (PARTITION BY company_id ORDER BY report_key)),
probes AS (SELECT s_suppkey AS company_id, day, year(day) * 12 + month(day) AS key, {", ".join(f"last_day((day + INTERVAL {h} MONTH)::DATE) AS day{h}" for h in HORIZONS)} FROM supplier CROSS JOIN calendar),
q0 AS (SELECT p.*, q.close, q.i, q.log_index, q.mom, q.vol, q.liq, date_diff('day', q.day, p.day) AS price_age FROM probes p ASOF LEFT JOIN quotes q ON q.company_id = p.company_id AND q.day <= p.day),
q3 AS (SELECT p.*, CASE WHEN date_diff('day', q.day, p.day3) <= {STALE_DAYS} THEN q.log_index END AS later3 FROM q0 p ASOF LEFT JOIN quotes q ON q.company_id = p.company_id AND q.day <= p.day3),
q6 AS (SELECT p.*, CASE WHEN date_diff('day', q.day, p.day6) <= {STALE_DAYS} THEN q.log_index END AS later6 FROM q3 p ASOF LEFT JOIN quotes q ON q.company_id = p.company_id AND q.day <= p.day6),
q12 AS (SELECT p.*, CASE WHEN date_diff('day', q.day, p.day12) <= {STALE_DAYS} THEN q.log_index END AS later12 FROM q6 p ASOF LEFT JOIN quotes q ON q.company_id = p.company_id AND q.day <= p.day12),
with_report AS (SELECT p.*, r.* EXCLUDE (company_id) RENAME (n AS n_reports) FROM q12 p ASOF JOIN published r ON r.company_id = p.company_id AND r.pub <= p.day WHERE close > 0),
known AS (
  SELECT p.*, s.n AS n_sales, s12, p12, s3, p3, mean, sd FROM with_report p ASOF JOIN sold s ON s.company_id = p.company_id AND s.k <= p.key),
sums AS (
  SELECT *, coalesce(abs(fy_p1 / nullif(fy2_p1, 0)) BETWEEN 2e-2 AND 5e1, fy_p1 IS NULL OR fy2_p1 IS NULL) AS np_ok,
         CASE WHEN jmonth = 12 THEN op WHEN {_near("fy_op", "op", "lyp_op")} THEN op + fy_op - lyp_op END AS ttm_op,
         CASE WHEN jmonth = 12 THEN lyp_op WHEN {_near("lyp_op", "fy2_op", "lyp2_op")} THEN lyp_op + fy2_op - lyp2_op END AS op_prev,
         CASE WHEN jmonth = 12 THEN revenue WHEN greatest(abs(revenue), abs(fy_revenue), abs(lyp_revenue)) <= 1e2 * least(abs(revenue), abs(fy_revenue), abs(lyp_revenue))
              AND revenue IS NOT NULL AND fy_revenue IS NOT NULL AND lyp_revenue IS NOT NULL THEN revenue + fy_revenue - lyp_revenue END AS ttm_rev
  FROM known WHERE n_sales >= 12 AND i >= 30),
ttm AS (
  SELECT *, CASE WHEN np_ok THEN CASE WHEN jmonth = 12 THEN p1 ELSE p1 + fy_p1 - lyp_p1 END END AS ttm_np,
         CASE WHEN np_ok THEN CASE WHEN jmonth = 12 THEN fy_p1 WHEN p1 + fy_p1 - lyp_p1 IS NOT NULL THEN lyp_p1 + fy2_p1 - lyp2_p1 END END AS np_prev FROM sums),
raw AS (
  SELECT *, CASE WHEN abs((ttm_np - np_prev) / nullif(abs(np_prev), 0)) <= 300 THEN (ttm_np - np_prev) / nullif(abs(np_prev), 0) * 1e2 END AS npg,
         CASE WHEN abs((ttm_op - op_prev) / nullif(abs(op_prev), 0)) <= 250 THEN (ttm_op - op_prev) / nullif(abs(op_prev), 0) * 1e2 END AS opg,
         (revenue - revenue_ly) / nullif(abs(revenue_ly), 0) * 1e2 AS rg, CASE WHEN n_sales >= 24 THEN (s12 / nullif(p12, 0) - 1e0) * 1e2 END AS sg12,
         (s3 / nullif(p3, 0) - 1e0) * 1e2 AS sg3, 1e0 - sd / nullif(abs(mean), 0) AS stability,
         {_share("op", "revenue")} AS om, {_share("p1", "revenue")} AS nm, {_share("op", "revenue")} - {_share("op_ly", "revenue_ly")} AS mt,
         CASE WHEN op / nullif(abs(finance_costs), 0) > 0 AND op / nullif(abs(finance_costs), 0) <= 10000 THEN op / nullif(abs(finance_costs), 0) END AS ic,
         CASE WHEN abs(op) > 0 AND other_non_op IS NOT NULL THEN least(abs(other_non_op) / abs(op) * 1e2, 150e0) END AS eq,
         {_share("ttm_np", "ttm_rev")} AS nm12, CASE WHEN eps > 0 AND p1 > 0 AND ttm_np / (p1 / eps) > 0 THEN close / (ttm_np / (p1 / eps)) END AS pe_any,
         {", ".join(f"exp(later{h} - log_index) - 1e0 AS fwd{h}" for h in HORIZONS)}
  FROM ttm),
valued AS (SELECT *, CASE WHEN pe_any > 0 AND pe_any <= 60 THEN pe_any END AS pe FROM raw),
priced AS (SELECT *, CASE WHEN nm12 > 0 AND pe * nm12 / 1e2 <= 100 THEN pe * nm12 / 1e2 END AS ps FROM valued),
section AS (
  SELECT company_id, day, ttm_np, {", ".join(f"{_r(f, 6)} AS {f}" for f in FACTORS)}, {", ".join(f"{_r(f'fwd{h}', 8)} AS fwd{h}" for h in HORIZONS)}, price_age, key - k AS report_age,
         n_reports, n_sales, i AS n_days FROM priced)"""
_SCORED_SQL = f"""{_SECTION_SQL},
held AS (SELECT *, {", ".join(f"{_cap(f)} AS k_{f}" for f in FACTORS)} FROM section QUALIFY count(*) OVER (PARTITION BY day) >= {MIN_UNIVERSE}),
ranks AS (SELECT *, {", ".join(map(_ranked, FACTORS))} FROM held),
parts AS (
  SELECT *, {", ".join(f"greatest(0e0 + {' + '.join(f'r_{f} * {w}e0' for f, w in ws.items())} - ({_PEN[name]}), 0e0) AS {name}" for name, ws in WEIGHTS.items())},
         {_step("n_sales", ">=", (24, .28), (12, .16), (6, .09))} + {_step("n_reports", ">=", (16, .28), (8, .16), (4, .09))} + {_step("n_days", ">=", (90, .21), (30, .13), (10, .06))}
         + 9e-2 + {_step("report_age", "<=", (5, .08), (8, .045))} + {_step("price_age", "<=", (7, .06), (14, .035))} AS dq FROM ranks),
scored AS (SELECT *, {_r("dq * (0e0 + " + " + ".join(WEIGHTS) + ")", 6)} AS score FROM parts)"""
_PORTFOLIO_SQL = f"""{_SCORED_SQL},
long AS ({" UNION ALL ".join(f"SELECT day, company_id, score, {h} AS h, fwd{h} AS fwd FROM scored WHERE fwd{h} IS NOT NULL" for h in HORIZONS)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY day, h ORDER BY score DESC, company_id) AS rn FROM long),
books AS (SELECT day, h, count(*) AS n, avg(fwd) AS bench, {", ".join(f"avg(fwd) FILTER (rn <= {k}) AS top{k}" for k in TOPS)} FROM placed GROUP BY 1, 2 HAVING count(*) >= {MIN_UNIVERSE})"""


def _sql(then: str) -> str:
    clean = PROFIT_SQL[: PROFIT_SQL.index(",\nlatest AS")]
    return with_tables("monthly", "interim", "market", then=f"-- more{clean},{then}")


@query("backtest_factors", _sql(f"{_SECTION_SQL}\nSELECT company_id, day, {', '.join(f'{_r(f, 4)} AS {f}' for f in FACTORS)}, {', '.join(f'{_r(f'fwd{h}', 6)} AS fwd{h}' for h in HORIZONS)} FROM section"))
def backtest_factors(t: Tables) -> DataFrame:
    rows = cross_sections(t)
    return rows.select("company_id", "day", *(round_half(F.col(f), 4).alias(f) for f in FACTORS), *(round_half(F.col(f"fwd{h}"), 6).alias(f"fwd{h}") for h in HORIZONS))


_SHOWN = (*WEIGHTS, "dq", "score")


@query("backtest_scores", _sql(f"{_SCORED_SQL}\nSELECT company_id, day, {', '.join(f'{_r(c, 4)} AS {c}' for c in _SHOWN)} FROM scored"))
def backtest_scores(t: Tables) -> DataFrame:
    return scored(_section(t)).select("company_id", "day", *(round_half(F.col(c), 4).alias(c) for c in _SHOWN))


_BOOK = ("bench", *(f"top{k}" for k in TOPS))


@query("backtest_portfolios", _sql(f"""{_PORTFOLIO_SQL}
SELECT day, h, n, {", ".join(f"{_r(c, 6)} AS {c}" for c in _BOOK)}, {", ".join(f"{_r(f'top{k} - bench', 6)} AS top{k}_excess" for k in TOPS)} FROM books"""))
def backtest_portfolios(t: Tables) -> DataFrame:
    rows = portfolios(scored(_section(t)))
    return rows.select("day", "h", "n", *(round_half(F.col(c), 6).alias(c) for c in (*_BOOK, *(f"top{k}_excess" for k in TOPS))))


@query("backtest_summary", _sql(f"""{_PORTFOLIO_SQL},
wide AS (SELECT day, h, bench, unnest([{", ".join(map(str, TOPS))}]) AS top, unnest([{", ".join(f"top{k}" for k in TOPS)}]) AS ret FROM books),
numbered AS (SELECT *, row_number() OVER (PARTITION BY h, top ORDER BY day) - 1 AS i FROM wide)
SELECT h, top, count(*) AS n, {_r("avg(ret)", 6)} AS mean_return, {_r("avg(ret - bench)", 6)} AS mean_excess, {_r("count(*) FILTER (ret > bench) * 1e2 / count(*)", 2)} AS hit_rate,
       {_r("sum(ln(1e0 + ret)) FILTER (i % h = 0)", 4)} AS log_total, {_r("(exp(sum(ln(1e0 + ret)) FILTER (i % h = 0) * 12e0 / (h * count(*) FILTER (i % h = 0))) - 1e0) * 1e2", 3)} AS cagr_pct
FROM numbered GROUP BY 1, 2"""))
def backtest_summary(t: Tables) -> DataFrame:
    return book_summary(portfolios(scored(_section(t))))


def book_summary(rows: DataFrame) -> DataFrame:
    """Of each horizon and size: mean return and excess, share of dates above all companies, and the yearly rate of every h-th
    date, so that holding times don't overlap."""
    rows = rows.select("day", "h", "bench", F.explode(F.array(*(F.struct(F.lit(k).alias("top"), F.col(f"top{k}").alias("ret")) for k in TOPS))).alias("x")).select("day", "h", "bench", "x.top", "x.ret")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("h", "top").orderBy("day")) - 1)
    kept = F.col("i") % F.col("h") == 0
    grown = F.sum(F.when(kept, F.log(1.0 + F.col("ret"))))
    out = rows.groupBy("h", "top").agg(
        F.count(F.lit(1)).alias("n"), round_half(F.avg("ret"), 6).alias("mean_return"), round_half(F.avg(F.col("ret") - F.col("bench")), 6).alias("mean_excess"),
        round_half(F.count_if(F.col("ret") > F.col("bench")) * 100.0 / F.count(F.lit(1)), 2).alias("hit_rate"), grown.alias("g"), F.count_if(kept).alias("m"))
    return out.select("h", "top", "n", "mean_return", "mean_excess", "hit_rate", round_half(F.col("g"), 4).alias("log_total"),
                      round_half((F.exp(F.col("g") * 12.0 / (F.col("h") * F.col("m"))) - 1.0) * 100.0, 3).alias("cagr_pct"))


@query("backtest_ic", _sql(f"""{_SCORED_SQL},
series AS ({" UNION ALL ".join(f"SELECT day, '{c}' AS series, {_r(c, 6)} AS x, fwd3 AS y FROM scored" for c in _SERIES)}),
enough AS (SELECT * FROM series QUALIFY count(y) OVER (PARTITION BY day, series) >= {MIN_FORWARD}),
placed AS (
  SELECT day, series, rank() OVER (PARTITION BY day, series ORDER BY x) + (count(*) OVER (PARTITION BY day, series, x) - 1) / 2e0 AS rx,
         rank() OVER (PARTITION BY day, series ORDER BY y) + (count(*) OVER (PARTITION BY day, series, y) - 1) / 2e0 AS ry FROM enough WHERE x IS NOT NULL AND y IS NOT NULL),
ics AS (SELECT day, series, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM placed GROUP BY 1, 2 HAVING count(*) >= {MIN_VALUES})
SELECT series, count(ic) AS n, {_r("avg(ic)", 5)} AS mean, {_r("avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0)", 3)} AS t, {_r("count(*) FILTER (ic > 1e-9) * 1e2 / count(ic)", 2)} AS positive
FROM ics GROUP BY 1 HAVING count(ic) >= {MIN_DATES}"""))
def backtest_ic(t: Tables) -> DataFrame:
    return mean_correlations(scored(_section(t)))


def mean_correlations(rows: DataFrame) -> DataFrame:
    """The mean rank correlation of each factor, part and the score with the return of three months, its t value and how often it
    is positive."""
    names = F.array(*map(F.lit, _SERIES))
    values = F.posexplode(F.array(*(round_half(F.col(c), 6) for c in _SERIES))).alias("k", "x")
    # days of few returns are left out, whatever a series holds
    enough = F.broadcast(rows.groupBy("day").agg(F.count("fwd3").alias("__n")).filter(F.col("__n") >= MIN_FORWARD).select("day"))
    long = rows.join(enough, "day").filter("fwd3 IS NOT NULL").select("day", F.col("fwd3").alias("y"), values)
    ic = F.col("ic")
    ics = rank_correlation(long, ["day", "k"], "x", "y", MIN_VALUES).withColumn("series", names[F.col("k")])
    out = ics.groupBy("series").agg(F.count(ic).alias("n"), round_half(F.avg(ic), 5).alias("mean"), round_half(ratio(F.avg(ic), F.stddev_samp(ic) / F.sqrt(F.count(ic))), 3).alias("t"),
                                    round_half(F.count_if(ic > 1e-9) * 100.0 / F.count(ic), 2).alias("positive"))
    return out.filter(F.col("n") >= MIN_DATES)
