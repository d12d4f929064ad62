"""Point-in-time backtest: month-end panel, forward returns, rank correlations, top-N portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import growth_pct, ratio, round_half
from quantloom.operators.asof import asof_join
from quantloom.operators.corporate import price_index
from quantloom.plans.registry import query
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables

LAG_DAYS = 45
STALE_DAYS = 100
TOP = 10


def month_ends(t: Tables) -> DataFrame:
    """A fixed calendar of 72 month ends."""
    return t.spark.sql("SELECT last_day(d) AS day FROM (SELECT explode(sequence(DATE'1995-07-01', DATE'2001-06-01', INTERVAL 1 MONTH)) AS d)")


def panel(t: Tables) -> DataFrame:
    """company_id, day, close at each month end (at most STALE_DAYS old), close three months on, growth of trailing profit
    among reports that were out by then, LAG_DAYS after their quarter."""
    prices = domain.market_prices(t).select("company_id", "day", "close")
    probes = domain.companies(t).select("company_id").crossJoin(F.broadcast(month_ends(t)))
    now = asof_join(probes, prices, "company_id", "day", "close", STALE_DAYS).select("company_id", "day", "close")
    ahead = probes.select("company_id", F.col("day").alias("from"), F.last_day(F.add_months("day", 3)).alias("day"))
    later = asof_join(ahead, prices, "company_id", "day", "close", STALE_DAYS).select("company_id", F.col("from").alias("day"), F.col("close").alias("later"))
    reports = domain.interim_reports(t).select("company_id", F.date_add(F.last_day(F.make_date("jyear", "jmonth", F.lit(1))), LAG_DAYS).alias("day"),
                                               growth_pct(F.col("net_profit"), F.col("net_profit_ly")).alias("factor"))
    known = asof_join(probes, reports, "company_id", "day", "factor").select("company_id", "day", "factor")
    rows = now.join(later, ["company_id", "day"]).join(known, ["company_id", "day"])
    return rows.withColumn("forward", round_half(ratio(F.col("later"), F.col("close")) - 1.0, 8)).withColumn("factor", round_half(F.col("factor"), 6))


_PANEL_SQL = f"""
calendar AS (SELECT last_day((DATE '1995-07-01' + INTERVAL (i) MONTH)::DATE) AS day FROM range(72) r(i)),
probes AS (SELECT s_suppkey AS company_id, day, last_day((day + INTERVAL 3 MONTH)::DATE) AS ahead FROM supplier CROSS JOIN calendar),
now AS (SELECT p.*, CASE WHEN date_diff('day', m.day, p.day) <= {STALE_DAYS} THEN m.close END AS close FROM probes p ASOF LEFT JOIN market m ON m.company_id = p.company_id AND m.day <= p.day),
later AS (SELECT p.*, CASE WHEN date_diff('day', m.day, p.ahead) <= {STALE_DAYS} THEN m.close END AS later FROM now p ASOF LEFT JOIN market m ON m.company_id = p.company_id AND m.day <= p.ahead),
reports AS (SELECT company_id, last_day(make_date(jyear, jmonth, 1)) + {LAG_DAYS} AS day, (net_profit - net_profit_ly) / nullif(abs(net_profit_ly), 0) * 1e2 AS factor FROM interim),
panel AS (
  SELECT p.company_id, p.day, close, later, floor(r.factor * 1e6 + 5e-1) / 1e6 AS factor, floor((later / nullif(close, 0) - 1e0) * 1e8 + 5e-1) / 1e8 AS forward
  FROM later p ASOF LEFT JOIN reports r ON r.company_id = p.company_id AND r.day <= p.day)"""


def _panel(then: str) -> str:
    return with_tables("interim", "market", then=f"-- more{_PANEL_SQL}{then}")


@query("pit_panel_factors", _panel("\nSELECT company_id, day, close, factor FROM panel"))
def pit_panel_factors(t: Tables) -> DataFrame:
    return panel(t).select("company_id", "day", "close", "factor")


@query("forward_returns", _panel("\nSELECT company_id, day, forward FROM panel WHERE forward IS NOT NULL"))
def forward_returns(t: Tables) -> DataFrame:
    return panel(t).filter("forward IS NOT NULL").select("company_id", "day", "forward")


def rank_correlation(rows: DataFrame, by: str | list[str], x: str, y: str, least: int = 6) -> DataFrame:
    """Spearman's correlation of each group: average ranks, then Pearson; null where a side does not vary."""
    by = [by] if isinstance(by, str) else by
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y).repartition(*by)  # one shuffle for all four windows
    mean_rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0)
    ranked = known.select(*by, mean_rank(x).alias("rx"), mean_rank(y).alias("ry"))
    varied = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    spread = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c))
    ic = (F.avg(F.col("rx") * F.col("ry")) - F.avg("rx") * F.avg("ry")) / F.nullif(spread("rx") * spread("ry"), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(varied, ic).alias("ic")).filter(F.col("n") >= least)


_IC_SQL = """,
ranked AS (
  SELECT day, rank() OVER (PARTITION BY day ORDER BY factor) + (count(*) OVER (PARTITION BY day, factor) - 1) / 2e0 AS rx,
         rank() OVER (PARTITION BY day ORDER BY forward) + (count(*) OVER (PARTITION BY day, forward) - 1) / 2e0 AS ry
  FROM panel WHERE factor IS NOT NULL AND forward IS NOT NULL),
ics AS (SELECT day, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM ranked GROUP BY 1 HAVING count(*) >= 6)"""


@query("spearman_ic", _panel(f"{_IC_SQL}\nSELECT day, n, floor(ic * 1e6 + 5e-1) / 1e6 AS ic FROM ics"))
def spearman_ic(t: Tables) -> DataFrame:
    return rank_correlation(panel(t), "day", "factor", "forward").select("day", "n", round_half(F.col("ic"), 6).alias("ic"))


@query("ic_summary", _panel(f"""{_IC_SQL}
SELECT count(ic) AS n, floor(avg(ic) * 1e6 + 5e-1) / 1e6 AS mean, floor(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) * 1e4 + 5e-1) / 1e4 AS t,
       floor(count(*) FILTER (ic > 0) * 1e2 / count(ic) * 1e2 + 5e-1) / 1e2 AS positive FROM ics"""))
def ic_summary(t: Tables) -> DataFrame:
    ics, ic = rank_correlation(panel(t), "day", "factor", "forward"), F.col("ic")
    return ics.agg(F.count(ic).alias("n"), round_half(F.avg(ic), 6).alias("mean"), round_half(ratio(F.avg(ic), F.stddev_samp(ic) / F.sqrt(F.count(ic))), 4).alias("t"),
                   round_half(F.count_if(ic > 0) * 100.0 / F.count(ic), 2).alias("positive"))


def top_portfolios(rows: DataFrame, top: int = TOP) -> DataFrame:
    """day, n, bench, top and excess: mean forward returns of all and of the first by factor."""
    known = rows.filter("factor IS NOT NULL AND forward IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("factor"), "company_id"))
    means = known.withColumn("rn", place).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("forward").alias("bench"), F.avg(F.when(F.col("rn") <= top, F.col("forward"))).alias("top"))
    return means.withColumn("excess", F.col("top") - F.col("bench"))


_TOP_SQL = f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY factor DESC, company_id) AS rn FROM panel WHERE factor IS NOT NULL AND forward IS NOT NULL),
tops AS (SELECT day, count(*) AS n, avg(forward) AS bench, avg(forward) FILTER (rn <= {TOP}) AS top FROM placed GROUP BY 1)"""


@query("topn_portfolio", _panel(f"{_TOP_SQL}\nSELECT day, n, floor(bench * 1e6 + 5e-1) / 1e6 AS bench, floor(top * 1e6 + 5e-1) / 1e6 AS top, floor((top - bench) * 1e6 + 5e-1) / 1e6 AS excess FROM tops"))
def topn_portfolio(t: Tables) -> DataFrame:
    df = top_portfolios(panel(t))
    return df.select("day", "n", *(round_half(F.col(c), 6).alias(c) for c in ("bench", "top", "excess")))


def compounded(series: DataFrame, value: str, every: int, per_year: float) -> DataFrame:
    """Logarithm of the total growth, and yearly rate, of every every-th return in order of the day, so that holding times don't overlap.

    The series has a row a date; it is numbered as a whole."""
    rows = series.withColumn("rn", F.row_number().over(Window.orderBy("day"))).filter((F.col("rn") - 1) % every == 0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(1.0 + F.col(value))).alias("g")).select(
        "n", round_half(F.col("g"), 6).alias("log_total"), round_half((F.exp(F.col("g") * per_year / F.col("n")) - 1.0) * 100.0, 4).alias("cagr_pct"))


@query("compound_cagr", _panel(f"""{_TOP_SQL},
kept AS (SELECT top FROM tops QUALIFY (row_number() OVER (ORDER BY day) - 1) % 3 = 0), g AS (SELECT count(*) AS n, sum(ln(1e0 + top)) AS g FROM kept)
SELECT n, floor(g * 1e6 + 5e-1) / 1e6 AS log_total, floor((exp(g * 4e0 / n) - 1e0) * 1e2 * 1e4 + 5e-1) / 1e4 AS cagr_pct FROM g"""))
def compound_cagr(t: Tables) -> DataFrame:
    return compounded(top_portfolios(panel(t)), "top", 3, 4.0)


@query("weight_config_compare", _panel(f"""{_TOP_SQL},
periods AS (SELECT * FROM (VALUES ('train', DATE '1995-01-01', DATE '1999-12-31'), ('test', DATE '2000-01-01', DATE '2002-12-31'), ('all', DATE '1995-01-01', DATE '2002-12-31')) v(period, low, high))
SELECT period, count(*) AS n, floor(avg(top - bench) * 1e6 + 5e-1) / 1e6 AS excess, floor(count(*) FILTER (top > bench) * 1e2 / count(*) * 1e2 + 5e-1) / 1e2 AS hit_rate
FROM tops JOIN periods ON day BETWEEN low AND high GROUP BY 1"""))
def weight_config_compare(t: Tables) -> DataFrame:
    """Mean excess and hit rate in overlapping periods: each row counts in all periods that hold it."""
    ends = {"train": ("1995-01-01", "1999-12-31"), "test": ("2000-01-01", "2002-12-31"), "all": ("1995-01-01", "2002-12-31")}
    named = F.filter(F.array(*[F.when(F.col("day").between(*[F.lit(x).cast("date") for x in span]), F.lit(p)) for p, span in ends.items()]), lambda p: p.isNotNull())
    rows = top_portfolios(panel(t)).withColumn("period", F.explode(named))
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"), round_half(F.avg("excess"), 6).alias("excess"),
                                      round_half(F.count_if(F.col("excess") > 0) * 100.0 / F.count(F.lit(1)), 2).alias("hit_rate"))


@query("adjusted_price_index", with_tables("market", then="""
SELECT company_id, day, floor(r * 1e8 + 5e-1) / 1e8 AS day_return, floor(sum(ln(1e0 + r)) OVER (PARTITION BY company_id ORDER BY day) * 1e6 + 5e-1) / 1e6 AS log_index
FROM (SELECT *, CASE WHEN e IS NULL OR e <= 0 THEN 0e0 WHEN first / e < 85e-2 AND first > 0 THEN close / first - 1e0 ELSE close / e - 1e0 END AS r
      FROM (SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY day) AS e FROM market))"""))
def adjusted_price_index(t: Tables) -> DataFrame:
    """Every day's return, adjusted for corporate events by the opening price, and the logarithm of their running product."""
    rows = price_index(domain.market_prices(t))
    return rows.select("company_id", "day", round_half(F.col("day_return"), 8).alias("day_return"), round_half(F.col("log_index"), 6).alias("log_index"))
