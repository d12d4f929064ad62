"""Weights against weights: scores of several configurations from one ranking, with and without what a balance sheet adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import ratio, round_half, within
from quantloom.plans.backtest import rank_correlation
from quantloom.plans.crosssection import _PEN, _SECTION_SQL, FILED, MIN_FORWARD, MIN_UNIVERSE, RULES, Rule, _cap, _r, _sql, _step, cross_sections, part_scores, ranks, with_quality
from quantloom.plans.registry import query
from quantloom.sources.domain import Tables
from quantloom.sources.store import written

#: Weights of each configuration and whether old prices and reports cost points; fixed values.
CONFIGS = {
    "old": ({"sg12": 9, "sg3": 4, "rg": 5, "opg": 8, "npg": 10, "om": 4, "nm": 3, "mt": 3, "ic": 3, "eq": 4,
             "pe": 10, "ps": 3, "liq": 6, "stability": 3, "vol": 3, "mom": 3}, True),
    "new": ({"sg12": 10, "sg3": 6, "rg": 5, "opg": 5, "npg": 10, "om": 4, "nm": 3, "mt": 3, "ic": 3, "eq": 4,
             "pe": 11, "ps": 3, "liq": 6, "stability": 1, "vol": 5, "mom": 1}, False),
    "plain": ({"sg12": 10, "sg3": 6, "rg": 5, "opg": 5, "npg": 10, "om": 4, "nm": 4, "mt": 3, "ic": 3, "eq": 4,
               "pe": 11, "ps": 3, "liq": 6, "stability": 1, "vol": 5, "mom": 1}, False),
    "balance": ({"sg12": 10, "sg3": 6, "rg": 5, "opg": 5, "npg": 10, "om": 4, "nm": 4, "mt": 3, "ic": 3, "eq": 4, "roe": 6, "cc": 2,
                 "pe": 11, "ps": 3, "pb": 2, "liq": 6, "stability": 1, "vol": 5, "mom": 1, "lev": 2, "cr": 2}, False),
}
PARTS = {"growth_s": ("sg12", "sg3", "rg", "opg", "npg"), "prof_s": ("om", "nm", "mt", "ic", "eq", "roe", "cc"),
         "val_s": ("pe", "ps", "pb"), "mkt_s": ("liq", "stability", "vol", "mom", "lev", "cr")}
BALANCE_RULES = {"roe": Rule(), "cc": Rule(), "lev": Rule(less_is_better=True), "cr": Rule(), "pb": Rule(less_is_better=True, missing=0.0)}
FACTORS = [f for names in PARTS.values() for f in names]
#: Factors that a company's own report gives, fixed list: with balance sheet, twelve-month margins, and three of the others.
REPORTED = ("roe", "lev", "cr", "cc", "pb", "om12", "nm12")
REPORTED_SERIES = (*REPORTED, "ic", "eq", "ps")
HORIZONS, TOPS, REPORTED_TOP = (3, 6), (10, 20), 5
#: Dates count with so many companies where all factors of a report are asked for.
MIN_CROSS = 6
PERIODS = {"train": (1995, 1999), "test": (2000, 2001), "all": (1995, 2001)}


def configurations(spark) -> DataFrame:
    """A row a configuration and factor: config, stale, factor, weight."""
    return spark.createDataFrame([(name, stale, f, float(weights.get(f, 0))) for name, (weights, stale) in CONFIGS.items() for f in FACTORS],
                                 "config string, stale boolean, factor string, weight double")


def with_balance(rows: DataFrame) -> DataFrame:
    """rows of cross sections with return on equity, leverage, current ratio, cash conversion, price to book, and the margins of
    twelve months, from the latest report's own columns; each null where a part is missing or it is out of bounds."""
    c, r = F.col, (lambda x: F.col(f"r.{x}"))
    known = lambda *xs: sum((x.isNotNull().cast("int") for x in xs), F.lit(0)) == len(xs)

    def year(now: str, before: str, last: str):
        months = F.when(r("jmonth") == 12, r(now)).otherwise(r(now) + r(before) - r(last))
        return F.when(known(r(now), r(before), r(last)), months)

    rows = rows.withColumns({"y_np": year("npa", "npa_fyprev", "npa_ly"), "y_op": year("op_raw", "op_fyprev", "op_ly_raw"),
                             "y_rev": year("revenue", "revenue_fyprev", "revenue_ly"), "y_cash": year("cash_flow", "cash_flow_fyprev", "cash_flow_ly")})
    rows = rows.withColumns({
        "roe": F.when(r("total_equity") > 0, within(c("y_np") / r("total_equity") * 100.0, -300, 300)),
        "lev": F.when((r("total_equity") > 0) & (r("total_liabilities") >= 0), within(r("total_liabilities") / r("total_equity"), 0, 50)),
        "cr": F.when((r("current_liabilities") > 0) & (r("current_assets") >= 0), within(r("current_assets") / r("current_liabilities"), 0, 15)),
        "cc": F.when(c("y_np") > 0, within(c("y_cash") / c("y_np"), -2, 5)),
        "om12": within(ratio(c("y_op"), F.abs("y_rev")) * 100.0, -200, 200), "nm12": within(ratio(c("y_np"), F.abs("y_rev")) * 100.0, -200, 200)})
    rows = rows.withColumn("pb", F.when(c("roe") > 0, c("pe") * c("roe") / 100.0)).withColumn("pb", F.when(c("pb") <= 30, c("pb")))
    return rows.drop("r", "y_np", "y_op", "y_rev", "y_cash").withColumns({f: round_half(c(f), 6) for f in REPORTED})


def scores(t: Tables) -> DataFrame:
    """A row a company, month end and configuration: its four parts and its score. All configurations share one ranking.

    The table of configurations, a few rows, becomes a column a factor and meets every ranked row.
    """
    rows = written(with_balance(cross_sections(t, FILED)), "cross-sections")
    ranked = with_quality(ranks(rows, RULES | BALANCE_RULES))
    wide = configurations(t.spark).groupBy("config", "stale").pivot("factor", FACTORS).agg(F.max("weight"))
    wide = wide.select("config", "stale", *(F.col(f).alias(f"w_{f}") for f in FACTORS))
    rows = part_scores(ranked.crossJoin(F.broadcast(wide)), lambda f: F.col(f"w_{f}"), F.col("stale"), PARTS)
    return rows.drop(*(f"w_{f}" for f in FACTORS), *(f"r_{f}" for f in FACTORS))


def books(rows: DataFrame, tops: tuple[int, ...], least: int) -> DataFrame:
    """config, day, h, top, n, bench, ret: of each configuration, date and horizon the mean return of all and of the first by score.

    Only the first of a date are placed, so that each task passes on no more than these.
    """
    rows = written(rows.select("config", "day", "company_id", "score", *(f"fwd{h}" for h in HORIZONS)), "scores")
    long = rows.select("config", "day", "company_id", "score", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"fwd{h}").alias("fwd")) for h in HORIZONS))).alias("f"))
    long = long.select("config", "day", "company_id", "score", "f.h", "f.fwd").filter("fwd IS NOT NULL")
    means = long.groupBy("config", "day", "h").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("bench")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("config", "day", "h").orderBy(F.desc("score"), "company_id"))
    first = long.withColumn("rn", place).filter(F.col("rn") <= max(tops))
    first = first.groupBy("config", "day", "h").agg(*(F.avg(F.when(F.col("rn") <= k, F.col("fwd"))).alias(f"top{k}") for k in tops))
    both = means.join(first, ["config", "day", "h"])
    return both.select("config", "day", "h", "n", "bench", F.explode(F.array(*(F.struct(F.lit(k).alias("top"), F.col(f"top{k}").alias("ret")) for k in tops))).alias("x")).select(
        "config", "day", "h", "n", "bench", "x.top", "x.ret")


def in_periods(rows: DataFrame) -> DataFrame:
    """rows, once for each period that their day lies in."""
    year = F.year("day")
    named = F.array(*(F.when(year.between(*span), F.lit(p)) for p, span in PERIODS.items()))
    return rows.withColumn("period", F.explode(F.filter(named, lambda p: p.isNotNull())))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Of each group of books: mean excess, share of dates above all companies, and the growth, as logarithms, of every h-th date's
    first and of all companies then."""
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*by, "config", "h", "top").orderBy("day")) - 1)
    kept, excess = F.col("i") % F.col("h") == 0, F.col("ret") - F.col("bench")
    return rows.groupBy(*by, "config", "h", "top").agg(
        F.count(F.lit(1)).alias("n"), round_half(F.avg(excess), 6).alias("mean_excess"), round_half(F.count_if(excess > 0) * 100.0 / F.count(F.lit(1)), 2).alias("hit_rate"),
        round_half(F.sum(F.when(kept, F.log(1.0 + F.col("ret")))), 4).alias("log_total"), round_half(F.sum(F.when(kept, F.log(1.0 + F.col("bench")))), 4).alias("log_bench"))


def correlations(ics: DataFrame, *by: str) -> DataFrame:
    ic = F.col("ic")
    return ics.groupBy(*by).agg(F.count(ic).alias("n"), round_half(F.avg(ic), 5).alias("mean"), round_half(ratio(F.avg(ic), F.stddev_samp(ic) / F.sqrt(F.count(ic))), 3).alias("t"),
                                round_half(F.count_if(ic > 1e-9) * 100.0 / F.count(ic), 2).alias("positive")).filter("n > 0")


# ---- the same in SQL ----------------------------------------------------------------------------------------------
def _year(now: str, before: str, last: str) -> str:
    return f"CASE WHEN {now} IS NOT NULL AND {before} IS NOT NULL AND {last} IS NOT NULL THEN CASE WHEN jmonth = 12 THEN {now} ELSE {now} + {before} - {last} END END"


def _in(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} BETWEEN {low} AND {high} THEN {x} END"


def _rank(f: str, rule: Rule) -> str:
    n = f"count(k_{f}) OVER (PARTITION BY day)"
    p = f"(2e0 * (rank() OVER (PARTITION BY day ORDER BY k_{f} NULLS LAST) - 1) + count(*) OVER (PARTITION BY day, k_{f}) - 1e0) / nullif(2e0 * ({n} - 1e0), 0)"
    return f"CASE WHEN k_{f} IS NULL THEN {rule.missing}e0 WHEN {n} = 1 THEN 5e-1 ELSE {'1e0 - ' if rule.less_is_better else ''}{p} END AS r_{f}"


_KEPT = ("company_id", "day", "ttm_np", *RULES, "fwd3", "fwd6", "fwd12", "price_age", "report_age", "n_reports", "n_sales", "n_days")
_BALANCE_SQL = f"""{_SECTION_SQL.replace("n_reports, n_sales, i AS n_days FROM priced", "n_reports, n_sales, i AS n_days, jmonth, npa, npa_ly, npa_fyprev, op_raw, op_ly_raw, op_fyprev, revenue, revenue_ly, revenue_fyprev, cash_flow, cash_flow_ly, cash_flow_fyprev, current_assets, total_liabilities, current_liabilities, total_equity FROM priced")},
years AS (
  SELECT *, {_year("npa", "npa_fyprev", "npa_ly")} AS y_np, {_year("op_raw", "op_fyprev", "op_ly_raw")} AS y_op, {_year("revenue", "revenue_fyprev", "revenue_ly")} AS y_rev,
         {_year("cash_flow", "cash_flow_fyprev", "cash_flow_ly")} AS y_cash FROM section),
filed_ratios AS (
  SELECT *, CASE WHEN total_equity > 0 THEN {_in("y_np / total_equity * 1e2", -300, 300)} END AS roe0,
         CASE WHEN total_equity > 0 AND total_liabilities >= 0 THEN {_in("total_liabilities / total_equity", 0, 50)} END AS lev0,
         CASE WHEN current_liabilities > 0 AND current_assets >= 0 THEN {_in("current_assets / current_liabilities", 0, 15)} END AS cr0,
         CASE WHEN y_np > 0 THEN {_in("y_cash / y_np", -2, 5)} END AS cc0,
         {_in("y_op / nullif(abs(y_rev), 0) * 1e2", -200, 200)} AS om0, {_in("y_np / nullif(abs(y_rev), 0) * 1e2", -200, 200)} AS nm0 FROM years),
balance AS (
  SELECT {", ".join(_KEPT)}, {_r("roe0", 6)} AS roe, {_r("lev0", 6)} AS lev, {_r("cr0", 6)} AS cr, {_r("cc0", 6)} AS cc, {_r("om0", 6)} AS om12, {_r("nm0", 6)} AS nm12,
         {_r("CASE WHEN roe0 > 0 AND pe * roe0 / 1e2 <= 30 THEN pe * roe0 / 1e2 END", 6)} AS pb FROM filed_ratios)"""
_CONFIG_SQL = f"""{_BALANCE_SQL},
held AS (SELECT *, {", ".join(f"{_cap(f)} AS k_{f}" for f in FACTORS)} FROM balance QUALIFY count(*) OVER (PARTITION BY day) >= {MIN_UNIVERSE}),
ranks AS (SELECT *, {", ".join(_rank(f, rule) for f, rule in (RULES | BALANCE_RULES).items())} FROM held),
configs(config, stale, {", ".join(f"w_{f}" for f in FACTORS)}) AS (VALUES {", ".join(f"('{name}', {stale}, {', '.join(f'{weights.get(f, 0)}e0' for f in FACTORS)})" for name, (weights, stale) in CONFIGS.items())}),
parts AS (
  SELECT ranks.*, config, {", ".join(
      f"greatest(0e0 + {' + '.join(f'r_{f} * w_{f}' for f in names)} - ({f'CASE WHEN stale THEN {_PEN[name]} ELSE 0e0 END' if name == 'mkt_s' else _PEN[name]}), 0e0) AS {name}" for name, names in PARTS.items())},
         {_step("n_sales", ">=", (24, .28), (12, .16), (6, .09))} + {_step("n_reports", ">=", (16, .28), (8, .16), (4, .09))} + {_step("n_days", ">=", (90, .21), (30, .13), (10, .06))}
         + 9e-2 + {_step("report_age", "<=", (5, .08), (8, .045))} + {_step("price_age", "<=", (7, .06), (14, .035))} AS dq FROM ranks CROSS JOIN configs),
scored AS (SELECT *, {_r("dq * (0e0 + " + " + ".join(PARTS) + ")", 6)} AS score FROM parts)"""
_PERIOD_SQL = "(VALUES " + ", ".join(f"('{p}', {a}, {b})" for p, (a, b) in PERIODS.items()) + ") v(period, low, high)"


def _books_sql(configs: tuple[str, ...], tops: tuple[int, ...], least: int) -> str:
    names = ", ".join(f"'{c}'" for c in configs)
    return f"""{_CONFIG_SQL},
long AS ({" UNION ALL ".join(f"SELECT config, day, company_id, score, {h} AS h, fwd{h} AS fwd FROM scored WHERE fwd{h} IS NOT NULL AND config IN ({names})" for h in HORIZONS)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY config, day, h ORDER BY score DESC, company_id) AS rn FROM long),
wide AS (SELECT config, day, h, avg(fwd) AS bench, {", ".join(f"avg(fwd) FILTER (rn <= {k}) AS top{k}" for k in tops)} FROM placed GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
books AS (SELECT config, day, h, bench, unnest([{", ".join(map(str, tops))}]) AS top, unnest([{", ".join(f"top{k}" for k in tops)}]) AS ret FROM wide)"""


_SUMMARY = f"""count(*) AS n, {_r("avg(ret - bench)", 6)} AS mean_excess, {_r("count(*) FILTER (ret - bench > 0) * 1e2 / count(*)", 2)} AS hit_rate,
       {_r("sum(ln(1e0 + ret)) FILTER (i % h = 0)", 4)} AS log_total, {_r("sum(ln(1e0 + bench)) FILTER (i % h = 0)", 4)} AS log_bench"""
_MEAN_IC = f"""count(ic) AS n, {_r("avg(ic)", 5)} AS mean, {_r("avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0)", 3)} AS t, {_r("count(*) FILTER (ic > 1e-9) * 1e2 / count(ic)", 2)} AS positive"""
_COMPARED = ("old", "new")


@query("weights_scores", _sql(f"{_CONFIG_SQL}\nSELECT company_id, day, config, {', '.join(f'{_r(c, 4)} AS {c}' for c in (*PARTS, 'score'))} FROM scored"))
def weights_scores(t: Tables) -> DataFrame:
    """The four parts and the score of each company and month end under every configuration."""
    return scores(t).select("company_id", "day", "config", *(round_half(F.col(c), 4).alias(c) for c in (*PARTS, "score")))


@query("weights_compare", _sql(f"""{_books_sql(_COMPARED, TOPS, MIN_UNIVERSE)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY period, config, h, top ORDER BY day) - 1 AS i FROM books JOIN {_PERIOD_SQL} ON year(day) BETWEEN low AND high)
SELECT period, config, h, top, {_SUMMARY} FROM numbered GROUP BY 1, 2, 3, 4"""))
def weights_compare(t: Tables) -> DataFrame:
    """Old weights against new: the first ten and twenty over three and six months, within the sample, beyond it, and on the whole."""
    rows = scores(t).filter(F.col("config").isin(*_COMPARED))
    return summary(in_periods(books(rows, TOPS, MIN_UNIVERSE)), "period")


@query("weights_ic", _sql(f"""{_CONFIG_SQL},
paired AS (SELECT config, day, score AS x, fwd3 AS y FROM scored WHERE fwd3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY config, day) >= {MIN_FORWARD}),
placed AS (
  SELECT config, day, rank() OVER (PARTITION BY config, day ORDER BY x) + (count(*) OVER (PARTITION BY config, day, x) - 1) / 2e0 AS rx,
         rank() OVER (PARTITION BY config, day ORDER BY y) + (count(*) OVER (PARTITION BY config, day, y) - 1) / 2e0 AS ry FROM paired),
ics AS (SELECT config, day, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM placed GROUP BY 1, 2)
SELECT period, config, {_MEAN_IC} FROM ics JOIN {_PERIOD_SQL} ON year(day) BETWEEN low AND high GROUP BY 1, 2 HAVING count(ic) > 0"""))
def weights_ic(t: Tables) -> DataFrame:
    """The mean rank correlation of each configuration's score with the return of three months, by period."""
    ics = rank_correlation(scores(t), ["config", "day"], "score", "fwd3", MIN_FORWARD)
    return correlations(in_periods(ics), "period", "config")


@query("balance_factors", _sql(f"{_BALANCE_SQL}\nSELECT company_id, day, {', '.join(f'{_r(f, 4)} AS {f}' for f in REPORTED)} FROM balance"))
def balance_factors(t: Tables) -> DataFrame:
    """What the latest report that was out says of each company at each month end."""
    return with_balance(cross_sections(t, FILED)).select("company_id", "day", *(round_half(F.col(f), 4).alias(f) for f in REPORTED))


_SCORED_SERIES = ("plain", "balance")


@query("balance_ic", _sql(f"""{_CONFIG_SQL},
paired AS (SELECT company_id, day, max(score) FILTER (config = 'plain') AS plain, max(score) FILTER (config = 'balance') AS balance FROM scored GROUP BY 1, 2),
series AS ({" UNION ALL ".join(f"SELECT day, '{c}' AS series, {c} AS x, fwd3 AS y FROM scored WHERE config = 'plain' AND {c} IS NOT NULL" for c in REPORTED_SERIES)}
  UNION ALL {" UNION ALL ".join(f"SELECT b.day, '{c}', p.{c}, b.fwd3 FROM scored b JOIN paired p USING (company_id, day) WHERE config = 'plain'" for c in _SCORED_SERIES)}),
covered AS (SELECT series, count(*) AS dates FROM (SELECT series, day FROM series GROUP BY 1, 2 HAVING count(*) >= {MIN_CROSS}) GROUP BY 1),
placed AS (
  SELECT day, series, rank() OVER (PARTITION BY day, series ORDER BY x) + (count(*) OVER (PARTITION BY day, series, x) - 1) / 2e0 AS rx,
         rank() OVER (PARTITION BY day, series ORDER BY y) + (count(*) OVER (PARTITION BY day, series, y) - 1) / 2e0 AS ry FROM series WHERE y IS NOT NULL),
ics AS (SELECT day, series, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic FROM placed GROUP BY 1, 2 HAVING count(*) >= {MIN_CROSS})
SELECT series, dates, {_MEAN_IC} FROM ics JOIN covered USING (series) GROUP BY 1, 2 HAVING count(ic) > 0"""))
def balance_ic(t: Tables) -> DataFrame:
    """The mean rank correlation of a report's factors, and of the scores without and with them, with the return of three months; and
    on how many dates enough companies have the factor."""
    rows = written(scores(t).filter(F.col("config").isin(*_SCORED_SERIES)), "configured-scores")
    both = rows.groupBy("company_id", "day").pivot("config", list(_SCORED_SERIES)).agg(F.max("score"))
    one = rows.filter("config = 'plain'").select("company_id", "day", *REPORTED_SERIES, F.col("fwd3").alias("y"))
    wide = one.join(both, ["company_id", "day"])
    names = [*REPORTED_SERIES, *_SCORED_SERIES]
    long = wide.select("day", "y", *names).unpivot(["day", "y"], names, "series", "x").filter("x IS NOT NULL")
    dates = long.groupBy("series", "day").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= MIN_CROSS).groupBy("series").agg(F.count(F.lit(1)).alias("dates"))
    return correlations(rank_correlation(long, ["day", "series"], "x", "y", MIN_CROSS).join(dates, "series"), "series", "dates")


@query("balance_portfolios", _sql(f"""{_books_sql(_SCORED_SERIES, (REPORTED_TOP,), MIN_CROSS)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY config, h, top ORDER BY day) - 1 AS i FROM books)
SELECT config, h, top, {_SUMMARY} FROM numbered GROUP BY 1, 2, 3"""))
def balance_portfolios(t: Tables) -> DataFrame:
    """The first five by the score without and with the balance sheet's factors, over three and six months."""
    return summary(books(scores(t).filter(F.col("config").isin(*_SCORED_SERIES)), (REPORTED_TOP,), MIN_CROSS))
