"""Legacy scores, technical indicators, price histories, corporate events and table presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import growth_pct, ratio, round_away, round_half, sigmoid
from quantloom.operators.corporate import back_adjust, find_events, yesterday
from quantloom.operators.indicators import Series, macd, rsi, technical
from quantloom.operators.ranking import numbered, numbered_all, over_rows
from quantloom.plans.registry import query
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables


def _r(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits}e0 + 5e-1) / {10**digits}e0"


def profit_history(t: Tables) -> DataFrame:
    """company_id, rn (1 is the latest report), n (how many), eps value of each report."""
    rows = domain.interim_reports(t).select("company_id", "jyear", "jmonth", "net_profit", "operating_profit", "revenue")
    rows = numbered(rows, ["company_id"], [F.desc("jyear"), F.desc("jmonth")])
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("company_id")))


def steady_growth(history: DataFrame, drop: float = 0.1, years: int = 4) -> DataFrame:
    """company_id, stable: each of the last two to four blocks of four reports is positive and not a tenth below the one
    before, or the latest value is very large; never with a loss in the last eight reports or under sixteen reports."""
    blocks = history.withColumn("year", F.floor((F.col("rn") - 1) / 4).cast("int")).filter(
        (F.col("year") < years) & (F.col("year") < F.floor(F.col("n") / 4)))
    sums = blocks.groupBy("company_id", "year").agg(F.sum("net_profit").alias("total"))
    before = F.lead("total").over(Window.partitionBy("company_id").orderBy("year"))
    kept = sums.withColumn("fine", (F.col("total") > 0) & F.coalesce(F.col("total") > before * (1.0 - drop), F.lit(True)))
    fine = kept.groupBy("company_id").agg(F.min(F.col("fine").cast("int")).alias("fine"), F.count(F.lit(1)).alias("blocks"))
    ends = history.groupBy("company_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("net_profit"))).alias("latest"), over_rows(F.min, F.col("net_profit"), 1, 8).alias("least"), F.max("n").alias("n"))
    grows = ((F.col("fine") == 1) & (F.col("blocks") >= 2)) | (F.col("latest") / 1e11 > 1)
    return ends.join(fine, "company_id", "left").select("company_id", (F.coalesce(grows, F.lit(False)) & (F.col("least") >= 0) & (F.col("n") >= 16)).cast("int").alias("stable"))


_HISTORY_SQL = """
history AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY jyear DESC, jmonth DESC) AS rn, count(*) OVER (PARTITION BY company_id) AS n FROM interim)"""
_STABLE_SQL = _HISTORY_SQL + """,
sums AS (SELECT company_id, (rn - 1) // 4 AS y, sum(net_profit) AS total FROM history WHERE (rn - 1) // 4 < least(4, n // 4) GROUP BY 1, 2),
fine AS (SELECT company_id, bool_and(total > 0 AND coalesce(total > earlier * (1e0 - 1e-1), true)) AS fine, count(*) AS blocks
         FROM (SELECT *, lead(total) OVER (PARTITION BY company_id ORDER BY y) AS earlier FROM sums) GROUP BY 1),
stable AS (SELECT h.company_id, (coalesce((f.fine AND f.blocks >= 2) OR max(net_profit) FILTER (rn = 1) / 1e11 > 1, false)
                  AND min(net_profit) FILTER (rn <= 8) >= 0 AND max(n) >= 16)::INT AS stable
           FROM history h LEFT JOIN fine f USING (company_id) GROUP BY h.company_id, f.fine, f.blocks)"""


@query("stable_flag", with_tables("interim", then=f"-- more{_STABLE_SQL}\nSELECT * FROM stable"))
def stable_flag(t: Tables) -> DataFrame:
    return steady_growth(profit_history(t))


def _profit_growth(history: DataFrame) -> DataFrame:
    mean = lambda a, b: over_rows(F.avg, F.col("net_profit"), a, b)
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("net_profit")))
    latest = lambda c: F.max(F.when(F.col("rn") == 1, F.col(c)))
    grown = history.groupBy("company_id").agg(
        F.max("n").alias("n"), growth_pct(mean(1, 4), mean(5, 8)).alias("long"), growth_pct(at(1), at(5)).alias("short"), F.avg("net_profit").alias("eps_level"),
        (ratio(latest("operating_profit"), latest("revenue")) * 100.0).alias("operation"))
    chosen = F.when(F.col("n") >= 8, F.col("long")).when(F.col("n") >= 5, F.col("short"))
    return grown.select("company_id", F.coalesce(chosen, F.lit(0.0)).alias("eps_growth"), "eps_level", F.coalesce("operation", F.lit(0.0)).alias("operation"))


def _sales_growth(t: Tables) -> DataFrame:
    rows = numbered(domain.monthly_sales(t), ["company_id"], [F.desc("report_key")])
    mean = lambda a, b: over_rows(F.avg, F.col("value3"), a, b)
    grown = rows.groupBy("company_id").agg(
        F.when(F.count(F.lit(1)) >= 24, growth_pct(mean(1, 12), mean(13, 24))).alias("g"),
        (1.0 - ratio(F.stddev_pop("value3"), F.avg("value3"))).alias("s"), F.count(F.lit(1)).alias("n"))
    return grown.select("company_id", F.coalesce("g", F.lit(0.0)).alias("sales_growth"), F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0))).otherwise(0.0).alias("stability"))


_LEGACY_SQL = _STABLE_SQL + """,
eps AS (
  SELECT company_id, avg(net_profit) AS eps_level,
         coalesce(CASE WHEN max(n) >= 8 THEN (avg(net_profit) FILTER (rn <= 4) - avg(net_profit) FILTER (rn BETWEEN 5 AND 8)) / nullif(abs(avg(net_profit) FILTER (rn BETWEEN 5 AND 8)), 0) * 1e2
                       WHEN max(n) >= 5 THEN (max(net_profit) FILTER (rn = 1) - max(net_profit) FILTER (rn = 5)) / nullif(abs(max(net_profit) FILTER (rn = 5)), 0) * 1e2 END, 0e0) AS eps_growth,
         coalesce(max(operating_profit) FILTER (rn = 1) / nullif(max(revenue) FILTER (rn = 1), 0) * 1e2, 0e0) AS operation
  FROM history GROUP BY 1),
srows AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY report_key DESC) AS rn FROM monthly),
sales AS (
  SELECT company_id,
         coalesce(CASE WHEN count(*) >= 24 THEN (avg(value3) FILTER (rn <= 12) - avg(value3) FILTER (rn BETWEEN 13 AND 24)) / nullif(abs(avg(value3) FILTER (rn BETWEEN 13 AND 24)), 0) * 1e2 END, 0e0) AS sales_growth,
         CASE WHEN count(*) > 1 THEN coalesce(1 - stddev_pop(value3) / nullif(avg(value3), 0), 0e0) ELSE 0e0 END AS stability
  FROM srows GROUP BY 1)"""


@query("legacy_company_scores", with_tables("monthly", "interim", "valuation", then=f"""-- more{_LEGACY_SQL}
SELECT coalesce(s.company_id, e.company_id) AS company_id, v.company_name, {_r("coalesce(sales_growth, 0e0)", 2)} AS sales_growth, {_r("coalesce(eps_growth, 0e0)", 2)} AS eps_growth,
       coalesce(pe, 0e0) AS pe, coalesce(price, 0e0) AS price, coalesce(stable, 0) AS stable, {_r("coalesce(operation, 0e0)", 2)} AS operation
FROM sales s FULL JOIN eps e ON e.company_id = s.company_id LEFT JOIN stable b ON b.company_id = coalesce(s.company_id, e.company_id)
LEFT JOIN valuation v ON v.company_id = coalesce(s.company_id, e.company_id)"""))
def legacy_company_scores(t: Tables) -> DataFrame:
    """All companies with sales or reports; P/E and price by left join, 0 where missing."""
    history = profit_history(t)
    both = _sales_growth(t).join(_profit_growth(history), "company_id", "full_outer").join(steady_growth(history), "company_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.join(domain.valuations(t), "company_id", "left").select(
        "company_id", "company_name", round_half(zero("sales_growth"), 2).alias("sales_growth"), round_half(zero("eps_growth"), 2).alias("eps_growth"),
        zero("pe").alias("pe"), zero("price").alias("price"), F.coalesce("stable", F.lit(0)).alias("stable"), round_half(zero("operation"), 2).alias("operation"))


def _away(x: str, digits: int) -> str:
    return f"sign({x}) * floor(abs({x}) * {10**digits}e0 + 5e-1) / {10**digits}e0"


def _sig(x: str) -> str:
    return f"1e0 / (1e0 + exp(least(-({x}) / 1e1, 700e0)))"


_SINGLE = (("sales_growth", 0.3), ("stability", 0.2), ("eps_level", 0.3), ("eps_growth", 0.2))


@query("legacy_single_score", with_tables("monthly", "interim", "valuation", then=f"""-- more{_LEGACY_SQL},
every AS (
  SELECT coalesce(s.company_id, e.company_id) AS company_id, coalesce(sales_growth, 0e0) AS sales_growth, coalesce(stability, 0e0) AS stability,
         coalesce(eps_level, 0e0) AS eps_level, coalesce(eps_growth, 0e0) AS eps_growth FROM sales s FULL JOIN eps e ON e.company_id = s.company_id),
named AS (SELECT e.*, s_name AS company_name FROM every e LEFT JOIN supplier ON s_suppkey = e.company_id)
SELECT n.company_id, {", ".join(f"{_away(c, 2)} AS {c}" for c, _ in _SINGLE)}, {_away("coalesce(v.pe, 0e0)", 2)} AS pe, {_away("coalesce(v.price, 0e0)", 2)} AS price,
       {_away("0e0 + " + " + ".join(f"{w}e0 * ({_sig(c)})" for c, w in _SINGLE), 4)} AS final_score
FROM named n LEFT JOIN valuation v ON v.company_name = n.company_name"""))
def legacy_single_score(t: Tables) -> DataFrame:
    """Every company with sales or reports; what is missing counts as 0, P/E and price come by name."""
    both = _sales_growth(t).join(_profit_growth(profit_history(t)), "company_id", "full_outer")
    both = both.select("company_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c, _ in _SINGLE)).join(domain.companies(t), "company_id", "left")
    both = both.join(domain.valuations(t).drop("company_id"), "company_name", "left")
    score = sum((w * sigmoid(F.col(c)) for c, w in _SINGLE), F.lit(0.0))
    return both.select("company_id", *(round_away(F.col(c), 2).alias(c) for c, _ in _SINGLE), *(round_away(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("pe", "price")),
                       round_away(score, 4).alias("final_score"))


@query("sales_wow", with_tables("monthly", then=f"""
SELECT company_id, report_key, {_r("value3 / 1e6", 2)} AS percentage,
       CASE WHEN value3 > earlier THEN 1 WHEN value3 < earlier THEN -1 ELSE 0 END AS wow
FROM (SELECT *, lag(value3) OVER (PARTITION BY company_id ORDER BY report_key) AS earlier FROM monthly) WHERE value3 <> 0"""))
def sales_wow(t: Tables) -> DataFrame:
    before = F.lag("value3").over(Window.partitionBy("company_id").orderBy("report_key"))
    rows = domain.monthly_sales(t).withColumn("before", before).filter("value3 <> 0")
    sign = F.when(F.col("value3") > F.col("before"), 1).when(F.col("value3") < F.col("before"), -1).otherwise(0)
    return rows.select("company_id", "report_key", round_half(F.col("value3") / 1e6, 2).alias("percentage"), sign.alias("wow"))


_NUMBERED = """
days AS (SELECT *, row_number() OVER d AS i, lag(close) OVER d AS earlier FROM market WINDOW d AS (PARTITION BY company_id ORDER BY day))"""


@query("technical_ma_vol", with_tables("market", then=f"""-- more{_NUMBERED},
moved AS (SELECT *, coalesce((close - earlier) / nullif(earlier, 0), 0e0) AS change FROM days)
SELECT company_id, day, {_r("CASE WHEN i >= 20 THEN avg(close) OVER w20 ELSE 0e0 END", 4)} AS ma20,
       {_r("CASE WHEN i >= 50 THEN avg(close) OVER w50 ELSE 0e0 END", 4)} AS ma50,
       {_r("CASE WHEN i >= 20 THEN stddev_pop(change) OVER w20 ELSE 0e0 END", 6)} AS volatility,
       close - coalesce(lag(close, 10) OVER d, 0e0) AS momentum
FROM moved WINDOW d AS (PARTITION BY company_id ORDER BY day), w20 AS (PARTITION BY company_id ORDER BY day ROWS 19 PRECEDING), w50 AS (PARTITION BY company_id ORDER BY day ROWS 49 PRECEDING)"""))
def technical_ma_vol(t: Tables) -> DataFrame:
    s, c = Series("company_id", "day"), F.col("close")
    rows = domain.market_prices(t).withColumn("change", s.change(c))
    return rows.select("company_id", "day", round_half(s.mean(c, 20), 4).alias("ma20"), round_half(s.mean(c, 50), 4).alias("ma50"),
                       round_half(s.deviation(F.col("change"), 20), 6).alias("volatility"), (c - s.before(c, 10)).alias("momentum"))


@query("technical_rsi_slope", with_tables("market", then=f"""-- more{_NUMBERED},
turns AS (SELECT *, greatest(close - coalesce(earlier, close), 0e0) AS up, greatest(coalesce(earlier, close) - close, 0e0) AS down FROM days),
means AS (
  SELECT *, CASE WHEN i >= 14 THEN avg(up) OVER w14 ELSE 0e0 END AS gain, CASE WHEN i >= 14 THEN avg(down) OVER w14 ELSE 0e0 END AS loss,
         CASE WHEN i >= 20 THEN regr_slope(close, i::DOUBLE) OVER w20 ELSE 0e0 END AS slope
  FROM turns WINDOW w14 AS (PARTITION BY company_id ORDER BY day ROWS 13 PRECEDING), w20 AS (PARTITION BY company_id ORDER BY day ROWS 19 PRECEDING))
SELECT company_id, day, {_r("CASE WHEN loss = 0 THEN 1e2 ELSE 1e2 - 1e2 / (1 + gain / nullif(loss, 0)) END", 4)} AS rsi, {_r("slope", 3)} AS slope FROM means"""))
def technical_rsi_slope(t: Tables) -> DataFrame:
    s, c = Series("company_id", "day"), F.col("close")
    rows = domain.market_prices(t).withColumn("delta", c - F.coalesce(F.lag("close").over(s.order), c))
    rows = rows.withColumns({"gain": s.mean(F.greatest("delta", F.lit(0.0)), 14), "loss": s.mean(F.greatest(-F.col("delta"), F.lit(0.0)), 14), "slope": s.slope(c, 20)})
    return rows.select("company_id", "day", round_half(rsi(F.col("gain"), F.col("loss")), 4).alias("rsi"), round_half(F.col("slope"), 3).alias("slope"))


_EMA_SQL = """
ordered AS (SELECT company_id, close, row_number() OVER (PARTITION BY company_id ORDER BY day) AS i FROM market),
lines AS (
  SELECT company_id, i, close AS fast, close AS slow, 0e0 AS signal FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.company_id, o.i, f, g, 2e0 / 10e0 * (f - g) + (1e0 - 2e0 / 10e0) * signal
  FROM (SELECT o.company_id, o.i, l.signal, 2e0 / 13e0 * o.close + (1e0 - 2e0 / 13e0) * l.fast AS f, 2e0 / 27e0 * o.close + (1e0 - 2e0 / 27e0) * l.slow AS g
        FROM lines l JOIN ordered o ON o.company_id = l.company_id AND o.i = l.i + 1) o)"""


@query("technical_macd", with_tables("market", then=f"""-- more{_EMA_SQL}
SELECT company_id, {_r("max_by(fast - slow, i)", 4)} AS macd, {_r("max_by(signal, i)", 4)} AS signal FROM lines GROUP BY 1""").replace("WITH", "WITH RECURSIVE", 1))
def technical_macd(t: Tables) -> DataFrame:
    """The last MACD and signal values; each instrument's closes fold in order, once."""
    closes = domain.market_prices(t).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("day", "close"))).alias("x"))
    last = closes.select("company_id", macd(F.transform("x", lambda r: r["close"])).alias("m"))
    return last.select("company_id", round_half(F.col("m.macd"), 4).alias("macd"), round_half(F.col("m.signal"), 4).alias("signal"))


@query("technical_score", with_tables("market", then=f"""-- more{_NUMBERED},{_EMA_SQL},
waves AS (SELECT company_id, max_by(fast - slow, i) AS macd, max_by(signal, i) AS signal FROM lines GROUP BY 1),
turns AS (
  SELECT *, greatest(close - coalesce(earlier, close), 0e0) AS up, greatest(coalesce(earlier, close) - close, 0e0) AS down,
         coalesce((close - earlier) / nullif(earlier, 0), 0e0) AS change FROM days),
calc AS (
  SELECT *, CASE WHEN i >= 20 THEN avg(close) OVER w20 ELSE 0e0 END AS ma20, CASE WHEN i >= 50 THEN avg(close) OVER w50 ELSE 0e0 END AS ma50,
         CASE WHEN i >= 20 THEN avg(volume) OVER w20 ELSE 0e0 END AS mean_volume, CASE WHEN i >= 14 THEN avg(up) OVER w14 ELSE 0e0 END AS gain,
         CASE WHEN i >= 14 THEN avg(down) OVER w14 ELSE 0e0 END AS loss, CASE WHEN i >= 20 THEN stddev_pop(change) OVER w20 ELSE 0e0 END AS volatility,
         close - coalesce(lag(close, 10) OVER d, 0e0) AS momentum, CASE WHEN i >= 20 THEN regr_slope(close, i::DOUBLE) OVER w20 ELSE 0e0 END AS trend
  FROM turns WINDOW d AS (PARTITION BY company_id ORDER BY day), w14 AS (PARTITION BY company_id ORDER BY day ROWS 13 PRECEDING),
       w20 AS (PARTITION BY company_id ORDER BY day ROWS 19 PRECEDING), w50 AS (PARTITION BY company_id ORDER BY day ROWS 49 PRECEDING)),
ends AS (SELECT *, CASE WHEN loss = 0 THEN 1e2 ELSE 1e2 - 1e2 / (1 + gain / nullif(loss, 0)) END AS rsi FROM calc QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY day DESC) = 1)
SELECT company_id, day, close, {_r("rsi", 4)} AS rsi, {_r("macd", 4)} AS macd, {_r("signal", 4)} AS signal, {_r("volatility", 6)} AS volatility, momentum, {_r("trend", 3)} AS trend,
       20e0 * ((ma20 > ma50)::INT + (close > coalesce(earlier, 0))::INT + (volume > mean_volume)::INT + (rsi > 30 AND rsi < 70)::INT + (macd > signal)::INT) AS score
FROM ends JOIN waves USING (company_id)""").replace("WITH", "WITH RECURSIVE", 1))
def technical_score(t: Tables) -> DataFrame:
    digits = {"rsi": 4, "macd": 4, "signal": 4, "volatility": 6, "trend": 3}
    rows = technical(domain.market_prices(t))
    return rows.withColumns({c: round_half(F.col(c), n) for c, n in digits.items()})


@query("price_history", with_tables("market", then="""
SELECT company_id, day, close, yesterday, floor((close - yesterday) / nullif(yesterday, 0) * 1e2 * 1e4 + 5e-1) / 1e4 AS change_pct
FROM (SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY day) AS yesterday FROM market)"""))
def price_history(t: Tables) -> DataFrame:
    return yesterday(domain.market_prices(t)).select("company_id", "day", "close", "yesterday", round_half(F.col("change_pct"), 4).alias("change_pct"))


_EVENTS_SQL = """
steps AS (SELECT *, lag(close) OVER d AS earlier, date_diff('day', lag(day) OVER d, day) AS gap, row_number() OVER (PARTITION BY company_id ORDER BY day DESC) AS back
          FROM market WINDOW d AS (PARTITION BY company_id ORDER BY day)),
judged AS (
  SELECT *, (close - earlier) / earlier * 1e2 AS change_pct, greatest(12e0, (pow(106e-2, least(6, CASE WHEN gap > 0 THEN gap * 5 // 7 + 1 ELSE 1 END)) - 1) * 1e2) AS allowed
  FROM steps WHERE earlier > 0),
events AS (SELECT company_id, day, back, change_pct, close / earlier AS factor, close FROM judged WHERE change_pct > allowed OR change_pct < -allowed)"""


@query("corporate_events", with_tables("market", then=f"-- more{_EVENTS_SQL}\nSELECT company_id, day, {_r('change_pct', 2)} AS change_pct, {_r('factor', 6)} AS factor FROM events"))
def corporate_events(t: Tables) -> DataFrame:
    return find_events(domain.market_prices(t)).select("company_id", "day", round_half(F.col("change_pct"), 2).alias("change_pct"), round_half(F.col("factor"), 6).alias("factor"))


@query("corporate_events_recent", with_tables("market", then=f"-- more{_EVENTS_SQL}\nSELECT company_id, day, {_r('change_pct', 2)} AS change_pct FROM events WHERE back BETWEEN 1 AND 14"))
def corporate_events_recent(t: Tables) -> DataFrame:
    """Events among each company's latest 14 rows, the report of a daily run."""
    return find_events(domain.market_prices(t), last=14).select("company_id", "day", round_half(F.col("change_pct"), 2).alias("change_pct"))


_SIX = ("close", "last", "first", "high", "low")


@query("back_adjust", with_tables("market", then=f"""-- more{_EVENTS_SQL},
lists AS (SELECT company_id, list(day ORDER BY day) AS days, list(factor ORDER BY day) AS factors FROM events WHERE close > 0 AND abs(factor - 1) >= 2e-2 GROUP BY 1),
later AS (
  SELECT s.*, coalesce(len(days), 0) > 0 AS touched, coalesce(list_filter(factors, lambda f, i: days[i] > day), []) AS rest FROM steps s LEFT JOIN lists USING (company_id)),
adjusted AS (
  SELECT company_id, day, touched, earlier, {", ".join(f"CASE WHEN {c} > 0 THEN list_reduce(list_prepend({c}, rest), lambda p, f: CASE WHEN p > 0 THEN round_even(p * f, 0) ELSE p END) ELSE {c} END AS {c}" for c in _SIX)}
  FROM later)
SELECT company_id, day, {", ".join(_SIX)}, CASE WHEN NOT touched THEN earlier WHEN lag(close) OVER d > 0 THEN lag(close) OVER d END AS yesterday
FROM adjusted WINDOW d AS (PARTITION BY company_id ORDER BY day)"""))
def back_adjust_query(t: Tables) -> DataFrame:
    rows = yesterday(domain.market_prices(t)).select("company_id", "day", *_SIX, "yesterday")
    return back_adjust(rows)


@query("chart_range_stats", with_tables("market", then="""
SELECT company_id, floor((max_by(close, day) - min_by(close, day)) / nullif(min_by(close, day), 0) * 1e2 * 1e4 + 5e-1) / 1e4 AS range_return, max(close) AS highest, min(close) AS lowest,
       max_by(day, (close - earlier, day)) FILTER (earlier IS NOT NULL) AS best_day, min_by(day, (close - earlier, day)) FILTER (earlier IS NOT NULL) AS worst_day
FROM (SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY day) AS earlier FROM market) GROUP BY 1"""))
def chart_range_stats(t: Tables) -> DataFrame:
    """The return over the range, the greatest and least close, and the days of the greatest rise and fall."""
    first, last = F.min_by("close", "day"), F.max_by("close", "day")
    change = F.col("close") - F.lag("close").over(Window.partitionBy("company_id").orderBy("day"))
    at = F.when(F.col("change").isNotNull(), F.struct("change", "day"))
    return domain.market_prices(t).withColumn("change", change).groupBy("company_id").agg(
        round_half(ratio(last - first, first) * 100.0, 4).alias("range_return"), F.max("close").alias("highest"), F.min("close").alias("lowest"),
        F.max_by("day", at).alias("best_day"), F.min_by("day", at).alias("worst_day"))


@query("score_buckets", with_tables("valuation", then="""
SELECT company_id, CASE WHEN pe IS NULL THEN 'none' WHEN pe <= 0 THEN 'loss' WHEN pe <= 5 THEN 'cheap' WHEN pe <= 60 THEN 'fair' ELSE 'dear' END AS bucket FROM valuation"""))
def score_buckets(t: Tables) -> DataFrame:
    pe = F.col("pe")
    bucket = F.when(pe.isNull(), "none").when(pe <= 0, "loss").when(pe <= 5, "cheap").when(pe <= 60, "fair").otherwise("dear")
    return domain.valuations(t).select("company_id", bucket.alias("bucket"))


@query("nulls_last_sort", with_tables("valuation", then="SELECT company_id, pe, row_number() OVER (ORDER BY pe DESC NULLS LAST, company_id) AS place FROM valuation"))
def nulls_last_sort(t: Tables) -> DataFrame:
    """The place of each row in a table sorted downwards, missing values last."""
    rows = domain.valuations(t).select("company_id", "pe")
    return numbered_all(rows, [F.col("pe").desc_nulls_last(), F.col("company_id").asc()])


@query("pe_refresh", with_tables("valuation", then="""
SELECT company_id, CASE WHEN coalesce(pe, 0) = 0 AND price > 0 THEN floor(price / (1000e0 + company_id) * 1e2 + 5e-1) / 1e2 ELSE pe END AS pe FROM valuation"""))
def pe_refresh(t: Tables) -> DataFrame:
    """Missing ratios are filled from price and earnings."""
    fresh = round_half(F.col("price") / (1000.0 + F.col("company_id")), 2)
    gap = (F.coalesce("pe", F.lit(0.0)) == 0) & (F.col("price") > 0)
    return domain.valuations(t).select("company_id", F.when(gap, fresh).otherwise(F.col("pe")).alias("pe"))


@query("search_companies", "SELECT s_suppkey AS company_id, s_name AS company_name FROM supplier WHERE contains(lower(s_name), '7')")
def search_companies(t: Tables) -> DataFrame:
    return domain.companies(t).filter(F.lower("company_name").contains("7"))


@query("monthly_sales_dedup", with_tables("monthly", then="""-- more doubled AS (SELECT *, 0 AS v FROM monthly UNION ALL SELECT *, 1 AS v FROM monthly WHERE value1 > 5)
SELECT company_id, report_key, value3, v FROM doubled QUALIFY row_number() OVER (PARTITION BY company_id, report_key ORDER BY v DESC) = 1"""))
def monthly_sales_dedup(t: Tables) -> DataFrame:
    from quantloom.operators.ranking import latest_per

    rows = domain.monthly_sales(t)
    doubled = rows.withColumn("v", F.lit(0)).unionByName(rows.filter("value1 > 5").withColumn("v", F.lit(1)))
    return latest_per(doubled, ["company_id", "report_key"], [F.desc("v")]).select("company_id", "report_key", "value3", "v")


@query("company_list_union", """SELECT company_id, max(name) AS name, count(*) AS n FROM (
  SELECT l_suppkey AS company_id, 'sales' AS name FROM lineitem UNION ALL SELECT s_suppkey, s_name FROM supplier) GROUP BY 1""")
def company_list_union(t: Tables) -> DataFrame:
    both = t("lineitem").select(F.col("l_suppkey").alias("company_id"), F.lit("sales").alias("name")).unionByName(
        domain.companies(t).withColumnRenamed("company_name", "name"))
    return both.groupBy("company_id").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("n"))
