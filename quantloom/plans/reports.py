"""Reports over the domain's tables: details of a company, exports, prompts, histories of writes, exploded facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import ratio, round_half
from quantloom.functions.text import csv_text
from quantloom.operators import state
from quantloom.plans.registry import query
from quantloom.plans.score import DERIVED_SQL, MARKET_SQL, PROFIT_SQL, RANKED_SQL, SALES_SQL, _view, reports, score_view
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables


def detail(df: DataFrame, company: int, order: str, limit: int) -> DataFrame:
    """The latest rows of one company; a top-k report."""
    return df.filter(F.col("company_id") == company).orderBy(F.desc(order)).limit(limit)


@query("company_detail_monthly", with_tables("monthly", then="SELECT * FROM monthly WHERE company_id = 3 ORDER BY report_key DESC LIMIT 24"))
def company_detail_monthly(t: Tables) -> DataFrame:
    return detail(domain.monthly_sales(t), 3, "report_key", 24)


@query("company_detail_profit", with_tables("interim", then="SELECT company_id, jyear * 100 + jmonth AS report_key, revenue, net_profit, revenue_ly FROM interim WHERE company_id = 3 ORDER BY 2 DESC LIMIT 8"))
def company_detail_profit(t: Tables) -> DataFrame:
    rows = domain.interim_reports(t).select("company_id", (F.col("jyear") * 100 + F.col("jmonth")).alias("report_key"), "revenue", "net_profit", "revenue_ly")
    return detail(rows, 3, "report_key", 8)


@query("company_detail_market", with_tables("market", then="SELECT company_id, day, close, volume, trade_count FROM market WHERE company_id = 3 ORDER BY day DESC LIMIT 90"))
def company_detail_market(t: Tables) -> DataFrame:
    return detail(domain.market_prices(t).select("company_id", "day", "close", "volume", "trade_count"), 3, "day", 90)


@query("op_unit_normalize", with_tables("interim", then=f"-- more{PROFIT_SQL}\nSELECT company_id, jyear, jmonth, floor(op * 1e2 + 5e-1) / 1e2 AS op, floor(op_ly * 1e2 + 5e-1) / 1e2 AS op_ly FROM clean"))
def op_unit_normalize(t: Tables) -> DataFrame:
    """Operating profit that some reports give a share, brought to an amount by revenue, else by EPS."""
    rows = reports(domain.interim_reports(t))
    return rows.select("company_id", "jyear", "jmonth", round_half(F.col("op"), 2).alias("op"), round_half(F.col("op_ly"), 2).alias("op_ly"))


_FINAL = (SALES_SQL, PROFIT_SQL, MARKET_SQL, DERIVED_SQL, RANKED_SQL)


@query("score_export_csv_shape", _view(*_FINAL, then="""
SELECT company_id, replace(company_name, '"', '''') AS name, CASE WHEN quant_score = 0 THEN '' ELSE printf('%.2f', quant_score) END AS score,
       CASE WHEN coalesce(pe_raw, 0) = 0 THEN '' ELSE printf('%.2f', floor(pe_raw * 1e2 + 5e-1) / 1e2) END AS pe, CASE WHEN sg_raw < 0 THEN 'yes' ELSE 'no' END AS weak FROM final"""))
def score_export_csv_shape(t: Tables) -> DataFrame:
    """The score as the CSV export shows it: fixed digits, nothing for zero and missing, words for flags."""
    shown = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, "").otherwise(F.format_string("%.2f", round_half(c, 2)))
    return score_view(t).select("company_id", csv_text(F.col("company_name")).alias("name"), shown(F.col("quant_score")).alias("score"), shown(F.col("pe_raw")).alias("pe"),
                                F.when(F.col("sg_raw") < 0, "yes").otherwise("no").alias("weak"))


@query("prompt_payload", _view(*_FINAL, then="""
SELECT '[' || string_agg('{"company_id":' || company_id || ',"company_name":"' || company_name || '"}', ',' ORDER BY quant_score DESC, company_id) || ']' AS payload
FROM (SELECT * FROM final ORDER BY quant_score DESC, company_id LIMIT 8)"""))
def prompt_payload(t: Tables) -> DataFrame:
    """The best eight as one JSON text."""
    best = score_view(t).orderBy(F.desc("quant_score"), "company_id").limit(8)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("quant_score")).alias("k"), "company_id", "company_name")))
    return best.agg(F.to_json(F.transform(rows, lambda r: F.struct(r["company_id"].alias("company_id"), r["company_name"].alias("company_name")))).alias("payload"))


@query("sales2_wow", with_tables("monthly", then="""
SELECT company_id, report_key, floor(value1 / 1e6 * 1e6 + 5e-1) / 1e6 AS production, floor(value3 / 1e6 * 1e4 + 5e-1) / 1e4 AS amount,
       floor((value3 - earlier) / nullif(abs(earlier), 0) * 1e2 * 1e2 + 5e-1) / 1e2 AS change_pct
FROM (SELECT *, lag(value3) OVER (PARTITION BY company_id ORDER BY report_key) AS earlier FROM monthly)"""))
def sales2_wow(t: Tables) -> DataFrame:
    before = F.lag("value3").over(Window.partitionBy("company_id").orderBy("report_key"))
    rows = domain.monthly_sales(t).withColumn("before", before)
    return rows.select("company_id", "report_key", round_half(F.col("value1") / 1e6, 6).alias("production"), round_half(F.col("value3") / 1e6, 4).alias("amount"),
                       round_half(ratio(F.col("value3") - F.col("before"), F.abs("before")) * 100.0, 2).alias("change_pct"))


@query("facts_explode", """
SELECT c_custkey AS company_id, tag, unit, count(*) AS n, sum(val)::BIGINT AS total FROM (
  SELECT c_custkey, 'Assets' AS tag, 'USD' AS unit, unnest([floor(c_acctbal * 100.0 + 0.5)::BIGINT, c_nationkey::BIGINT]) AS val FROM customer
  UNION ALL SELECT c_custkey, 'Shares', 'shares', length(c_mktsegment) FROM customer) GROUP BY 1, 2, 3""")
def facts_explode(t: Tables) -> DataFrame:
    """Nested facts JSON, taxonomy to tag to unit to points, as rows; points without a value are skipped."""
    point = lambda v: F.struct(F.lit(2020).alias("fy"), v.cast("bigint").alias("val"))
    none = F.struct(F.lit(2021).alias("fy"), F.lit(None).cast("bigint").alias("val"))
    assets = F.array(point(F.floor(F.col("c_acctbal") * 100.0 + 0.5)), point(F.col("c_nationkey")), none)
    units = lambda unit, points: F.struct(F.create_map(F.lit(unit), points).alias("units"))
    tags = F.create_map(F.lit("Assets"), units("USD", assets), F.lit("Shares"), units("shares", F.array(point(F.length("c_mktsegment")))))
    text = F.to_json(F.create_map(F.lit("us"), tags))
    kind = "map<string,map<string,struct<units:map<string,array<struct<fy:int,val:bigint>>>>>>"
    rows = t("customer").select(F.col("c_custkey").alias("company_id"), F.from_json(text, kind).alias("facts"))
    rows = rows.select("company_id", F.explode("facts").alias("taxonomy", "tags")).select("company_id", F.explode("tags").alias("tag", "body"))
    rows = rows.select("company_id", "tag", F.explode("body.units").alias("unit", "points")).select("company_id", "tag", "unit", F.explode("points").alias("p"))
    return rows.filter("p.val IS NOT NULL").groupBy("company_id", "tag", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("p.val").alias("total"))


@query("insert_returning_id", """
SELECT 100000 + row_number() OVER (ORDER BY p_partkey) AS holding_id, p_partkey FROM part""")
def insert_returning_id(t: Tables) -> DataFrame:
    """New ids go on from the greatest one in use, in the order of the rows' key."""
    used = t.spark.range(100000, 100001).select(F.col("id").alias("holding_id"))
    new = t("part").select("p_partkey")
    return state.with_new_ids(used, new, "holding_id", ["p_partkey"]).select("holding_id", "p_partkey")


@query("schema_evolution", with_tables("monthly", then="SELECT company_id, report_key, value3, NULL::DOUBLE AS note FROM monthly UNION ALL SELECT company_id, report_key + 1000000, NULL, value3 FROM monthly"))
def schema_evolution(t: Tables) -> DataFrame:
    """An older table without a column and a newer one without another are one table."""
    old = domain.monthly_sales(t).select("company_id", "report_key", "value3")
    new = domain.monthly_sales(t).select("company_id", (F.col("report_key") + 1000000).alias("report_key"), F.col("value3").alias("note"))
    return old.unionByName(new, allowMissingColumns=True)


@query("batched_update", with_tables("market", then="""
SELECT company_id, day, close, CASE WHEN company_id % 3 = 0 THEN 0e0 ELSE volume END AS volume FROM market"""))
def batched_update(t: Tables) -> DataFrame:
    rows = domain.market_prices(t).select("company_id", "day", "close", "volume")
    change = rows.filter("company_id % 3 = 0").select("company_id", "day", F.lit(0.0).alias("volume"))
    return state.update_by_key(rows, change, ["company_id", "day"], ["volume"])


@query("latest_url_filter", """
SELECT page_id, url FROM pages WHERE contains(lower(url), '1') QUALIFY row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id DESC) = 1""")
def latest_url_filter(t: Tables) -> DataFrame:
    """The newest matching page of each group."""
    rows = t("pages").filter(F.lower("url").contains("1"))
    top = Window.partitionBy(F.col("page_id") % 10).orderBy(F.desc("page_id"))
    return rows.withColumn("rn", F.row_number().over(top)).filter("rn = 1").select("page_id", "url")


@query("cash_flows_page", """
SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def cash_flows_page(t: Tables) -> DataFrame:
    """The newest 200 movements; a top-k report."""
    return t("orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")


@query("stream_counts", "SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(t: Tables) -> DataFrame:
    """Tumbling daily counts, as the streaming query gives them on a complete input."""
    from quantloom.streaming.upsert import windowed_counts

    counts = windowed_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counts.select("event_type", F.to_date("window.start").alias("day"), "n")
