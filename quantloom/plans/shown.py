"""What users are shown and what they send: display rounding, sorts, names, lists, files with a mark, checked holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import clip, round_away
from quantloom.functions.text import normalize_text
from quantloom.operators import html, state
from quantloom.operators.ranking import latest_per, numbered_all
from quantloom.operators.statements import DATE
from quantloom.plans.crosssection import _SECTION_SQL, FACTORS, _section, _sql
from quantloom.plans.market import _LEGACY_SQL, _away, legacy_company_scores
from quantloom.plans.registry import query
from quantloom.plans.score import DERIVED_SQL, MARKET_SQL, PROFIT_SQL, RANKED_SQL, SALES_SQL, _view, score_view
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables
from quantloom.sources.files import ensure_table, replace_table, write_marked_csv
from quantloom.sources.parameters import select
from quantloom.sources.store import fresh_folder

_FINAL = (SALES_SQL, PROFIT_SQL, MARKET_SQL, DERIVED_SQL, RANKED_SQL)
#: Digits of each shown column, and the growths that are cut for display; fixed values.
DIGITS = {"s12": 2, "p12": 2, "sg_raw": 2, "sg3_raw": 2, "st": 4, "ttm_eps": 2, "op": 2, "op_ly": 2, "price": 2, "pe_raw": 2, "return7": 2, "return30": 2, "return90": 2,
          "avg_value": 2, "volatility": 4, "position90": 2, "dq": 4, "nm_raw": 2, "om_raw": 2, "mt_raw": 2, "coverage": 2, "non_operating": 2, "roe_raw": 2, "lev_raw": 2,
          "cr_raw": 2, "cc_raw": 3, "npg_raw": 2, "opg_raw": 2, "rg_raw": 2}
CUT, CUT_LOW, CUT_HIGH = ("npg_raw", "opg_raw", "rg_raw"), -100, 1000


def _cut_sql(c: str) -> str:
    return f"CASE WHEN {c} > {CUT_HIGH} THEN {CUT_HIGH}e0 WHEN {c} < {CUT_LOW} THEN {CUT_LOW}e0 ELSE {c} END" if c in CUT else c


@query("score_display", _view(*_FINAL, then="SELECT company_id, " + ", ".join(f"{_away(f'({_cut_sql(c)})', d)} AS {c}" for c, d in DIGITS.items()) + " FROM final"))
def score_display(t: Tables) -> DataFrame:
    """The score's figures as they are shown: each column's own digits, halves away from zero, growth cut at -100 and 1000 percent."""
    shown = {c: round_away(clip(F.col(c), CUT_LOW, CUT_HIGH) if c in CUT else F.col(c), d) for c, d in DIGITS.items()}
    return score_view(t).select("company_id", *(x.alias(c) for c, x in shown.items()))


@query("stable_then_growth", with_tables("monthly", "interim", "valuation", then=f"""-- more{_LEGACY_SQL},
listed AS (
  SELECT coalesce(s.company_id, e.company_id) AS company_id, floor(coalesce(eps_growth, 0e0) * 1e2 + 5e-1) / 1e2 AS eps_growth, coalesce(stable, 0) AS stable
  FROM sales s FULL JOIN eps e ON e.company_id = s.company_id LEFT JOIN stable b ON b.company_id = coalesce(s.company_id, e.company_id))
SELECT company_id, stable, eps_growth, row_number() OVER (ORDER BY stable DESC, eps_growth DESC, company_id) AS place FROM listed"""))
def stable_then_growth(t: Tables) -> DataFrame:
    """The preset order of the list: companies of steady growth first, then by growth of earnings."""
    rows = legacy_company_scores(t).select("company_id", "stable", "eps_growth")
    return numbered_all(rows, [F.desc("stable"), F.desc("eps_growth"), F.asc("company_id")])


@query("sorted_both_ways", with_tables("valuation", then="""
SELECT company_id, row_number() OVER (ORDER BY pe ASC NULLS LAST, company_id) AS pe_up, row_number() OVER (ORDER BY pe DESC NULLS LAST, company_id) AS pe_down,
       row_number() OVER (ORDER BY lower(company_name) DESC NULLS LAST, company_id) AS name_down FROM valuation"""))
def sorted_both_ways(t: Tables) -> DataFrame:
    """The place of each company by a number and by its name, up and down; missing values are last either way, and letters' case
    doesn't count."""
    rows = domain.valuations(t).select("company_id", "pe", F.lower("company_name").alias("name"))
    for name, order in (("pe_up", F.col("pe").asc_nulls_last()), ("pe_down", F.col("pe").desc_nulls_last()), ("name_down", F.col("name").desc_nulls_last())):
        rows = numbered_all(rows, [order, F.asc("company_id")], name)
    return rows.drop("pe", "name")


@query("holdings_with_names", with_tables("held", then="""
SELECT user_id, item_id, quantity, CASE WHEN item_id % 3 <> 0 AND p_name IS NOT NULL THEN p_name ELSE 'item ' || item_id END AS name FROM held LEFT JOIN part ON p_partkey = item_id"""))
def holdings_with_names(t: Tables) -> DataFrame:
    """Each holding under the live name of its item, or the name that it was bought under where the live one is empty or missing."""
    live = t("part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_name")).alias("live"))
    bought = domain.holdings(t).withColumn("bought", F.concat(F.lit("item "), F.col("item_id")))
    name = F.coalesce(F.nullif(F.trim("live"), F.lit("")), "bought")
    return bought.join(live, "item_id", "left").select("user_id", "item_id", "quantity", name.alias("name"))


@query("newest_report_like", with_tables("interim", then="""
SELECT company_id, jyear, jmonth, (2001 - jyear) * 12 + 12 - jmonth AS age FROM interim JOIN supplier ON s_suppkey = company_id WHERE s_name LIKE '%7'
ORDER BY jyear DESC, jmonth DESC, company_id LIMIT 1"""))
def newest_report_like(t: Tables) -> DataFrame:
    """The newest report of a company whose name is like a pattern, with its age in months: one row, as asked for."""
    return select(t, """SELECT company_id, jyear, jmonth, (:year - jyear) * 12 + :month - jmonth AS age FROM {reports} JOIN {companies} USING (company_id)
                        WHERE company_name LIKE :pattern ORDER BY jyear DESC, jmonth DESC, company_id LIMIT 1""", pattern="%7", year=2001, month=12)


@query("first_name_with", "SELECT min(s_name) AS company_name, count(*) AS hits FROM supplier WHERE contains(s_name, '7')")
def first_name_with(t: Tables) -> DataFrame:
    """The first name that holds a text, and how many do."""
    return domain.companies(t).filter(F.col("company_name").contains("7")).agg(F.min("company_name").alias("company_name"), F.count(F.lit(1)).alias("hits"))


@query("factor_counts", _sql(f"{_SECTION_SQL}\n" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, count({f}) AS known, count(DISTINCT day) FILTER ({f} IS NOT NULL) AS dates, count(DISTINCT company_id) FILTER ({f} IS NOT NULL) AS companies FROM section" for f in FACTORS)))
def factor_counts(t: Tables) -> DataFrame:
    """How often each of the sixteen factors is known, on how many dates and of how many companies."""
    rows = _section(t)
    counts = [F.count(f).alias(f) for f in FACTORS]
    companies = rows.groupBy("company_id").agg(*counts).agg(*(x for f in FACTORS for x in (F.sum(f).alias(f), F.count_if(F.col(f) > 0).alias(f"{f}_companies"))))
    dates = rows.groupBy("day").agg(*counts).agg(*(F.count_if(F.col(f) > 0).alias(f"{f}_dates") for f in FACTORS))
    both = companies.crossJoin(F.broadcast(dates))  # a row each
    known = lambda f: F.coalesce(f, F.lit(0).cast("long")).alias("known")
    listed = F.array(*(F.struct(F.lit(f).alias("factor"), known(f), F.col(f"{f}_dates").alias("dates"), F.col(f"{f}_companies").alias("companies")) for f in FACTORS))
    return both.select(F.inline(listed))


def report_date(page: Column, header: Column) -> Column:
    """The date that a page gives in its own element, else the first in a table's header; null without either."""
    own = F.nullif(F.regexp_extract(normalize_text(html.element_text(page, "ctl00_lblPeriodEndToDate")), DATE, 0), F.lit(""))
    return F.coalesce(own, F.nullif(F.regexp_extract(normalize_text(header), DATE, 0), F.lit("")))


@query("page_report_dates", """
SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN '1402/06/31' WHEN page_id % 4 = 2 THEN '1401/12/29' END AS report_date FROM pages""")
def page_report_dates(t: Tables) -> DataFrame:
    """The date of each page's report: of its element, or of the header where the element is missing or says something else."""
    k = F.col("page_id") % 4
    own = F.when(k < 2, '<b id="ctl00_lblPeriodEndToDate">۱۴۰۲/۰۶/۳۱</b>').when(k == 2, '<b id="ctl00_lblPeriodEndToDate">not yet</b>').otherwise("")
    head = F.when(k % 2 == 0, "<th>period up to 1401/12/29</th>").otherwise("<th>period</th>")
    page = F.concat(F.coalesce("html", F.lit("")), F.lit("--></script></style>"), own, F.lit("<table><thead><tr>"), head, F.lit("</tr></thead><tbody><tr><td>1</td></tr></table>"))
    pages = t("pages").select("page_id", page.alias("html"))
    heads = html.parsed(pages).filter("part = 'head' AND cell LIKE 'period%'").groupBy("page_id").agg(F.max("cell").alias("header"))
    return pages.join(heads, "page_id", "left").select("page_id", report_date(F.col("html"), F.col("header")).alias("report_date"))


@query("holdings_checked", """
WITH sent AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'c' || o_custkey END AS company, (o_orderkey % 7 - 1)::DOUBLE AS quantity,
         CASE WHEN o_orderkey % 5 = 0 THEN 0e0 WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT id, CASE WHEN trim(company) = '' THEN 'company_id is required' WHEN quantity <= 0 THEN 'quantity must be greater than 0'
                WHEN coalesce(price, 0) <= 0 THEN 'buy_price must be greater than 0' END AS error FROM sent""")
def holdings_checked(t: Tables) -> DataFrame:
    """What users send as holdings, with the first reason for which one is refused; null for those that are taken."""
    k = F.col("o_orderkey")
    sent = t("orders").select(
        k.alias("id"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit("c"), F.col("o_custkey"))).alias("company"), (k % 7 - 1).cast("double").alias("quantity"),
        F.when(k % 5 == 0, 0.0).when(k % 13 != 0, F.col("o_totalprice")).alias("price"))
    return sent.select("id", holding_error(F.col("company"), F.col("quantity"), F.col("price")).alias("error"))


def holding_error(company: Column, quantity: Column, price: Column) -> Column:
    over = lambda x: F.coalesce(x > 0, F.lit(False))
    return F.when(F.trim(F.coalesce(company, F.lit(""))) == "", "company_id is required").when(~over(quantity), "quantity must be greater than 0").when(
        ~over(price), "buy_price must be greater than 0")


@query("newest_links", """
WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS link, DATE '2024-01-01' + (page_id % 400)::INT AS day FROM pages),
once AS (SELECT link, max(day) AS day FROM found WHERE day >= DATE '2024-03-01' GROUP BY 1)
SELECT link, day FROM once ORDER BY day DESC, link LIMIT 100""")
def newest_links(t: Tables) -> DataFrame:
    """The hundred newest links from a date on, each once, with its last date: a list of reports of limited length."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    found = t("pages").select(day.alias("day"), F.explode(html.links(F.col("html"))).alias("link")).filter("day >= DATE'2024-03-01'")
    return found.groupBy("link").agg(F.max("day").alias("day")).orderBy(F.desc("day"), "link").limit(100)


#: Headers of the list as users see it, and each column's digits; fixed values.
EXPORT = {"company_name": ("نام شرکت", None), "sales_growth": ("رشد فروش", 2), "eps_growth": ("رشد سود", 2), "pe": ("P/E", 1), "price": ("قیمت", 0), "operation": ("حاشیه عملیاتی", 2), "stable": ("پایدار", None)}


@query("csv_export", with_tables("monthly", "interim", "valuation", then=f"""-- more{_LEGACY_SQL},
listed AS (
  SELECT v.company_name, floor(coalesce(sales_growth, 0e0) * 1e2 + 5e-1) / 1e2 AS sales_growth, floor(coalesce(eps_growth, 0e0) * 1e2 + 5e-1) / 1e2 AS eps_growth, coalesce(pe, 0e0) AS pe, coalesce(price, 0e0) AS price,
         floor(coalesce(operation, 0e0) * 1e2 + 5e-1) / 1e2 AS operation, coalesce(stable, 0) AS stable
  FROM sales s FULL JOIN eps e ON e.company_id = s.company_id LEFT JOIN stable b ON b.company_id = coalesce(s.company_id, e.company_id) LEFT JOIN valuation v ON v.company_id = coalesce(s.company_id, e.company_id))
SELECT company_name || ' says ''hi'',' || printf('%.2f,%.2f,%.1f,%.0f,%.2f,', sales_growth, eps_growth, floor(pe * 1e1 + 5e-1) / 1e1, price, operation) || stable AS line FROM listed
"""))
def csv_export(t: Tables) -> DataFrame:
    """The list as the files that users download: the mark, headers in their language, each column's digits, quotes made single and
    line ends made blanks. Read back as the files' lines, without those of headers."""
    rows = legacy_company_scores(t).withColumn("company_name", F.concat(F.col("company_name"), F.lit(' says\n"hi"')))
    rows = rows.withColumn("pe", F.floor(F.col("pe") * 10.0 + 0.5) / 10.0)
    folder = fresh_folder(t.spark, "csv")
    write_marked_csv(rows, folder, EXPORT)
    return t.spark.read.text(folder).select(F.col("value").alias("line")).filter(~F.col("line").contains(EXPORT["company_name"][0]))


@query("table_ensured", with_tables("monthly", then="""
SELECT company_id, report_key, value3, NULL::VARCHAR AS note FROM monthly WHERE report_key < 199500
UNION ALL SELECT company_id, report_key, value3, 'n' || company_id FROM monthly WHERE report_key >= 199500"""))
def table_ensured(t: Tables) -> DataFrame:
    """A table that is made where there is none, filled, given a column that it lacks, and filled again; asking again changes
    nothing."""
    folder, rows = fresh_folder(t.spark, "ensured"), domain.monthly_sales(t).select("company_id", "report_key", "value3")
    ensure_table(t.spark, folder, "company_id long, report_key int, value3 double")
    rows.filter("report_key < 199500").write.mode("append").parquet(folder)
    for _ in range(2):
        ensure_table(t.spark, folder, "company_id long, report_key int, value3 double, note string")
    rows.filter("report_key >= 199500").withColumn("note", F.concat(F.lit("n"), F.col("company_id"))).write.mode("append").parquet(folder)
    return ensure_table(t.spark, folder, "company_id long, report_key int, value3 double, note string")


@query("table_replaced", "SELECT s_suppkey AS id, 5e0 AS before, CASE WHEN s_suppkey % 2 = 0 THEN 7e0 END AS after FROM supplier")
def table_replaced(t: Tables) -> DataFrame:
    """A table that is replaced as a whole: what it held before, and what it holds after."""
    folder, ids = fresh_folder(t.spark, "replaced"), t("supplier").select(F.col("s_suppkey").alias("id"))
    first = replace_table(ids.withColumn("pe", F.lit(5.0)), folder)
    second = replace_table(ids.filter("id % 2 = 0").withColumn("pe", F.lit(7.0)), folder)
    return first.select("id", F.col("pe").alias("before")).join(second.select("id", F.col("pe").alias("after")), "id", "left")


@query("versions_and_current", with_tables("monthly", then="""
SELECT company_id, report_key, value3::BIGINT + CASE WHEN company_id % 2 = 0 THEN 1 ELSE 0 END AS value3,
       sha256('{"value3":' || (value3::BIGINT + CASE WHEN company_id % 2 = 0 THEN 1 ELSE 0 END) || '}') AS content_hash, CASE WHEN company_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS versions FROM monthly"""))
def versions_and_current(t: Tables) -> DataFrame:
    """Reports come again, half of them changed: the current rows with their hash, and how many versions each has had."""
    rows = domain.monthly_sales(t).select("company_id", "report_key", F.col("value3").cast("long").alias("value3"))
    held, keys = rows.withColumn("content_hash", state.content_hash("value3")), ["company_id", "report_key"]
    again = rows.withColumn("value3", F.col("value3") + F.when(F.col("company_id") % 2 == 0, 1).otherwise(0))
    now, versions = state.versioned_upsert(held, held.select(*keys, "content_hash"), again, keys, ["value3"])
    return now.join(versions.groupBy(*keys).agg(F.countDistinct("content_hash").alias("versions")), keys)


@query("holdings_as_json", with_tables("held", then="""
SELECT user_id, '{' || string_agg('"' || item_id || '":' || quantity::BIGINT, ',' ORDER BY item_id) || '}' AS held FROM held GROUP BY 1"""))
def holdings_as_json(t: Tables) -> DataFrame:
    """Each user's holdings as one JSON object, item to quantity, items in order."""
    entries = F.array_sort(F.collect_list(F.struct("item_id", F.col("quantity").cast("long").alias("q"))))
    named = F.transform(entries, lambda e: F.struct(e["item_id"].cast("string").alias("k"), e["q"].alias("v")))
    return domain.holdings(t).groupBy("user_id").agg(F.to_json(F.map_from_entries(named)).alias("held"))


@query("history_total_redone", """
WITH days AS (SELECT o_custkey AS person, o_orderdate::DATE AS day, sum(floor(o_totalprice * 100.0 + 0.5)) AS spent FROM orders GROUP BY 1, 2),
history AS (SELECT person, day, 1e0 AS total FROM days WHERE person % 3 <> 0),
latest AS (SELECT person, max(day) AS day, sum(spent) AS fresh FROM days GROUP BY 1)
SELECT h.person, h.day, CASE WHEN l.day IS NOT NULL THEN fresh ELSE total END AS total FROM history h LEFT JOIN latest l ON l.person = h.person AND l.day = h.day""")
def history_total_redone(t: Tables) -> DataFrame:
    """The total of a person's latest priced day is computed anew from all that they hold by then, where the history has that day; no
    row is added, and older rows stay."""
    spent = t("orders").groupBy(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.floor(F.col("o_totalprice") * 100.0 + 0.5).cast("double")).alias("spent"))
    history = spent.filter("person % 3 <> 0").select("person", "day", F.lit(1.0).alias("total"))
    latest = spent.groupBy("person").agg(F.max("day").alias("day"), F.sum("spent").alias("total"))
    known = latest.join(history.select("person", "day"), ["person", "day"], "left_semi")
    return state.update_by_key(history, known, ["person", "day"], ["total"])


@query("collected_twice", with_tables("market", then="""
SELECT company_id, max(day) AS day, arg_max(close, (day, c)) AS close FROM (
  SELECT company_id, day, close, 1 AS c FROM market UNION ALL SELECT company_id, day, close + 1, 2 FROM market WHERE company_id % 2 = 0) GROUP BY 1"""))
def collected_twice(t: Tables) -> DataFrame:
    """The latest price of each company by two keys, its day, then when it was collected."""
    rows = domain.market_prices(t).select("company_id", "day", "close")
    twice = rows.withColumn("collected", F.lit(1)).unionByName(rows.filter("company_id % 2 = 0").select("company_id", "day", (F.col("close") + 1).alias("close"), F.lit(2).alias("collected")))
    return latest_per(twice, ["company_id"], [F.desc("day"), F.desc("collected")]).drop("collected")
