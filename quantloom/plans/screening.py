"""Screens and small reports: predicates, clamped limits, sorts, files, joins by name with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import calendar
from quantloom.functions.numeric import ratio, round_half, to_amount, to_decimal, to_whole
from quantloom.functions.text import compact_number, is_identifier, is_md5, normalize_letters, normalize_name, percent_text, url_join, url_parameter, with_page
from quantloom.operators import elements, state
from quantloom.operators.ranking import latest_per, numbered_all
from quantloom.plans.market import profit_history, steady_growth
from quantloom.plans.portfolio import _LIVE_SQL, _valued, live_prices, value_holdings
from quantloom.plans.registry import query
from quantloom.plans.score import AS_OF_DATE, DERIVED_SQL, FACTORS, MARKET_SQL, PROFIT_SQL, RANKED_SQL, SALES_SQL, WEIGHTS, _view, score_view
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables
from quantloom.sources.files import first_present, read_documents, read_fields, read_json, read_overrides
from quantloom.sources.store import fresh_folder, written

_FINAL = (SALES_SQL, PROFIT_SQL, MARKET_SQL, DERIVED_SQL, RANKED_SQL)
#: Default and greatest number of rows of each list, fixed values.
LIMITS = {"top": (20, 1000), "history": (365, 5000), "monthly": (24, 60), "market": (90, 250), "profit": (8, 20), "flows": (200, 2000), "search": (20, 50)}


def clamped(text: Column, which: str) -> Column:
    """A limit as a user gives it: the default where it is no positive number, at most the greatest."""
    default, most = LIMITS[which]
    n = F.trim(text).try_cast("int")
    return F.when(n > 0, F.least(n, F.lit(most))).otherwise(default)


@query("limits_clamped", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 20 WHEN c_custkey % 4 = 1 THEN 20 ELSE least(c_custkey * 7, 1000) END AS top_rows,
       CASE WHEN c_custkey % 4 < 2 THEN 365 ELSE least(c_custkey * 7, 5000) END AS history_rows FROM customer WHERE c_custkey > 0""")
def limits_clamped(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    given = F.when(k % 4 == 0, "many").when(k % 4 == 1, (-k).cast("string")).otherwise(F.concat(F.lit(" "), (k * 7).cast("string")))
    return t("customer").filter(k > 0).select("c_custkey", clamped(given, "top").cast("long").alias("top_rows"), clamped(given, "history").cast("long").alias("history_rows"))


@query("in_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def in_list(t: Tables) -> DataFrame:
    """A list made at run time, as a semi join."""
    return t("customer").select("c_custkey", "c_name").join(t("orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("either_name", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'small ring' OR p_brand = 'Brand#13' ORDER BY p_partkey LIMIT 365")
def either_name(t: Tables) -> DataFrame:
    """By one name or the other; a top-k report."""
    return t("part").filter((F.col("p_name") == "small ring") | (F.col("p_brand") == "Brand#13")).orderBy("p_partkey").limit(365).select("p_partkey", "p_name", "p_brand")


@query("name_pattern", "SELECT s_suppkey, s_name FROM supplier WHERE trim(s_name) LIKE trim('  Supplier#0000000_7 ')")
def name_pattern(t: Tables) -> DataFrame:
    """A user's text as a pattern, blanks about it aside; without marks it means equality."""
    return t("supplier").filter(F.like(F.trim("s_name"), F.trim(F.lit("  Supplier#0000000_7 ")))).select("s_suppkey", "s_name")


@query("search_three_fields", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), 'ring')")
def search_three_fields(t: Tables) -> DataFrame:
    hit = lambda c, q: F.lower(c).contains(q)
    return t("part").filter(hit("p_name", "ring") | hit("p_brand", "#1") | hit("p_type", "ring")).select("p_partkey")


@query("due_for_refresh", with_tables("market", then="""
SELECT company_id, max(day) AS last_day, date_diff('day', max(day), DATE '2001-12-01') AS age, (date_diff('day', max(day), DATE '2001-12-01') >= 30)::INT AS due
FROM market GROUP BY 1"""))
def due_for_refresh(t: Tables) -> DataFrame:
    """The latest day of each company, and whether it is old enough to run again: 30 days."""
    age = F.datediff(F.lit(AS_OF_DATE).cast("date"), "last_day")
    return domain.market_prices(t).groupBy("company_id").agg(F.max("day").alias("last_day")).withColumn("age", age.cast("long")).withColumn("due", (F.col("age") >= 30).cast("int"))


@query("date_key_floor", """
SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS date_key FROM orders WHERE o_orderkey % 3 <> 0 AND strftime(o_orderdate, '%Y/%m/%d') >= '1998/06/01'""")
def date_key_floor(t: Tables) -> DataFrame:
    """Well-formed date keys from a floor on; others are left out."""
    shown = F.date_format("o_orderdate", "yyyy/MM/dd")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(shown, "/", "-")).otherwise(shown)
    return t("orders").select("o_orderkey", key.alias("date_key")).filter(F.col("date_key").rlike("^[0-9]{4}/[0-9]{2}/[0-9]{2}$") & (F.col("date_key") >= "1998/06/01"))


@query("universe_filter", with_tables("monthly", "interim", "market", then="""
SELECT m.company_id, m.days, s.months, r.reports FROM (SELECT company_id, count(*) AS days FROM market GROUP BY 1) m
JOIN (SELECT company_id, count(*) AS months FROM monthly GROUP BY 1) s USING (company_id) JOIN (SELECT company_id, count(*) AS reports FROM interim GROUP BY 1) r USING (company_id)
WHERE days >= 30 AND months >= 12 AND reports >= 1 AND (SELECT count(*) FROM supplier) >= 6"""))
def universe_filter(t: Tables) -> DataFrame:
    """Companies with a report, thirty days of prices and twelve months of sales."""
    count = lambda df, name: df.groupBy("company_id").agg(F.count(F.lit(1)).alias(name))
    rows = count(domain.market_prices(t), "days").join(count(domain.monthly_sales(t), "months"), "company_id").join(count(domain.interim_reports(t), "reports"), "company_id")
    return rows.filter("days >= 30 AND months >= 12 AND reports >= 1").select("company_id", "days", "months", "reports")


@query("old_reports_cut", """
SELECT page_id, 1390 + page_id % 15 AS y, page_id % 12 + 1 AS m FROM pages WHERE (1390 + page_id % 15) * 10000 + (page_id % 12 + 1) * 100 + 29 > 13971229""")
def old_reports_cut(t: Tables) -> DataFrame:
    """Reports of Jalali dates after a cut-off, by keys of numbers."""
    y, m = (F.col("page_id") % 15 + 1390).alias("y"), (F.col("page_id") % 12 + 1).alias("m")
    rows = t("pages").select("page_id", y, m).withColumn("text", calendar.key_text(F.col("y").cast("int"), F.col("m").cast("int"), F.lit(29)))
    return rows.filter(calendar.date_key(F.col("text")) > 13971229).select("page_id", "y", "m")


@query("report_dates", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN NULL WHEN 3 THEN DATE '2024-03-20' ELSE NULL END AS day,
       CASE WHEN o_orderkey % 2 = 0 THEN DATE '2020-01-01' + (o_orderkey % 1000)::INT END AS stamped,
       CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 1000 <= 10 THEN DATE '2020-01-01' + (o_orderkey % 1000)::INT ELSE DATE '2020-01-01' END AS fresh,
       CASE WHEN o_orderkey % 5 = 3 THEN '1402/10/01' WHEN o_orderkey % 5 = 4 THEN '1402/12/29' END AS months_ago
FROM orders""")
def report_dates(t: Tables) -> DataFrame:
    """Dates in either calendar, time stamps in seconds and milliseconds, and dates months back."""
    k = F.col("o_orderkey")
    text = (F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(k % 5 == 2, "1403/13/01")
            .when(k % 5 == 3, "۱۴۰۳/۰۱/۰۱").otherwise("1402/12/30"))
    seconds = F.unix_date(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1000).cast("int"))).cast("long") * 86400 + 5
    stamp = F.when(k % 4 == 0, seconds.cast("string")).when(k % 4 == 2, (seconds * 1000).cast("string")).when(k % 4 == 1, "1500").otherwise("99999999999")
    stamped, today = calendar.epoch_date(stamp, 2024), F.lit("2020-01-01").cast("date")
    ago = F.when(k % 5 == 3, calendar.jalali_months_ago(F.lit(1403), F.lit(1), F.lit(1), 3)).when(k % 5 == 4, calendar.jalali_months_ago(F.lit(1403), F.lit(1), F.lit(31), 1))
    rows = t("orders").select("o_orderkey", calendar.eight_digits(text).alias("key"), stamped.alias("stamped"), ago.alias("months_ago"))
    return rows.select("o_orderkey", calendar.either_calendar(F.col("key")).alias("day"), "stamped", calendar.fresh_or(F.col("stamped"), today, today).alias("fresh"), "months_ago")


# ---- files ----------------------------------------------------------------------------------------------------------
@query("json_symbols", """
SELECT s_suppkey::VARCHAR AS instrument_code, 'S' || s_suppkey AS symbol, s_suppkey * 10 AS closing_price, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 9 END AS yesterday_price,
       CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS closing_change, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey > 0 THEN floor(1e6 / 9e0 + 5e-1) / 1e4 END AS closing_change_percent
FROM supplier""")
def json_symbols(t: Tables) -> DataFrame:
    """A snapshot of JSON lines, fields by either of two names, as price rows; changes come from the day before."""
    folder, k = fresh_folder(t.spark, "symbols"), F.col("s_suppkey")
    old = F.when(k % 3 != 0, (k * 9).cast("string"))
    t("supplier").select(F.when(k % 2 == 0, k.cast("string")).otherwise("").alias("id"), k.cast("string").alias("isin"), F.concat(F.lit("S"), k.cast("string")).alias("l18"),
                         F.when(k % 2 == 0, F.format_number(k * 10, 0)).alias("pc"), (k * 10).cast("string").alias("Price"), old.alias("py")).write.json(folder)
    rows = read_json(t.spark, folder, "id string, isin string, l18 string, pc string, Price string, py string")
    pc, py = to_whole(first_present(F.col("pc"), F.col("Price"))), to_whole(F.col("py"))
    rows = rows.select(first_present(F.col("id"), F.col("isin"), F.col("l18")).alias("instrument_code"), F.col("l18").alias("symbol"), pc.alias("closing_price"), py.alias("yesterday_price"))
    change = F.col("closing_price") - F.col("yesterday_price")
    return rows.withColumn("closing_change", change).withColumn("closing_change_percent", round_half(change / F.nullif(F.col("yesterday_price").cast("double"), F.lit(0.0)) * 100.0, 4))


@query("semicolon_search", "SELECT s_suppkey::VARCHAR AS instrument_code, 'T' || s_suppkey AS ticker, s_name AS company_name FROM supplier WHERE s_suppkey % 4 <> 0")
def semicolon_search(t: Tables) -> DataFrame:
    """A text answer of fields between semicolons; lines without a ticker are left out."""
    folder, k = fresh_folder(t.spark, "search"), F.col("s_suppkey").cast("string")
    ticker = F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.concat(F.lit("T"), k, F.lit(" ")))
    t("supplier").select(F.concat_ws(";", k, ticker, F.col("s_name"), F.lit("x"), F.lit(""))).write.text(folder)
    return read_fields(t.spark, folder, ["instrument_code", "ticker", "company_name"])


@query("override_file", "SELECT 'شرکت ' || r_regionkey AS symbol, r_name AS value FROM region")
def override_file(t: Tables) -> DataFrame:
    """A file of one JSON object, symbols brought to normal form."""
    folder = fresh_folder(t.spark, "overrides")
    name = F.concat(F.lit(" شركت "), F.col("r_regionkey").cast("string"))
    entries = F.map_from_entries(F.collect_list(F.struct(name, "r_name")))
    t("region").agg(F.to_json(entries).alias("value")).coalesce(1).write.text(folder)
    return read_overrides(t.spark, folder)


@query("ingest_documents", "SELECT n_nationkey AS company_id, n_name AS company_name, (n_nationkey * -1234)::DECIMAL(30,4) AS amount, n_regionkey::BIGINT AS n_facts FROM nation")
def ingest_documents(t: Tables) -> DataFrame:
    """Ingest documents, one object a file with nested facts; amounts are text in the report's own notation."""
    folder, k = fresh_folder(t.spark, "documents"), F.col("n_nationkey")
    amount = F.concat(F.lit("("), F.translate(F.format_number(k * 1234, 0), "0123456789,", "۰۱۲۳۴۵۶۷۸۹٬"), F.lit(")"))
    facts = F.transform(F.when(F.col("n_regionkey") > 0, F.sequence(F.lit(1), F.col("n_regionkey"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("period_order")))
    body = F.to_json(F.struct(k.alias("company_id"), F.col("n_name").alias("company_name"), amount.alias("amount"), facts.alias("facts")))
    t("nation").select(body.alias("value"), k.alias("doc")).repartition("doc").write.partitionBy("doc").text(folder)
    rows = read_documents(t.spark, f"{folder}/doc=*", "company_id int, company_name string, amount string, facts array<struct<period_order:int>>")
    return rows.select("company_id", "company_name", to_decimal(F.col("amount")).alias("amount"), F.size("facts").cast("long").alias("n_facts"))


@query("ingest_outcomes", """
SELECT CASE WHEN p_partkey % 7 = 0 THEN 'failed' WHEN p_partkey % 3 = 0 THEN 'unchanged' ELSE 'saved' END AS outcome, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1""")
def ingest_outcomes(t: Tables) -> DataFrame:
    """What became of each document: new content is saved, known content unchanged, and what can't be read failed."""
    k = F.col("p_partkey")
    arrived = t("part").select("p_partkey", F.when(k % 7 == 0, "not json").otherwise(F.to_json(F.struct("p_name", "p_size"))).alias("body"))
    known = t("part").filter(k % 3 == 0).select("p_partkey", F.sha2(F.to_json(F.struct("p_name", "p_size")), 256).alias("hash"))
    rows = arrived.join(known, "p_partkey", "left")
    outcome = F.when(F.try_parse_json("body").isNull(), "failed").when(F.sha2("body", 256) == F.col("hash"), "unchanged").otherwise("saved")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("text_marks", """
SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, page_id % 2 = 0 AS md5_like, page_id % 3 <> 0 AS identifier,
       'https://a.example/list?PageNumber=' || page_id AS next_page, 'https://a.example/b/' || page_id AS link, replace('كيك' || page_id, 'كيك', 'کیک') AS letters,
       CASE WHEN page_id = 0 THEN '0' WHEN page_id < 1000 THEN page_id || '.0M' WHEN page_id < 1000000 THEN printf('%.1fB', floor(page_id / 1e2 + 5e-1) / 1e1) ELSE printf('%.1fT', floor(page_id / 1e5 + 5e-1) / 1e1) END AS compact,
       '+' || page_id || '.0%' AS percent FROM pages""")
def text_marks(t: Tables) -> DataFrame:
    """Small text functions over all pages: parameters and page numbers of addresses, links, identifiers, numbers in words."""
    k, text = F.col("page_id"), F.col("page_id").cast("string")
    return t("pages").select(
        "page_id", F.coalesce(url_parameter(F.col("url"), "page"), F.lit("")).alias("page"), is_md5(F.when(k % 2 == 0, F.md5(text)).otherwise(text)).alias("md5_like"),
        is_identifier(F.concat(F.when(k % 3 == 0, "9t").otherwise("t"), text)).alias("identifier"), with_page(F.lit("https://a.example/list?PageNumber=1"), k).alias("next_page"),
        url_join(F.lit("https://a.example/b/c?d=1"), text).alias("link"), normalize_letters(F.concat(F.lit("كيك"), text)).alias("letters"),
        compact_number(k * 1e6).alias("compact"), percent_text(k.cast("double")).alias("percent"))


# ---- joins by name, sorts, groups -----------------------------------------------------------------------------------
@query("merge_by_id_or_name", """
WITH lots AS (SELECT c_custkey % 50 AS k, count(*) AS n, sum(c_nationkey)::BIGINT AS total FROM customer GROUP BY 1),
by_id AS (SELECT k AS id, n, total FROM lots WHERE k < 30), by_name AS (SELECT 'Supplier#' || lpad(k::VARCHAR, 9, '0') AS name, n, total FROM lots WHERE k >= 20)
SELECT s_suppkey, coalesce(i.n, b.n) AS n, coalesce(i.total, b.total) AS total FROM supplier LEFT JOIN by_id i ON i.id = s_suppkey LEFT JOIN by_name b ON b.name = s_name""")
def merge_by_id_or_name(t: Tables) -> DataFrame:
    """Left join by id, and by normal name where the id finds nothing."""
    lots = t("customer").groupBy((F.col("c_custkey") % 50).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("total"))
    by_id = lots.filter("k < 30").select(F.col("k").alias("s_suppkey"), F.struct("n", "total").alias("by_id"))
    name = F.concat(F.lit(" Supplier#"), F.lpad(F.col("k").cast("string"), 9, "0"))
    by_name = lots.filter("k >= 20").select(normalize_name(name).alias("name"), F.struct("n", "total").alias("by_name"))
    rows = t("supplier").select("s_suppkey", normalize_name(F.col("s_name")).alias("name")).join(by_id, "s_suppkey", "left").join(by_name, "name", "left")
    return rows.select("s_suppkey", F.coalesce("by_id", "by_name").alias("x")).select("s_suppkey", "x.n", "x.total")


@query("overlay_by_id", """
SELECT p_partkey, CASE WHEN l_partkey IS NOT NULL THEN lines ELSE 0 END AS lines, coalesce(newer, p_name) AS name
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS lines, CASE WHEN count(*) > 25 THEN 'busy' END AS newer FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def overlay_by_id(t: Tables) -> DataFrame:
    """Left join by id in which values of the right side, where it has any, take the place of the left's."""
    right = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("lines"))
    right = right.withColumn("newer", F.when(F.col("lines") > 25, "busy"))
    return t("part").join(right, "p_partkey", "left").select("p_partkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("newer", "p_name").alias("name"))


@query("known_names_only", "SELECT p_partkey FROM part WHERE p_name IN (SELECT DISTINCT p_name FROM part WHERE p_size > 45)")
def known_names_only(t: Tables) -> DataFrame:
    known = t("part").filter("p_size > 45").select(normalize_name(F.col("p_name")).alias("name"))
    return t("part").select("p_partkey", normalize_name(F.concat(F.lit(" "), F.col("p_name"))).alias("name")).join(known, "name", "left_semi").select("p_partkey")


@query("preset_sort", with_tables("interim", then="""-- more
history AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY jyear DESC, jmonth DESC) AS rn FROM interim)
SELECT company_id, rn_pos FROM (SELECT company_id, row_number() OVER (ORDER BY (net_profit > 0)::INT DESC, net_profit DESC, company_id) AS rn_pos FROM history WHERE rn = 1) WHERE rn_pos <= 1000"""))
def preset_sort(t: Tables) -> DataFrame:
    """Companies in profit first, then by profit; at most a thousand, a top-k report."""
    last = profit_history(t).filter("rn = 1")
    first = last.orderBy((F.col("net_profit") > 0).cast("int").desc(), F.desc("net_profit"), "company_id").limit(1000)
    return first.withColumn("rn_pos", F.row_number().over(Window.orderBy((F.col("net_profit") > 0).cast("int").desc(), F.desc("net_profit"), "company_id")).cast("long")).select("company_id", "rn_pos")


@query("chart_series", with_tables("market", then="SELECT company_id, day, close FROM market WHERE close > 0 AND company_id = 3 ORDER BY day LIMIT 5000"))
def chart_series(t: Tables) -> DataFrame:
    """One company's closes in order of time, without empty days."""
    return domain.market_prices(t).filter("close > 0 AND company_id = 3").orderBy("day").limit(5000).select("company_id", "day", "close")


@query("allocation_list", with_tables("held", then=f"""-- more{_LIVE_SQL}
SELECT user_id, h.item_id, floor(quantity * price + 5e-1) AS value, row_number() OVER (PARTITION BY user_id ORDER BY floor(quantity * price + 5e-1) DESC, h.item_id) AS place
FROM held h JOIN live l ON l.item_id = h.item_id WHERE quantity * price > 0"""))
def allocation_list(t: Tables) -> DataFrame:
    """What each user's holdings are worth, those with a price, greatest first."""
    rows = value_holdings(domain.holdings(t), live_prices(t)).filter("value > 0").select("user_id", "item_id", round_half(F.col("value"), 0).alias("value"))
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "item_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


@query("events_by_instrument", with_tables("market", then="""-- more
steps AS (SELECT *, lag(close) OVER d AS earlier FROM market WINDOW d AS (PARTITION BY company_id ORDER BY day)),
big AS (SELECT company_id, day FROM steps WHERE earlier > 0 AND abs(close - earlier) / earlier > 0.9)
SELECT company_id, min(day) AS first_day, count(*) AS n, array_to_string(list(strftime(day, '%Y-%m-%d') ORDER BY day DESC), ',') AS days FROM big GROUP BY 1"""))
def events_by_instrument(t: Tables) -> DataFrame:
    """Very large moves of each company as one row, the days listed newest first."""
    before = F.lag("close").over(Window.partitionBy("company_id").orderBy("day"))
    big = domain.market_prices(t).withColumn("before", before).filter((F.col("before") > 0) & (F.abs(F.col("close") - F.col("before")) / F.col("before") > 0.9))
    days = F.reverse(F.array_sort(F.collect_list(F.date_format("day", "yyyy-MM-dd"))))
    return big.groupBy("company_id").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("n"), F.array_join(days, ",").alias("days"))


@query("history_pages", """
SELECT ps, day, page FROM (SELECT s_suppkey AS ps, (DATE '2020-01-01' + (r * 3)::INT) AS day, r % 4 + 1 AS page FROM supplier, range(5) v(r)
  UNION ALL SELECT s_suppkey, DATE '2020-01-01' + (r * 6)::INT, 9 FROM supplier, range(2) v(r)) QUALIFY row_number() OVER (PARTITION BY ps, day ORDER BY page DESC) = 1""")
def history_pages(t: Tables) -> DataFrame:
    """Pages of a history overlap; of each day the latest page's row stays."""
    k, day = F.col("s_suppkey").alias("ps"), lambda r, n: F.date_add(F.lit("2020-01-01").cast("date"), (r * n).cast("int"))
    early = t("supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")).select("ps", day(F.col("r"), 3).alias("day"), (F.col("r") % 4 + 1).cast("long").alias("page"))
    late = t("supplier").select(k, F.explode(F.sequence(F.lit(0), F.lit(1))).alias("r")).select("ps", day(F.col("r"), 6).alias("day"), F.lit(9).cast("long").alias("page"))
    return latest_per(early.unionByName(late), ["ps", "day"], [F.desc("page")])


@query("duplicate_month_sum", with_tables("monthly", then="SELECT company_id, report_key, sum(v) AS value FROM (SELECT company_id, report_key, value3 AS v FROM monthly UNION ALL SELECT company_id, report_key, value1 FROM monthly WHERE value1 > 3) GROUP BY 1, 2"))
def duplicate_month_sum(t: Tables) -> DataFrame:
    """A month that is reported twice counts as the sum."""
    rows = domain.monthly_sales(t)
    twice = rows.select("company_id", "report_key", F.col("value3").alias("v")).unionByName(rows.filter("value1 > 3").select("company_id", "report_key", F.col("value1").alias("v")))
    return twice.groupBy("company_id", "report_key").agg(F.sum("v").alias("value"))


@query("nested_holdings", with_tables("held", then="""
SELECT user_id, sum(quantity) AS quantity, count(*) AS items, max(item_id) AS greatest FROM held GROUP BY 1"""))
def nested_holdings(t: Tables) -> DataFrame:
    """Holdings as one map a user, item to quantity, and read from it again."""
    maps = domain.holdings(t).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "quantity"))).alias("held"))
    total = F.aggregate(F.map_values("held"), F.lit(0.0), lambda a, x: a + x)
    return maps.select("user_id", total.alias("quantity"), F.size("held").cast("long").alias("items"), F.array_max(F.map_keys("held")).alias("greatest"))


@query("stable_companies_first", with_tables("interim", then="SELECT company_id, count(*) AS reports FROM interim GROUP BY 1 HAVING count(*) >= 16"))
def stable_companies_first(t: Tables) -> DataFrame:
    """Companies that the steady-growth rule can judge, with their number of reports."""
    history = profit_history(t)
    judged = steady_growth(history).select("company_id")
    return history.groupBy("company_id").agg(F.count(F.lit(1)).alias("reports")).join(judged, "company_id").filter("reports >= 16")


@query("factor_coverage", with_tables("interim", then="""
SELECT count(*) AS reports, count(net_profit_ly) AS with_last_year, count(net_profit_fyprev) AS with_full_year, count(*) FILTER (revenue > 0) AS earning FROM interim"""))
def factor_coverage(t: Tables) -> DataFrame:
    """How many reports have what a factor needs."""
    return domain.interim_reports(t).agg(F.count(F.lit(1)).alias("reports"), F.count("net_profit_ly").alias("with_last_year"), F.count("net_profit_fyprev").alias("with_full_year"),
                                         F.count_if(F.col("revenue") > 0).alias("earning"))


# ---- household totals -------------------------------------------------------------------------------------------------
@query("family_grand_totals", with_tables("held", then="""-- more
assets AS (SELECT p_partkey AS asset_id, CASE p_partkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'dollar' WHEN 2 THEN 'stock' ELSE 'other' END AS category,
                  CASE p_partkey % 4 WHEN 0 THEN 15e-3 WHEN 1 THEN 1e-2 WHEN 2 THEN 88e-4 ELSE 0e0 END AS rate, p_partkey % 9 <> 0 AS active FROM part),
fam AS (SELECT c_nationkey AS person_id, item_id AS asset_id, sum(quantity) AS quantity, sum(cost) AS cost FROM held JOIN customer ON c_custkey = user_id GROUP BY 1, 2),
latest AS (SELECT asset_id, max_by(price, day) AS price FROM (
  SELECT l_partkey AS asset_id, date_trunc('month', l_shipdate)::DATE AS day, floor(sum(floor(l_extendedprice * 100.0 + 0.5)) / sum(l_quantity) + 0.5) AS price FROM lineitem GROUP BY 1, 2) GROUP BY 1),
valued AS (SELECT f.*, category, floor(quantity * price * (1e0 - rate) + 5e-1) AS value FROM fam f JOIN assets USING (asset_id) LEFT JOIN latest USING (asset_id) WHERE active)
SELECT sum(value) AS holdings, sum(cost) AS cost, (SELECT sum(floor(c_acctbal * 100.0 + 0.5)) FROM customer) AS cash, sum(value) + (SELECT sum(floor(c_acctbal * 100.0 + 0.5)) FROM customer) AS total,
       floor(sum(value) * 3e-2 + 5e-1) AS swing, floor((sum(value) - sum(cost)) / sum(cost) * 1e6 + 5e-1) / 1e6 AS gain_share FROM valued"""))
def family_grand_totals(t: Tables) -> DataFrame:
    """All people's holdings, cash and whole, the gain, and what tomorrow can bring at most: three percent either way."""
    sums = _valued(t).agg(F.sum("value").alias("holdings"), F.sum("cost").alias("cost"))
    cash = t("customer").agg(F.sum(F.floor(F.col("c_acctbal") * 100.0 + 0.5).cast("double")).alias("cash"))
    rows = sums.crossJoin(F.broadcast(cash))  # one row each
    return rows.select("holdings", "cost", "cash", (F.col("holdings") + F.col("cash")).alias("total"), F.floor(F.col("holdings") * 0.03 + 0.5).cast("double").alias("swing"),
                       round_half(ratio(F.col("holdings") - F.col("cost"), F.col("cost")), 6).alias("gain_share"))


@query("history_refresh", """
WITH days AS (SELECT DISTINCT o_custkey AS person, o_orderdate::DATE AS day FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
history AS (SELECT person, max(day) AS day, 1e0 AS total FROM days GROUP BY 1 UNION ALL SELECT person, min(day), 2e0 FROM days GROUP BY 1 HAVING min(day) < max(day)),
priced AS (SELECT o_custkey AS person, max(o_orderdate::DATE) AS day, count(*)::DOUBLE AS fresh FROM orders GROUP BY 1)
SELECT h.person, h.day, CASE WHEN p.day IS NOT NULL THEN p.fresh ELSE h.total END AS total FROM history h LEFT JOIN priced p ON p.person = h.person AND p.day = h.day""")
def history_refresh(t: Tables) -> DataFrame:
    """The history row of the latest priced day is computed again, but only where it is there already."""
    day = F.to_date("o_orderdate").alias("day")
    days = t("orders").filter("o_orderdate < TIMESTAMP'1998-01-01'").select(F.col("o_custkey").alias("person"), day)
    ends = days.groupBy("person").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    history = ends.select("person", F.col("hi").alias("day"), F.lit(1.0).alias("total")).unionByName(ends.filter("lo < hi").select("person", F.col("lo").alias("day"), F.lit(2.0).alias("total")))
    priced = t("orders").groupBy(F.col("o_custkey").alias("person")).agg(F.max(F.to_date("o_orderdate")).alias("day"), F.count(F.lit(1)).cast("double").alias("fresh"))
    return history.join(priced, ["person", "day"], "left").select("person", "day", F.coalesce("fresh", "total").alias("total"))


# ---- projections of the score, lists and deletions ---------------------------------------------------------------------
_WIDE = ("s12", "p12", "s3", "p3", "price", "c7", "c30", "c90", "avg_value", "volatility", "sr_np", "np_p1", "np_prev", "op_ttm", "op_prev", "net_profit_ttm", "eps", "ttm_eps", "pe_raw",
         "sg_raw", "sg3_raw", "st", "npg_raw", "opg_raw", "rg_raw", "om_raw", "nm_raw", "mt_raw", "coverage", "non_operating", "roe_raw", "lev_raw", "cr_raw", "cc_raw", "return7", "return30",
         "return90", "position90", *(f"{f}_rank" for f in FACTORS), *(f"{c}_penalty" for c in WEIGHTS), *(f"{c}_score" for c in WEIGHTS), "quant_score")


@query("score_wide", _view(*_FINAL, then="SELECT company_id, company_name, " + ", ".join(f"floor({c} * 1e3 + 5e-1) / 1e3 AS {c}" for c in _WIDE)
       + ", coalesce(sales_count, 0)::BIGINT AS sales_count, coalesce(report_count, 0)::BIGINT AS report_count, coalesce(market_count, 0)::BIGINT AS market_count FROM final"))
def score_wide(t: Tables) -> DataFrame:
    """The whole row of the score: figures, ratios, ranks, penalties, scores and counts."""
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sales_count", "report_count", "market_count")]
    return score_view(t).select("company_id", "company_name", *(round_half(F.col(c), 3).alias(c) for c in _WIDE), *counts)


@query("score_bands", _view(*_FINAL, then="""SELECT company_id,
  CASE WHEN quant_score >= 60 THEN 'strong' WHEN quant_score >= 40 THEN 'good' WHEN quant_score >= 20 THEN 'middling' ELSE 'weak' END AS score_band,
  CASE WHEN nm_raw IS NULL THEN 'none' WHEN nm_raw >= 20 THEN 'high' WHEN nm_raw >= 0 THEN 'low' ELSE 'loss' END AS margin_band,
  CASE WHEN sg_raw IS NULL THEN 'none' WHEN sg_raw >= 30 THEN 'fast' WHEN sg_raw >= 0 THEN 'slow' ELSE 'shrinking' END AS growth_band,
  concat_ws(', ', CASE WHEN NOT coalesce(pe_raw > 0 AND pe_raw <= 60, false) THEN 'bad_pe' END, CASE WHEN sg_raw < 0 THEN 'weak_sales' END,
            CASE WHEN net_profit_ttm < 0 THEN 'loss_maker' END, CASE WHEN coalesce(report_age > 8 OR market_age > 14, true) THEN 'stale' END) AS labels FROM final"""))
def score_bands(t: Tables) -> DataFrame:
    """Bands of score, margin and growth, and the four labels of the short list."""
    c = F.col
    band = lambda x, *steps: _ladder(x, steps)
    fine = F.coalesce((c("pe_raw") > 0) & (c("pe_raw") <= 60), F.lit(False))
    labels = F.concat_ws(", ", F.when(~fine, "bad_pe"), F.when(c("sg_raw") < 0, "weak_sales"), F.when(c("net_profit_ttm") < 0, "loss_maker"),
                         F.when(F.coalesce((c("report_age") > 8) | (c("market_age") > 14), F.lit(True)), "stale"))
    return score_view(t).select("company_id", band(c("quant_score"), (60, "strong"), (40, "good"), (20, "middling"), (None, "weak")).alias("score_band"),
                                band(c("nm_raw"), (20, "high"), (0, "low"), (None, "loss")).alias("margin_band"), band(c("sg_raw"), (30, "fast"), (0, "slow"), (None, "shrinking")).alias("growth_band"),
                                labels.alias("labels"))


def _ladder(x: Column, steps: tuple) -> Column:
    """The name of the first bound that x reaches, "none" for null."""
    out = F.lit(steps[-1][1])
    for bound, name in reversed(steps[:-1]):
        out = F.when(x >= bound, name).otherwise(out)
    return F.when(x.isNull(), "none").otherwise(out)


@query("monthly_projection", with_tables("monthly", then="""
SELECT company_id, report_key, value1 / 1e6 AS produced, value2 / 1e6 AS sold, value3 / 1e6 AS amount, floor(value3 / 1e6 * 1000e0 * 1e2 + 5e-1) / 1e2 AS percentage,
       CASE WHEN value3 > e THEN 1 WHEN value3 < e THEN -1 ELSE 0 END AS wow FROM (SELECT *, lag(value3) OVER (PARTITION BY company_id ORDER BY report_key) AS e FROM monthly)"""))
def monthly_projection(t: Tables) -> DataFrame:
    """Months in millions, with the amount in thousandths to two digits and the sign of its change."""
    before = F.lag("value3").over(Window.partitionBy("company_id").orderBy("report_key"))
    rows = domain.monthly_sales(t).withColumn("before", before)
    sign = F.when(F.col("value3") > F.col("before"), 1).when(F.col("value3") < F.col("before"), -1).otherwise(0)
    return rows.select("company_id", "report_key", *((F.col(f"value{k}") / 1e6).alias(n) for k, n in ((1, "produced"), (2, "sold"), (3, "amount"))),
                       round_half(F.col("value3") / 1e6 * 1000.0, 2).alias("percentage"), sign.alias("wow"))


@query("distinct_reports", """
SELECT l_suppkey AS company_id, l_shipdate::DATE AS day, l_quantity AS value, max(s_name) AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""")
def distinct_reports(t: Tables) -> DataFrame:
    """Reports of one company, day and value once, under the greatest of their names."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("company_id"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("value"))
    return rows.join(domain.companies(t), "company_id").groupBy("company_id", "day", "value").agg(F.max("company_name").alias("name"))


@query("names_count", "SELECT p_brand, count(DISTINCT p_name) AS names, count(DISTINCT lower(trim(p_type))) AS kinds FROM part GROUP BY 1")
def names_count(t: Tables) -> DataFrame:
    return t("part").groupBy("p_brand").agg(F.countDistinct("p_name").alias("names"), F.countDistinct(F.lower(F.trim("p_type"))).alias("kinds"))


@query("portfolio_totals", with_tables("held", then=f"""-- more{_LIVE_SQL},
valued AS (SELECT h.*, quantity * coalesce(price, 0) AS value FROM held h LEFT JOIN live l ON l.item_id = h.item_id AND price > 0)
SELECT user_id, sum(cost) AS cost, sum(value) AS value, sum(value) - sum(cost) AS gain, floor((sum(value) - sum(cost)) / nullif(sum(cost), 0) * 1e2 * 1e4 + 5e-1) / 1e4 AS gain_pct,
       count(*) FILTER (value > 0) AS priced, max(CASE WHEN p_name <> '' THEN p_name END) AS last_name FROM valued LEFT JOIN part ON p_partkey = item_id GROUP BY 1"""))
def portfolio_totals(t: Tables) -> DataFrame:
    """Each user's cost, market value and gain, and the last of the live names of what they hold.

    Names are numbered in their order, one row a part, so that what users hold is added up in numbers alone: no rows with texts are
    sorted by user, and parts are joined once."""
    name, price = F.nullif("p_name", F.lit("")), F.when(F.col("price") > 0, F.col("price"))
    parts = live_prices(t, name.alias("last_name")).withColumn("price", price)
    parts = written(numbered_all(parts, [F.col("last_name").asc(), F.col("item_id").asc()], "k"), "names")
    named = parts.select("item_id", "price", F.when(F.col("last_name").isNotNull(), F.col("k")).alias("k"))
    rows = domain.holdings(t).join(named, "item_id", "left").withColumn("value", F.col("quantity") * F.coalesce("price", F.lit(0.0)))
    gain = F.sum("value") - F.sum("cost")
    totals = rows.groupBy("user_id").agg(F.sum("cost").alias("cost"), F.sum("value").alias("value"), gain.alias("gain"), round_half(ratio(gain, F.sum("cost")) * 100.0, 4).alias("gain_pct"),
                                         F.count_if(F.col("value") > 0).alias("priced"), F.max("k").alias("k"))
    return totals.join(parts.select("k", "last_name"), "k", "left").drop("k")


@query("price_deletions", with_tables("market", then="""
SELECT company_id, count(*) AS kept, min(day) AS first_day FROM market WHERE day >= DATE '1997-01-01' AND company_id % 10 <> 3
  AND NOT (company_id % 10 = 4 AND day IN (SELECT DISTINCT o_orderdate::DATE FROM orders WHERE o_totalprice > 400000)) GROUP BY 1"""))
def price_deletions(t: Tables) -> DataFrame:
    """Prices before a floor go, those of a list of companies go, and single days of others go."""
    rows = domain.market_prices(t).select("company_id", "day")
    listed = domain.companies(t).filter("company_id % 10 = 3").select("company_id")
    days = t("orders").filter("o_totalprice > 400000").select(F.to_date("o_orderdate").alias("day")).distinct()
    left = state.delete_keys(rows.filter("day >= DATE'1997-01-01'"), listed, ["company_id"])
    some, rest = left.filter("company_id % 10 = 4"), left.filter("company_id % 10 <> 4")
    left = rest.unionByName(state.delete_keys(some, days, ["day"]))
    return left.groupBy("company_id").agg(F.count(F.lit(1)).alias("kept"), F.min("day").alias("first_day"))


@query("full_replace", "SELECT s_suppkey AS id, s_name AS company_name, 7e0 AS pe FROM supplier WHERE s_suppkey % 2 = 0")
def full_replace(t: Tables) -> DataFrame:
    """A table is emptied and filled again: nothing of the old one stays."""
    folder = f"{fresh_folder(t.spark, 'full-pe')}"
    row = lambda df, pe: df.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("company_name"), F.lit(pe).alias("pe"))
    row(t("supplier"), 5.0).write.parquet(folder)
    row(t("supplier").filter("s_suppkey % 2 = 0"), 7.0).write.mode("overwrite").parquet(folder)
    return t.spark.read.parquet(folder)


@query("market_grid", """
SELECT page_id, 'Supplier#' || lpad((page_id % 100)::VARCHAR, 9, '0') AS name, page_id * 10 AS price, page_id + 5e-1 AS pe FROM pages
WHERE 'Supplier#' || lpad((page_id % 100)::VARCHAR, 9, '0') IN (SELECT s_name FROM supplier)""")
def market_grid(t: Tables) -> DataFrame:
    """Rows of a market watch on pages with other markup: of a row's boxes, nested as they are, the first has the name, as a link,
    the ninth the price and the eighteenth P/E; known names stay, and rows of fewer boxes give nothing."""
    k = F.col("page_id")
    name = F.concat(F.lit("Supplier&#35;"), F.lpad((k % 100).cast("string"), 9, "0"))
    boxes = [F.lit("x<br>y &amp; z")] * 18
    boxes[0], boxes[8], boxes[17] = F.concat(F.lit("<a href='?i=1&amp;x=2'> "), name, F.lit("</a> <i>note")), F.concat(F.lit("<b>"), F.format_number(k * 10, 0), F.lit("</b>")), F.concat(k.cast("string"), F.lit(".<span>5</span>"))
    # boxes two to nine stand in one another, those behind them don't
    nested = [F.concat(F.lit("<div class=t1c>"), boxes[0], F.lit("</div>")), F.lit("<div id=a>" * 7), F.concat(F.lit('<div data-x="<div>">'), boxes[8], F.lit("</div>" * 8)),
              *(F.concat(F.lit("<div class='t0c'>"), c, F.lit("</div>")) for c in boxes[9:])]
    row = lambda cells: F.concat(F.lit("<div class='{c' onclick=\"mw.SelectRow(&quot;7&quot;)\">"), *cells, F.lit("</div></p>"))
    grid = F.concat(F.coalesce("html", F.lit("")), F.lit("--></script></style><div class=main><div onclick='other()'><div>1</div></div>"), row(nested),
                    row([F.lit("<div><a>stranger</a></div>"), *nested[1:]]), row(nested[:2]), F.lit("<div onclick=mw.SelectRow><div>unclosed"))
    rows = elements.element_rows(t("pages").select("page_id", grid.alias("html")), "div", "onclick", r"mw\.SelectRow")
    c = F.col("boxes")
    found = rows.filter(F.size(c) >= 18).select("page_id", c[0]["link"].alias("name"), to_whole(c[8]["text"]).alias("price"), to_amount(c[17]["text"]).alias("pe"))
    return found.join(t("supplier").select(F.col("s_name").alias("name")), "name", "left_semi").select("page_id", "name", "price", "pe")


@query("growth_ranking", with_tables("interim", then="""-- more
history AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY jyear DESC, jmonth DESC) AS rn FROM interim)
SELECT company_id, floor((net_profit - net_profit_ly) / nullif(abs(net_profit_ly), 0) * 1e2 * 1e4 + 5e-1) / 1e4 AS eps_growth FROM history WHERE rn = 1 ORDER BY eps_growth DESC NULLS LAST, company_id LIMIT 1000"""))
def growth_ranking(t: Tables) -> DataFrame:
    """Companies by growth of the last report against the year before; a top-k report, in a defined order."""
    last = profit_history(t).filter("rn = 1").select("company_id")
    rows = latest_per(domain.interim_reports(t), ["company_id"], [F.desc("jyear"), F.desc("jmonth")]).join(last, "company_id")
    growth = round_half(ratio(F.col("net_profit") - F.col("net_profit_ly"), F.abs("net_profit_ly")) * 100.0, 4)
    return rows.select("company_id", growth.alias("eps_growth")).orderBy(F.col("eps_growth").desc_nulls_last(), "company_id").limit(1000)
