"""Ingestion: text and calendar normal forms, state transitions, entity resolution, pages, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import calendar
from quantloom.functions.numeric import power_of_ten_ratio, round_half, to_number
from quantloom.functions.text import company_key, normalize_text, tokens
from quantloom.operators import state
from quantloom.operators.html import links
from quantloom.operators.resolve import nearest_sets, resolve, search, tokens_for_match
from quantloom.plans.registry import query
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables
from quantloom.sources.store import written


_TEXT_SQL = """trim(regexp_replace(regexp_replace(replace(translate({x}, 'يىكۀةأإؤ۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', 'ییکههااو01234567890123456789'), chr(160), ' '),
  '[' || chr(8204) || chr(8205) || chr(8206) || chr(8207) || chr(8234) || '-' || chr(8238) || chr(8294) || '-' || chr(8297) || ']', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"""


@query("text_normalize", f"SELECT doc_id, md5({_TEXT_SQL.format(x='text')}) AS text_md5, md5({_TEXT_SQL.format(x="'  شركت' || chr(8204) || ' نمونه ۱۲ ' || source")}) AS company_id FROM documents")
def text_normalize(t: Tables) -> DataFrame:
    """Each whole text in normal form, and a company's key from a name that isn't."""
    name = F.concat(F.lit("  شركت‌ نمونه ۱۲ "), F.col("source"))
    return t("documents").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("text_md5"), company_key(name).alias("company_id"))


@query("number_parse", """
SELECT l_orderkey, l_linenumber, sum(x)::BIGINT AS total, count(*) AS n
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN -floor(l_extendedprice) ELSE floor(l_extendedprice) END AS x FROM lineitem) GROUP BY 1, 2""")
def number_parse(t: Tables) -> DataFrame:
    """Numbers written with Persian digits, separators, and parentheses for minus, read again."""
    shown = F.translate(F.format_number(F.floor("l_extendedprice"), 0), "0123456789,", "۰۱۲۳۴۵۶۷۸۹٬")
    shown = F.when(F.col("l_quantity") > 25, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(to_number(shown)).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


_JALALI_SQL = """
n AS (SELECT DISTINCT o_orderdate::DATE AS day, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528 + 355668 - 1 AS d0 FROM orders),
a AS (SELECT *, -1595 + 33 * (d0 // 12053) + 4 * ((d0 % 12053) // 1461) AS y0, (d0 % 12053) % 1461 AS d1 FROM n),
b AS (SELECT *, CASE WHEN d1 > 365 THEN y0 + (d1 - 1) // 365 ELSE y0 END AS y, CASE WHEN d1 > 365 THEN (d1 - 1) % 365 ELSE d1 END AS d2 FROM a),
c AS (SELECT day, y, CASE WHEN d2 < 186 THEN 1 + d2 // 31 ELSE 7 + (d2 - 186) // 30 END AS m, CASE WHEN d2 < 186 THEN 1 + d2 % 31 ELSE 1 + (d2 - 186) % 30 END AS d FROM b)"""


@query("jalali_convert", f"""WITH{_JALALI_SQL}
SELECT day, format('{{:04d}}/{{:02d}}/{{:02d}}', y, m, d) AS jalali, day AS back FROM c""")
def jalali_convert(t: Tables) -> DataFrame:
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    text = calendar.key_text(*calendar.date_to_jalali(F.col("day")))
    return days.withColumn("jalali", text).withColumn("back", calendar.jalali_to_date(*calendar.parts(F.col("jalali"))))


@query("jalali_month_end", f"""WITH{_JALALI_SQL}
SELECT y::INT AS y, m::INT AS m, max(day) AS last_seen, max(d)::INT AS last_day FROM c GROUP BY 1, 2""")
def jalali_month_end(t: Tables) -> DataFrame:
    """The last order day of each Jalali month; none lies after the month's end."""
    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    y, m, d = calendar.date_to_jalali(F.col("day"))
    ends = days.select("day", y.alias("y"), m.alias("m"), d.alias("d")).filter(F.col("day") <= calendar.jalali_month_end(F.col("y"), F.col("m")))
    return ends.groupBy("y", "m").agg(F.max("day").alias("last_seen"), F.max("d").alias("last_day"))


@query("unit_ratio", with_tables("interim", then="""
SELECT company_id, jyear, jmonth, CASE WHEN abs(log10(abs(nullif(a, 0)) / abs(nullif(b, 0))) - floor(log10(abs(nullif(a, 0)) / abs(nullif(b, 0))) + 0.5)) <= 0.1 AND sign(a) = sign(b)
       THEN pow(10e0, floor(log10(abs(nullif(a, 0)) / abs(nullif(b, 0))) + 0.5)) END AS unit
FROM (SELECT company_id, jyear, jmonth, net_profit AS a, net_profit * CASE company_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 1e3 ELSE 13e2 END AS b FROM interim)"""))
def unit_ratio(t: Tables) -> DataFrame:
    k = F.col("company_id") % 3
    b = F.col("net_profit") * F.when(k == 0, 1.0).when(k == 1, 1000.0).otherwise(1300.0)
    return domain.interim_reports(t).select("company_id", "jyear", "jmonth", power_of_ten_ratio(F.col("net_profit"), b).alias("unit"))


def old_and_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A price table up to 2000, and a later batch that overlaps it, with nulls."""
    rows = domain.market_prices(t).select("company_id", "day", "close", F.when(F.col("volume") > 20, F.col("volume")).alias("volume"))
    return rows.filter("day < DATE'2000-01-01'"), rows.filter("day >= DATE'1999-01-01'").withColumns({"close": F.col("close") + 1, "volume": F.coalesce("volume", F.lit(0.0))})


_STATE_SQL = """
old AS (SELECT company_id, day, close, CASE WHEN volume > 20 THEN volume END AS volume FROM market WHERE day < DATE '2000-01-01'),
new AS (SELECT company_id, day, close + 1 AS close, CASE WHEN volume > 20 THEN volume ELSE 0 END AS volume FROM market WHERE day >= DATE '1999-01-01')"""
_KEYS = ("company_id", "day")


@query("merge_upsert", with_tables("market", then=f"-- more{_STATE_SQL}\nSELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (company_id, day)"))
def merge_upsert(t: Tables) -> DataFrame:
    return state.merge_upsert(*old_and_new(t), _KEYS)


@query("fill_nulls", with_tables("market", then=f"""-- more{_STATE_SQL}
SELECT company_id, day, coalesce(o.close, n.close) AS close, coalesce(o.volume, n.volume) AS volume FROM old o FULL JOIN new n USING (company_id, day)"""))
def fill_nulls(t: Tables) -> DataFrame:
    return state.fill_nulls(*old_and_new(t), _KEYS)


@query("insert_absent", with_tables("market", then=f"-- more{_STATE_SQL}\nSELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (company_id, day)"))
def insert_absent(t: Tables) -> DataFrame:
    return state.insert_absent(*old_and_new(t), _KEYS)


@query("keyed_delete", with_tables("market", then=f"-- more{_STATE_SQL}\nSELECT * FROM old ANTI JOIN new USING (company_id, day)"))
def keyed_delete(t: Tables) -> DataFrame:
    return state.delete_keys(*old_and_new(t), _KEYS)


@query("replace_children", with_tables("market", then=f"-- more{_STATE_SQL}\nSELECT * FROM old WHERE company_id % 2 = 1 UNION ALL SELECT * FROM new WHERE company_id % 2 = 0"))
def replace_children(t: Tables) -> DataFrame:
    """The days of companies with even numbers are replaced as a whole."""
    old, new = old_and_new(t)
    return state.replace_children(old, new.filter("company_id % 2 = 0"), ["company_id"])


@query("versioned_upsert", with_tables("monthly", then="""-- more
base AS (SELECT company_id, report_key, value3, sha256('=' || value3::BIGINT) AS content_hash FROM monthly),
later AS (SELECT company_id, report_key, value3 + CASE WHEN company_id % 2 = 0 THEN 1 ELSE 0 END AS value3 FROM monthly)
SELECT company_id, report_key, count(DISTINCT h) AS versions FROM (
  SELECT company_id, report_key, content_hash AS h FROM base UNION ALL SELECT company_id, report_key, sha256('=' || value3::BIGINT) FROM later) GROUP BY 1, 2"""))
def versioned_upsert(t: Tables) -> DataFrame:
    """Reports come again, half of them changed: how many versions each has."""
    rows = domain.monthly_sales(t).select("company_id", "report_key", F.col("value3").cast("long").alias("value3"))
    current = rows.withColumn("content_hash", state.content_hash("value3"))
    again = rows.withColumn("value3", F.col("value3") + F.when(F.col("company_id") % 2 == 0, 1).otherwise(0))
    keys = ["company_id", "report_key"]
    _, versions = state.versioned_upsert(current, current.select(*keys, "content_hash"), again, keys, ["value3"])
    return versions.groupBy(*keys).agg(F.countDistinct("content_hash").alias("versions"))


@query("skip_complete", with_tables("market", then="""
SELECT s_suppkey AS company_id FROM supplier WHERE s_suppkey NOT IN (
  SELECT company_id FROM market GROUP BY 1 HAVING count(*) >= 30 AND max(day) >= DATE '2001-10-15')"""))
def skip_complete(t: Tables) -> DataFrame:
    """Companies that still want a backfill: fewer than 30 days, or none of late."""
    done = domain.market_prices(t).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last")).filter("n >= 30 AND last >= DATE'2001-10-15'")
    return state.delete_keys(domain.companies(t).select("company_id"), done, ["company_id"])


@query("source_fallback", with_tables("market", then=f"-- more{_STATE_SQL}\nSELECT company_id, day, close FROM new UNION ALL SELECT company_id, day, close FROM old ANTI JOIN new USING (company_id, day)"))
def source_fallback(t: Tables) -> DataFrame:
    old, new = old_and_new(t)
    return state.fallback(new.select(*_KEYS, "close"), old.select(*_KEYS, "close"), _KEYS)


@query("completeness_coverage", with_tables("interim", then="""
SELECT company_id, count(*) AS reports, count(*) FILTER (net_profit_ly IS NOT NULL AND net_profit_fyprev IS NOT NULL) AS complete, count(DISTINCT jyear) AS years FROM interim GROUP BY 1"""))
def completeness_coverage(t: Tables) -> DataFrame:
    full = F.col("net_profit_ly").isNotNull() & F.col("net_profit_fyprev").isNotNull()
    return domain.interim_reports(t).groupBy("company_id").agg(F.count(F.lit(1)).alias("reports"), F.count_if(full).alias("complete"), F.countDistinct("jyear").alias("years"))


# ---- entity resolution: parts ask for suppliers by perturbed names, so that every stage has rows -----------------------
def _company_name(k: F.Column) -> F.Column:
    word = lambda mark, n: F.concat(F.lit(mark), (n).cast("string"))
    return F.concat_ws(" ", F.lit("شرکت supplier"), word("n", k % 10), word("m", F.floor(k / 10)), F.lit("house trade"))


def _asked(t: Tables) -> DataFrame:
    """name_id, k (the supplier meant), symbol, name: eight kinds of perturbation, the last beyond recognition."""
    n = t("supplier").agg(F.count(F.lit(1)).alias("n"))
    rows = t("part").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("name_id"), (F.col("p_partkey") % F.col("n")).alias("k"))
    kind, key, name = F.col("name_id") % 8, F.col("k").cast("string"), _company_name(F.col("k"))
    symbol = F.when(kind == 0, F.concat(F.lit("o"), key)).when(kind == 1, F.concat(F.lit("q"), key)).when(kind == 3, name).when(kind == 4, F.concat(F.lit("t"), key)).otherwise("none")
    mixed = F.concat_ws(" ", F.reverse(F.split(name, " ")))
    shown = (F.when(kind == 2, F.concat(F.lit(" "), F.replace(name, F.lit("ک"), F.lit("ك")), F.lit("\u200f "))).when(kind == 5, F.regexp_replace(name, " trade$", ""))
             .when(kind == 6, mixed).when(kind == 7, F.concat(F.lit("trade of many "), key)).otherwise("elsewhere"))
    return rows.select("name_id", "k", symbol.alias("symbol"), shown.alias("name"))


def _resolved(t: Tables) -> DataFrame:
    companies = t("supplier").select(F.col("s_suppkey").alias("k")).withColumn("company_name", _company_name(F.col("k")))
    overrides = companies.select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("symbol"), F.md5(F.col("k").cast("string")).alias("value")).unionByName(
        companies.select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("symbol"), F.col("company_name").alias("value")))
    symbols = companies.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("symbol"), F.col("k").cast("string").alias("company_id"))
    return resolve(_asked(t).drop("k"), companies.select(F.col("k").cast("string").alias("company_id"), "company_name"), overrides, symbols)


_NAME_SQL = "'شرکت supplier n' || {k} % 10 || ' m' || {k} // 10 || ' house trade'"
_RESOLVE_SQL = f"""
have AS (SELECT s_suppkey::VARCHAR AS company_id, {_NAME_SQL.format(k="s_suppkey")} AS name FROM supplier),
cand AS (SELECT company_id, name, replace(name, 'شرکت ', '') AS own FROM have),
meant AS (SELECT p_partkey AS name_id, p_partkey % (SELECT count(*) FROM supplier) AS k, p_partkey % 8 AS kind FROM part),
asked AS (
  SELECT name_id, CASE kind WHEN 0 THEN 'o' || k WHEN 1 THEN 'q' || k WHEN 3 THEN name WHEN 4 THEN 't' || k ELSE 'none' END AS symbol,
         CASE kind WHEN 2 THEN name WHEN 5 THEN left(name, length(name) - 6) WHEN 6 THEN array_to_string(list_reverse(string_split(name, ' ')), ' ')
              WHEN 7 THEN 'trade of many ' || k ELSE 'elsewhere' END AS name
  FROM (SELECT *, {_NAME_SQL.format(k="k")} AS name FROM meant)),
bare AS (SELECT *, array_to_string(list_filter(string_split(name, ' '), lambda w: w <> 'شرکت'), ' ') AS own FROM asked),
near AS (
  SELECT name_id, company_id, len(list_intersect(string_split(b.own, ' '), string_split(c.own, ' '))) * 1e0
         / len(list_distinct(string_split(b.own || ' ' || c.own, ' '))) AS share,
         contains(b.own, c.own) OR contains(c.own, b.own) AS held, len(string_split(b.own, ' ')) >= 2 AND length(b.own) >= 5 AS long
  FROM bare b, cand c),
ways AS (
  SELECT name_id, 0 AS stage, md5(s_suppkey::VARCHAR) AS company_id, 'override(id)' AS how FROM asked JOIN supplier ON symbol = 'o' || s_suppkey
  UNION ALL SELECT name_id, 1, s_suppkey::VARCHAR, 'override(name)' FROM asked JOIN supplier ON symbol = 'q' || s_suppkey
  UNION ALL SELECT name_id, 2, company_id, 'exact-name' FROM asked a JOIN have h ON h.name = a.name
  UNION ALL SELECT name_id, 3, company_id, 'symbol-equals-name' FROM asked a JOIN have h ON h.name = a.symbol
  UNION ALL SELECT name_id, 4, s_suppkey::VARCHAR, 'stored-symbol' FROM asked JOIN supplier ON symbol = 't' || s_suppkey
  UNION ALL SELECT name_id, 5, min(company_id), 'containment' FROM near WHERE held AND long GROUP BY 1
  UNION ALL SELECT name_id, 6, min_by(company_id, (-share, company_id)), 'fuzzy' FROM near WHERE share >= 0.75 GROUP BY 1),
resolved AS (SELECT name_id, company_id, how FROM ways QUALIFY row_number() OVER (PARTITION BY name_id ORDER BY stage) = 1)"""


@query("entity_resolution", f"WITH{_RESOLVE_SQL}\nSELECT * FROM resolved")
def entity_resolution(t: Tables) -> DataFrame:
    """Perturbed names and symbols, each matched by the first of seven stages that knows it."""
    return _resolved(t)


@query("match_histogram", f"WITH{_RESOLVE_SQL}\nSELECT split_part(how, '(', 1) AS how, count(*) AS n FROM resolved GROUP BY 1")
def match_histogram(t: Tables) -> DataFrame:
    return _resolved(t).groupBy(F.split_part("how", F.lit("("), F.lit(1)).alias("how")).agg(F.count(F.lit(1)).alias("n"))


@query("match_report", f"""WITH{_RESOLVE_SQL}
SELECT (SELECT count(*) FROM asked) AS total, (SELECT count(*) FROM resolved) AS matched,
       (SELECT count(*) FROM asked ANTI JOIN resolved USING (name_id)) AS unmatched, (SELECT count(DISTINCT name) FROM have) AS names""")
def match_report(t: Tables) -> DataFrame:
    """The summary that a run of matching reports."""
    found, asked = _resolved(t), _asked(t)
    names = t("supplier").select(_company_name(F.col("s_suppkey")).alias("name")).agg(F.countDistinct("name").alias("names"))
    both = asked.select("name_id").join(found.select("name_id", "how"), "name_id", "left")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count("how").alias("matched"), F.count_if(F.col("how").isNull()).alias("unmatched")).crossJoin(F.broadcast(names))


@query("unmatched_by_score", f"""WITH{_RESOLVE_SQL}
SELECT name_id, name, floor(share * 1e3 + 5e-1) / 1e3 AS score FROM asked ANTI JOIN resolved USING (name_id)
JOIN (SELECT name_id, max(share) AS share FROM near GROUP BY 1) USING (name_id) WHERE share >= 0.1 ORDER BY score DESC, name_id LIMIT 200""")
def unmatched_by_score(t: Tables) -> DataFrame:
    """Names that no stage matched, with the similarity of the nearest company; the 200 nearest, a top-k report."""
    lost = _asked(t).join(_resolved(t), "name_id", "left_anti").select("name_id", "name", tokens_for_match(F.col("name")).alias("words"))
    lost = written(lost, "unmatched")
    words = lost.select(F.col("name").alias("a"), "words").distinct()
    have = t("supplier").select(F.col("s_suppkey").alias("b"), tokens_for_match(_company_name(F.col("s_suppkey"))).alias("words"))
    best = nearest_sets(words, have, 0.1).select(F.col("a").alias("name"), "near")
    return lost.join(best, "name").select("name_id", "name", round_half(F.col("near"), 3).alias("score")).orderBy(F.desc("score"), "name_id").limit(200)


@query("symbol_search", f"""
WITH listed AS (SELECT s_suppkey AS item_id, 'S' || s_suppkey || 'S' AS symbol, {_NAME_SQL.format(k="s_suppkey")} AS name FROM supplier),
asked AS (
  SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'S' || k || 'S' WHEN 1 THEN 'n' || k % 10 || ' m' || k // 10 || ' house'
         WHEN 2 THEN 'trade m' || k // 10 || ' n' || k % 10 || ' x' ELSE 'unheard of' END AS text
  FROM (SELECT *, p_partkey % (SELECT count(*) FROM supplier) AS k FROM part)),
pairs AS (
  SELECT query_id, item_id, text = symbol OR text = name AS exact, contains(text, symbol) OR contains(symbol, text) OR (length(text) >= 4 AND (contains(name, text) OR contains(text, name))) AS sub,
         len(list_intersect(string_split(text, ' '), list_filter(string_split(name, ' '), lambda w: w <> 'شرکت'))) * 1e0
         / len(list_distinct(string_split(text || ' ' || replace(name, 'شرکت ', ''), ' '))) AS share FROM asked, listed),
ways AS (
  SELECT query_id, 0 AS stage, min(item_id) AS item_id, 'exact' AS how FROM pairs WHERE exact GROUP BY 1
  UNION ALL SELECT query_id, 1, min(item_id), 'substring' FROM pairs WHERE sub GROUP BY 1
  UNION ALL SELECT query_id, 2, min_by(item_id, (-share, item_id)), 'fuzzy' FROM pairs WHERE share >= 0.4 GROUP BY 1)
SELECT query_id, item_id, how FROM ways QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY stage) = 1""")
def symbol_search(t: Tables) -> DataFrame:
    """What a user types, answered exactly, by a substring, or by similar words."""
    n = t("supplier").agg(F.count(F.lit(1)).alias("n"))
    k, kind = F.col("k"), F.col("query_id") % 4
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    typed = F.when(kind == 0, text("S", k, "S")).when(kind == 1, text("n", k % 10, " m", F.floor(k / 10), " house")).when(
        kind == 2, text("trade m", F.floor(k / 10), " n", k % 10, " x")).otherwise("unheard of")
    asked = t("part").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % F.col("n")).alias("k")).select("query_id", typed.alias("text"))
    key = F.col("s_suppkey")
    return search(asked, t("supplier").select(key.alias("item_id"), text("S", key, "S").alias("symbol"), _company_name(key).alias("name")))


@query("token_jaccard", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part),
asked AS (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' new'
         ELSE 'brand new ' || p_name || ' here' END AS text FROM part)
SELECT p_partkey, min_by(name, (-share, name)) AS name, floor(max(share) * 1e4 + 5e-1) / 1e4 AS near FROM (
  SELECT p_partkey, name, len(list_intersect(string_split(text, ' '), string_split(name, ' '))) * 1e0 / len(list_distinct(string_split(text || ' ' || name, ' '))) AS share FROM asked, names)
WHERE share >= 0.4 GROUP BY 1""")
def token_jaccard(t: Tables) -> DataFrame:
    """The most similar name in the catalogue to each perturbed one, from 0.4 on."""
    words = F.split("p_name", " ")
    text = F.when(F.col("p_partkey") % 3 == 0, words[0]).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", words[1], words[0], F.lit("new"))).otherwise(
        F.concat(F.lit("brand new "), F.col("p_name"), F.lit(" here")))
    asked = t("part").select("p_partkey", text.alias("text"))
    best = nearest_sets(asked.select(F.col("text").alias("a"), tokens(F.col("text"), ()).alias("words")).distinct(),
                        t("part").select(F.col("p_name").alias("b"), tokens(F.col("p_name"), ()).alias("words")).distinct(), 0.4).toDF("text", "name", "near")
    return asked.join(best, "text").select("p_partkey", "name", round_half(F.col("near"), 4).alias("near"))


@query("three_way_facts", """
SELECT n_name AS ticker, r_name AS form, count(*) AS facts, sum(floor(c_acctbal * 100.0 + 0.5)) AS total
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def three_way_facts(t: Tables) -> DataFrame:
    rows = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy(F.col("n_name").alias("ticker"), F.col("r_name").alias("form")).agg(
        F.count(F.lit(1)).alias("facts"), F.sum(F.floor(F.col("c_acctbal") * 100.0 + 0.5).cast("double")).alias("total"))


@query("eav_facts_pivot", with_tables("interim", then="""
SELECT company_id, jyear, jmonth, max(revenue) AS revenue, max(net_profit) AS net_profit, max(operating_profit) AS operating_profit FROM interim GROUP BY 1, 2, 3"""))
def eav_facts_pivot(t: Tables) -> DataFrame:
    """Reports taken apart into facts, one a metric, and put together again."""
    metrics = ["revenue", "net_profit", "operating_profit"]
    facts = domain.interim_reports(t).unpivot(["company_id", "jyear", "jmonth"], metrics, "metric", "value")
    return facts.groupBy("company_id", "jyear", "jmonth").pivot("metric", metrics).agg(F.max("value"))


@query("html_link_harvest", """
SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def html_link_harvest(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.explode(links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))
