"""Lookups by name: facts of tickers, with an import of what is missing; lists of assets; names, keys and units as they are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import company_key, currency_unit, normalize_company_name, normalize_header
from quantloom.operators.joins import spread_join
from quantloom.operators.ranking import numbered_all
from quantloom.plans.portfolio import assets
from quantloom.plans.registry import query
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables
from quantloom.sources.store import fresh_folder, written


def facts_of(asked: DataFrame, store: str, reports: DataFrame, companies: DataFrame, published: DataFrame) -> DataFrame:
    """The facts of the companies of asked (ticker), and whether they had to be imported.

    A probe counts what the store under a folder has of each ticker, by way of reports and companies; what published has of
    the tickers without any is added to the store, and the facts come from there. Companies that hold very many facts are dealt
    over tasks. Tickers that nobody knows, or null, give no rows.
    """
    spark = asked.sparkSession
    wanted = written(companies.join(asked.select("ticker").distinct(), "ticker", "left_semi").join(reports, "company_id").select("ticker", "report_id"), "asked")
    held = spark.read.schema(published.schema).parquet(store)
    there = held.join(wanted, "report_id").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    absent = written(wanted.join(there, "ticker", "left_anti"), "absent")
    published.join(absent.select("report_id"), "report_id", "left_semi").write.mode("append").parquet(store)
    # the folder is listed anew: the import is in it
    found = spread_join(spark.read.schema(published.schema).parquet(store), wanted, ["report_id"], [c for c in published.columns if c != "report_id"])
    new = absent.select("ticker").distinct().withColumn("imported", F.lit(True))
    return found.join(new, "ticker", "left").withColumn("imported", F.coalesce("imported", F.lit(False)))


@query("facts_by_ticker", """
SELECT c_name AS ticker, l_returnflag || l_linestatus AS fact_name, floor(l_extendedprice * 100.0 + 0.5) AS value, l_shipdate::DATE AS end_day, c_custkey % 2 = 1 AS imported,
       row_number() OVER (PARTITION BY c_name ORDER BY l_shipdate::DATE DESC, l_orderkey, l_linenumber) AS place
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 5""")
def facts_by_ticker(t: Tables) -> DataFrame:
    """Facts of some nations' companies, newest first; half of the companies have none in the store at first."""
    companies = t("customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("ticker"))
    reports = t("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("company_id"))
    published = t("lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("fact_name"),
                                     F.floor(F.col("l_extendedprice") * 100.0 + 0.5).cast("double").alias("value"), F.to_date("l_shipdate").alias("end_day"))
    store = fresh_folder(t.spark, "facts-store")
    published.join(reports.filter("company_id % 2 = 0").select("report_id"), "report_id", "left_semi").write.parquet(store)
    asked = t("customer").filter("c_nationkey < 5").select(F.col("c_name").alias("ticker"))
    newest = Window.partitionBy("ticker").orderBy(F.desc("end_day"), "report_id", "line")
    rows = facts_of(asked, store, reports, companies, published).withColumn("place", F.row_number().over(newest).cast("long"))
    return rows.select("ticker", "fact_name", "value", "end_day", "imported", "place")


@query("asset_list", """
SELECT p_partkey AS asset_id, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS symbol, row_number() OVER (ORDER BY p_size, p_partkey) AS place
FROM part WHERE p_partkey % 9 <> 0""")
def asset_list(t: Tables) -> DataFrame:
    """Active assets in their order, then by id, with an empty text for a missing symbol."""
    named = t("part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("symbol"), F.col("p_size").alias("sort_order"))
    active = assets(t).filter("active").select("asset_id")
    rows = named.join(active, "asset_id", "left_semi").withColumn("symbol", F.coalesce("symbol", F.lit("")))
    return numbered_all(rows, [F.asc("sort_order"), F.asc("asset_id")]).drop("sort_order")


def raw_key(name: Column) -> Column:
    """The key of a name as it is written, letters and blanks included; company_key is that of its normal form."""
    return F.md5(name)


@query("names_as_published", """
SELECT c_custkey, md5(' شركت ' || c_name || ' ۷ ') AS raw_id, md5('شرکت ' || c_name || ' 7') AS id, 'شرکت ' || c_name || ' 7' AS company_name,
       '12 ماهه منتهی به 1402/12/' || (10 + c_custkey % 20) AS header, CASE c_custkey % 5 WHEN 0 THEN 'million_rial' WHEN 1 THEN 'thousand_rial' WHEN 2 THEN 'rial' ELSE 'unknown' END AS unit
FROM customer""")
def names_as_published(t: Tables) -> DataFrame:
    """Companies' names, raw and in normal form with their keys, headers of periods, and the unit that a page's note gives."""
    k, c = F.col("c_custkey"), F.col("c_name")
    name = F.concat(F.lit(" شركت "), c, F.lit(" ۷ "))
    digits = F.translate((10 + k % 20).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    header = F.concat(F.lit(" ۱۲ ماهه\n\tمنتهي  به ۱۴۰۲/۱۲/"), digits, F.lit(" "))
    note = F.when(k % 5 == 0, "(مبالغ به میلیون‌ ريال)").when(k % 5 == 1, "مبالغ: هزار  ريال").when(k % 5 == 2, "به ریال").when(k % 5 == 3, "USD")
    return t("customer").select("c_custkey", raw_key(name).alias("raw_id"), company_key(name).alias("id"), normalize_company_name(name).alias("company_name"),
                                normalize_header(header).alias("header"), currency_unit(note).alias("unit"))


@query("reports_coerced", with_tables("interim", then="""
SELECT company_id, jyear * 12 + jmonth AS month_index, CASE WHEN company_id % 3 <> 0 THEN net_profit END AS net_profit, row_number() OVER (PARTITION BY company_id ORDER BY jyear * 12 + jmonth) AS place
FROM interim"""))
def reports_coerced(t: Tables) -> DataFrame:
    """Reports scanned as texts: what is no number is null, and each company's are in order of months."""
    k = F.col("company_id")
    text = F.when(k % 6 == 0, "n/a").when(k % 6 == 3, "").otherwise(F.format_string(" %.0f ", "net_profit"))
    scanned = domain.interim_reports(t).select("company_id", F.col("jyear").cast("string").alias("jyear"), F.col("jmonth").cast("string").alias("jmonth"), text.alias("net_profit"))
    month = F.col("jyear").try_cast("int") * 12 + F.col("jmonth").try_cast("int")
    order = Window.partitionBy("company_id").orderBy("month_index")
    rows = scanned.select("company_id", month.alias("month_index"), F.trim("net_profit").try_cast("double").alias("net_profit"))
    return rows.withColumn("place", F.row_number().over(order).cast("long"))
