"""The domain's tables from the star schema: companies, monthly sales, interim reports, prices, holdings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import cents


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def companies(t: Tables) -> DataFrame:
    return t("supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company_name"))


def monthly_sales(t: Tables) -> DataFrame:
    """company_id, report_key (year and month), value1 to value3: orders, quantity, amount in cents."""
    return t("lineitem").groupBy(
        F.col("l_suppkey").alias("company_id"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("report_key"),
    ).agg(
        F.count(F.lit(1)).cast("double").alias("value1"), F.sum("l_quantity").alias("value2"),
        F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("value3"))


AMOUNTS = ("revenue", "net_profit", "operating_profit", "finance_costs", "other_non_op")


def interim_reports(t: Tables) -> DataFrame:
    """Quarterly reports, cumulative from the year's start, in cents; with last year's and the last full year's figures."""
    price, tax, off = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    quarter = t("lineitem").groupBy(
        F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("jyear"), (F.quarter("l_shipdate") * 3).alias("jmonth"),
    ).agg(
        F.sum(cents(price)).alias("revenue"), F.sum(cents(price * (tax - off + F.lit(0.02)))).alias("net_profit"),
        F.sum(cents(price * (F.lit(0.06) - off))).alias("operating_profit"), F.sum(cents(price * F.lit(0.01))).alias("finance_costs"),
        F.sum(cents(price * tax * F.lit(0.1))).alias("other_non_op"))
    quarter = quarter.repartition("company_id")  # some quarters each; one shuffle for all that follows
    so_far = Window.partitionBy("company_id", "jyear").orderBy("jmonth").rowsBetween(Window.unboundedPreceding, 0)
    cum = quarter.select("company_id", "jyear", "jmonth", *(F.sum(c).over(so_far).alias(c) for c in AMOUNTS))
    # ranges by year stand for two self joins: the same month and the last month of the year before
    month = Window.partitionBy("company_id", "jmonth").orderBy("jyear").rangeBetween(-1, -1)
    year = Window.partitionBy("company_id").orderBy("jyear").rangeBetween(-1, -1)
    full = cum.select("*", *(F.max(c).over(month).alias(f"{c}_ly") for c in AMOUNTS), *(F.max(F.when(F.col("jmonth") == 12, F.col(c))).over(year).alias(f"{c}_fyprev") for c in AMOUNTS))
    shares = 1000.0 + F.col("company_id")
    size = 0.5 + 0.25 * (F.col("company_id") % 3)
    return full.withColumns({
        "capital": shares, "eps": F.col("net_profit") / shares, "total_assets": F.col("revenue") * 2.0, "total_liabilities": F.col("revenue") * size,
        "total_equity": F.col("revenue") * (2.0 - size), "current_assets": F.col("revenue") * 0.75, "current_liabilities": F.col("revenue") * 0.5,
        "cash_flow": F.col("net_profit") * 1.25, "cash_flow_ly": F.col("net_profit_ly") * 1.25, "cash_flow_fyprev": F.col("net_profit_fyprev") * 1.25})


def market_prices(t: Tables, deal: Sequence[str] = ("company_id", "day")) -> DataFrame:
    """Daily prices in cents: close is the day's mean unit price, first and last are those of its first and last line.

    A company's lines of a day are few, so nothing is combined before the shuffle, which would sort all lines once more. Lines
    are dealt by deal; by the company alone where windows over companies follow, which then need no other shuffle."""
    unit = F.floor(F.col("l_extendedprice") * 100.0 / F.col("l_quantity") + 0.5).cast("double")
    line = F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), unit.alias("unit"))
    value, volume = F.sum(cents(F.col("l_extendedprice"))), F.sum("l_quantity")
    lines = t("lineitem").select(F.col("l_suppkey").alias("company_id"), F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return lines.repartition(*deal).groupBy("company_id", "day").agg(
        F.floor(value / volume + 0.5).cast("double").alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"),
        F.min(line)["unit"].alias("first"), F.max(line)["unit"].alias("last"), value.alias("trade_value"), volume.alias("volume"), F.count(F.lit(1)).alias("trade_count"))


def valuations(t: Tables) -> DataFrame:
    """company_id, company_name, price and pe; each seventh company has no P/E."""
    key, price = F.col("s_suppkey"), F.floor(F.abs("s_acctbal") * 100.0 + 0.5).cast("double")
    return t("supplier").select(
        key.alias("company_id"), F.col("s_name").alias("company_name"), price.alias("price"),
        F.when(key % 7 != 0, F.floor(price / (1000.0 + key) * 100.0 + 0.5) / 100.0).alias("pe"))


def holdings(t: Tables) -> DataFrame:
    """What each customer holds of each part: user_id, item_id, quantity, cost in cents."""
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")), "l_orderkey").groupBy(
        "user_id", F.col("l_partkey").alias("item_id")).agg(F.sum("l_quantity").alias("quantity"), F.sum(cents(F.col("l_extendedprice"))).alias("cost"))


#: The same tables in SQL, as named subqueries.
SQL = {
    "monthly": """
  SELECT l_suppkey AS company_id, (year(l_shipdate) * 100 + month(l_shipdate))::INT AS report_key, count(*)::DOUBLE AS value1,
         sum(l_quantity) AS value2, sum(floor(l_extendedprice * (1 - l_discount) * 100.0 + 0.5)) AS value3
  FROM lineitem GROUP BY 1, 2""",
    "quarter": """
  SELECT l_suppkey AS company_id, year(l_shipdate)::INT AS jyear, (quarter(l_shipdate) * 3)::INT AS jmonth,
         sum(floor(l_extendedprice * 100.0 + 0.5)) AS revenue,
         sum(floor(l_extendedprice * (l_tax - l_discount + 2e-2) * 100.0 + 0.5)) AS net_profit,
         sum(floor(l_extendedprice * (6e-2 - l_discount) * 100.0 + 0.5)) AS operating_profit,
         sum(floor(l_extendedprice * 1e-2 * 100.0 + 0.5)) AS finance_costs,
         sum(floor(l_extendedprice * l_tax * 1e-1 * 100.0 + 0.5)) AS other_non_op
  FROM lineitem GROUP BY 1, 2, 3""",
    "cum": "SELECT company_id, jyear, jmonth, " + ", ".join(
        f"sum({c}) OVER (PARTITION BY company_id, jyear ORDER BY jmonth) AS {c}" for c in AMOUNTS) + " FROM quarter",
    "interim": "SELECT c.*, " + ", ".join(f"l.{c} AS {c}_ly, f.{c} AS {c}_fyprev" for c in AMOUNTS) + """,
         1000.0 + c.company_id AS capital, c.net_profit / (1000e0 + c.company_id) AS eps, c.revenue * 2e0 AS total_assets,
         c.revenue * (5e-1 + 25e-2 * (c.company_id % 3)) AS total_liabilities, c.revenue * (2e0 - (5e-1 + 25e-2 * (c.company_id % 3))) AS total_equity,
         c.revenue * 75e-2 AS current_assets, c.revenue * 5e-1 AS current_liabilities, c.net_profit * 125e-2 AS cash_flow,
         l.net_profit * 125e-2 AS cash_flow_ly, f.net_profit * 125e-2 AS cash_flow_fyprev
  FROM cum c LEFT JOIN cum l ON l.company_id = c.company_id AND l.jyear = c.jyear - 1 AND l.jmonth = c.jmonth
             LEFT JOIN cum f ON f.company_id = c.company_id AND f.jyear = c.jyear - 1 AND f.jmonth = 12""",
    "market": """
  SELECT l_suppkey AS company_id, l_shipdate::DATE AS day,
         floor(sum(floor(l_extendedprice * 100.0 + 0.5)) / sum(l_quantity) + 0.5) AS close,
         max(floor(l_extendedprice * 100.0 / l_quantity + 0.5)) AS high, min(floor(l_extendedprice * 100.0 / l_quantity + 0.5)) AS low,
         min_by(floor(l_extendedprice * 100.0 / l_quantity + 0.5), (l_orderkey, l_linenumber, floor(l_extendedprice * 100.0 / l_quantity + 0.5))) AS first,
         max_by(floor(l_extendedprice * 100.0 / l_quantity + 0.5), (l_orderkey, l_linenumber, floor(l_extendedprice * 100.0 / l_quantity + 0.5))) AS last,
         sum(floor(l_extendedprice * 100.0 + 0.5)) AS trade_value, sum(l_quantity) AS volume, count(*) AS trade_count
  FROM lineitem GROUP BY 1, 2""",
    "valuation": """
  SELECT s_suppkey AS company_id, s_name AS company_name, floor(abs(s_acctbal) * 100.0 + 0.5) AS price,
         CASE WHEN s_suppkey % 7 <> 0 THEN floor(floor(abs(s_acctbal) * 100.0 + 0.5) / (1000e0 + s_suppkey) * 100.0 + 0.5) / 100e0 END AS pe
  FROM supplier""",
    "held": """
  SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity) AS quantity, sum(floor(l_extendedprice * 100.0 + 0.5)) AS cost
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""",
}


def with_tables(*names: str, then: str) -> str:
    """A SQL text that begins with the named subqueries; interim brings along what it needs."""
    order: list[str] = []
    for name in names:
        order += [n for n in (("quarter", "cum", "interim") if name == "interim" else (name,)) if n not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + (",\n" if then.lstrip().startswith("-- more") else "\n") + then.replace("-- more", "", 1)
