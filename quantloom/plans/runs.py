"""Runs that change what is kept: streams of prices, backfills within a quota, cached facts, synced and adjusted prices, bound parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.budget import within_budget
from quantloom.operators.state import delete_keys
from quantloom.operators.sync import adjust_touched, sync_prices
from quantloom.plans.market import _EVENTS_SQL
from quantloom.plans.registry import query
from quantloom.sources import domain
from quantloom.sources.buckets import current, put
from quantloom.sources.cache import padded_key, read_through
from quantloom.sources.domain import Tables, with_tables
from quantloom.sources.parameters import select
from quantloom.sources.store import fresh_folder, written
from quantloom.streaming.upsert import current as state_of
from quantloom.streaming.upsert import upsert_stream

# ---- streams --------------------------------------------------------------------------------------------------------
_ARRIVALS = """
arrivals AS (
  SELECT company_id, day, close, 10 + company_id % 3 AS collected_at FROM market
  UNION ALL SELECT company_id, day, close + 1, 20 FROM market WHERE day >= DATE '1996-01-01'
  UNION ALL SELECT company_id, day, close - 7, 11 FROM market
  UNION ALL SELECT company_id, day, close + 2, 20 FROM market WHERE company_id % 2 = 1)"""


def _arrivals(t: Tables) -> list[DataFrame]:
    """What comes in turn: all days; later days again; late rows, older than some that are kept; corrections at an equal time; and
    the first delivery once more."""
    rows = written(domain.market_prices(t).select("company_id", "day", "close"), "arrivals")  # read by each delivery
    sent = lambda df, add, at: df.select("company_id", "day", (F.col("close") + add).alias("close"), at.cast("int").alias("collected_at"))
    first = sent(rows, 0, F.lit(10) + F.col("company_id") % 3)
    return [first, sent(rows.filter("day >= DATE'1996-01-01'"), 1, F.lit(20)), sent(rows, -7, F.lit(11)), sent(rows.filter("company_id % 2 = 1"), 2, F.lit(20)), first]


@query("stream_upsert", with_tables("market", then=f"""-- more{_ARRIVALS}
SELECT company_id, day, close, collected_at::INT AS collected_at FROM arrivals
QUALIFY row_number() OVER (PARTITION BY company_id, day ORDER BY collected_at DESC, close DESC) = 1"""))
def stream_upsert(t: Tables) -> DataFrame:
    """The state after five deliveries, three of them taken by one run of the stream in batches of some files: newest first by time of
    collection, then by value; late and repeated rows change nothing."""
    source, target, log = (fresh_folder(t.spark, name) for name in ("stream-in", "stream-state", "stream-log"))
    deliveries = _arrivals(t)
    schema = deliveries[0].schema
    for k, rows in enumerate(deliveries):
        rows.write.mode("append").parquet(source)
        if k in (0, 1, 4):
            upsert_stream(t.spark, source, schema, target, log, ["company_id", "day"], "collected_at", files_a_batch=16).awaitTermination()
    return state_of(t.spark, target).select("company_id", "day", "close", "collected_at")


# ---- quotas ---------------------------------------------------------------------------------------------------------
@query("quota_resume", with_tables("market", then="""-- more
todo AS (SELECT company_id, count(*)::DOUBLE AS cost FROM market GROUP BY 1),
quota AS (SELECT floor(sum(cost) * 6e-1) AS budget FROM todo),
first AS (SELECT *, sum(cost) OVER (ORDER BY cost DESC, company_id) <= budget AS done FROM todo, quota),
second AS (SELECT *, sum(cost) OVER (ORDER BY cost DESC, company_id) <= budget AS done2 FROM first WHERE NOT done)
SELECT company_id, 1::BIGINT AS run FROM first WHERE done UNION ALL SELECT company_id, CASE WHEN done2 THEN 2 ELSE 3 END::BIGINT FROM second"""))
def quota_resume(t: Tables) -> DataFrame:
    """A backfill that costs a call a day of prices, in order of cost: what the first run's quota covers, what the second's does of
    that which the first has left, and the rest. Each run starts from what is done, which is written."""
    todo = written(domain.market_prices(t).groupBy("company_id").agg(F.count(F.lit(1)).cast("double").alias("cost")), "backfill")
    budget = todo.agg(F.floor(F.sum("cost") * 0.6)).first()[0] or 0  # one number
    order = [F.desc("cost"), F.asc("company_id")]
    first, _ = within_budget(todo, order, F.col("cost"), budget)
    done = written(first.select("company_id", F.lit(1).cast("long").alias("run")), "backfill-done")
    second, rest = within_budget(delete_keys(todo, done, ["company_id"]), order, F.col("cost"), budget)
    said = lambda df, run: df.select("company_id", F.lit(run).cast("long").alias("run"))
    return done.unionAll(said(second, 2)).unionAll(said(rest, 3))


# ---- cached facts ---------------------------------------------------------------------------------------------------
def _published_facts(t: Tables) -> DataFrame:
    """key, form, val: what the register gives for a company's padded key: three facts, in two forms."""
    cents = F.floor(F.col("c_acctbal") * 100.0 + 0.5)
    facts = F.array(F.struct(F.lit("10-K").alias("form"), cents.alias("val")), F.struct(F.lit("10-K").alias("form"), F.col("c_nationkey").cast("long").alias("val")),
                    F.struct(F.lit("10-Q").alias("form"), F.length("c_mktsegment").cast("long").alias("val")))
    return t("customer").select(padded_key(F.col("c_custkey")).alias("key"), F.explode(facts).alias("f")).select("key", "f.form", "f.val")


@query("facts_cached", """
WITH k AS (SELECT c_custkey, c_acctbal > 0 AS asked_first, floor(c_acctbal * 100.0 + 0.5)::BIGINT + c_nationkey AS annual FROM customer)
SELECT 1::BIGINT AS run, count(*) FILTER (asked_first) AS asked, count(*) FILTER (asked_first) AS fetched, sum(annual) FILTER (asked_first)::BIGINT AS annual FROM k
UNION ALL SELECT 2, count(*), count(*) FILTER (NOT coalesce(asked_first, false)), sum(annual)::BIGINT FROM k
UNION ALL SELECT 3, count(*), 0, sum(annual)::BIGINT FROM k
UNION ALL SELECT 4, count(*), count(*) FILTER (asked_first), sum(annual)::BIGINT FROM k""")
def facts_cached(t: Tables) -> DataFrame:
    """Facts of companies through a store: some are asked for, then all, then all again, which fetches nothing, and once more when
    what the first run has fetched is too old. Per run: how many were asked for and fetched, and the sum of annual facts."""
    symbols = t("customer").select(F.col("c_name").alias("ticker"), padded_key(F.col("c_custkey")).alias("key"), F.col("c_acctbal"))
    store, published = fresh_folder(t.spark, "facts"), _published_facts(t)
    fetch = lambda keys: published.join(keys, "key", "left_semi")
    out = None
    for run, (asked, now) in enumerate(((symbols.filter("c_acctbal > 0"), "2024-01-01"), (symbols, "2024-01-20"), (symbols, "2024-01-25"), (symbols, "2024-02-15")), 1):
        served, fetched = read_through(asked.select("key"), store, run, fetch, ["key"], now, 30)
        annual = asked.join(served.filter("form = '10-K'"), "key").agg(F.sum("val").alias("annual"))
        row = asked.agg(F.count(F.lit(1)).alias("asked")).crossJoin(fetched.agg(F.count(F.lit(1)).alias("fetched"))).crossJoin(annual)  # one row each
        row = written(row.select(F.lit(run).cast("long").alias("run"), "asked", "fetched", "annual"), "facts-run")
        out = row if out is None else out.unionAll(row)
    return out


# ---- synced prices --------------------------------------------------------------------------------------------------
_SYNC_SQL = """
quotes AS (
  SELECT 'Supplier#' || lpad(company_id::VARCHAR, 9, '0') AS symbol, day, CASE WHEN day(day) = 17 THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y/%m/%d') END AS date_key,
         CASE WHEN company_id % 4 = 0 THEN 0e0 ELSE last END AS last, CASE WHEN company_id % 8 = 0 THEN 0e0 ELSE close END AS close FROM market),
assets AS (
  SELECT s_suppkey AS asset_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'asset ' || s_suppkey END AS name,
         CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 11 = 0 THEN 'unknown' ELSE s_name END AS symbol FROM supplier),
prices AS (SELECT strftime(o_orderdate::DATE, '%Y/%m/%d') AS date_key, o_custkey % 50 AS asset_id, max(floor(o_totalprice)) AS price FROM orders GROUP BY 1, 2),
history AS (SELECT '1995/03/01' AS date_key UNION ALL SELECT '1996/01/01'),
named AS (SELECT asset_id, name, CASE WHEN symbol = '' THEN name ELSE symbol END AS symbol FROM assets)"""


def _to_sync(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Assets, quotes, prices so far and history: some assets have no symbol or an unknown one; some quotes lack a last price, or
    both, and those of each month's 17th have a key of another form."""
    k, c = F.col("s_suppkey"), F.col
    assets = t("supplier").select(k.alias("asset_id"), F.when(k % 3 == 0, c("s_name")).otherwise(F.concat(F.lit("asset "), k)).alias("name"),
                                  F.when(k % 3 == 0, "").when(k % 11 == 0, "unknown").otherwise(c("s_name")).alias("symbol"))
    quotes = domain.market_prices(t).select(
        F.concat(F.lit("Supplier#"), F.lpad(c("company_id").cast("string"), 9, "0")).alias("symbol"), "day",
        F.when(F.dayofmonth("day") == 17, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "yyyy/MM/dd")).alias("date_key"),
        F.when(c("company_id") % 4 == 0, 0.0).otherwise(c("last")).alias("last"), F.when(c("company_id") % 8 == 0, 0.0).otherwise(c("close")).alias("close"))
    prices = t("orders").groupBy(F.date_format("o_orderdate", "yyyy/MM/dd").alias("date_key"), (c("o_custkey") % 50).alias("asset_id")).agg(F.max(F.floor("o_totalprice")).cast("double").alias("price"))
    history = t.spark.createDataFrame([("1995/03/01",), ("1996/01/01",)], "date_key string")
    return assets, quotes, prices, history


_LATEST_SQL = f"""{_SYNC_SQL},
newest AS (SELECT symbol, arg_max(struct_pack(date_key, last, close), day) AS q FROM quotes GROUP BY 1),
met AS (
  SELECT asset_id, name, symbol, q.date_key AS date_key, CASE WHEN q.last > 0 THEN q.last WHEN q.close > 0 THEN q.close END AS price
  FROM named JOIN newest USING (symbol) WHERE regexp_matches(q.date_key, '^\\d{{4}}/\\d{{2}}/\\d{{2}}$'))"""
_FULL_SQL = f"""{_SYNC_SQL},
met AS (
  SELECT asset_id, name, symbol, day, date_key, CASE WHEN last > 0 THEN last WHEN close > 0 THEN close END AS price
  FROM named JOIN quotes USING (symbol) WHERE regexp_matches(date_key, '^\\d{{4}}/\\d{{2}}/\\d{{2}}$') AND date_key >= (SELECT min(date_key) FROM history))"""


@query("prices_synced_latest", with_tables("market", then=f"""-- more{_LATEST_SQL}
SELECT 'updated' AS kind, name, date_key, price FROM met WHERE price IS NOT NULL
UNION ALL SELECT 'missing', name, NULL, NULL FROM named WHERE asset_id NOT IN (SELECT asset_id FROM met WHERE price IS NOT NULL)"""))
def prices_synced_latest(t: Tables) -> DataFrame:
    """Each asset's latest price from the market, and the names of those that have none."""
    assets, quotes, prices, _ = _to_sync(t)
    got = sync_prices(assets, quotes, prices)
    updated = got.updated.select(F.lit("updated").alias("kind"), "name", "date_key", "price")
    return updated.unionByName(got.missing.select(F.lit("missing").alias("kind"), "name"), allowMissingColumns=True)


@query("prices_synced_full", with_tables("market", then=f"""-- more{_FULL_SQL},
given AS (SELECT date_key, asset_id, price FROM met WHERE price IS NOT NULL),
latest AS (SELECT asset_id, arg_max(struct_pack(date_key, p := coalesce(price, -1)), day) AS q, count(price) AS n FROM met GROUP BY 1)
SELECT 'price' AS kind, asset_id, date_key, price FROM given
UNION ALL SELECT 'price', asset_id, date_key, price FROM prices ANTI JOIN given USING (asset_id, date_key) WHERE date_key >= (SELECT min(date_key) FROM history)
UNION ALL SELECT 'updated', asset_id, q.date_key, greatest(q.p, 0e0) FROM latest WHERE n > 0
UNION ALL SELECT 'missing', asset_id, NULL, NULL FROM named WHERE asset_id NOT IN (SELECT asset_id FROM latest WHERE n > 0)"""))
def prices_synced_full(t: Tables) -> DataFrame:
    """All prices from the history's first day on: the market's, those that were there, the assets updated, and those missing."""
    assets, quotes, prices, history = _to_sync(t)
    got = sync_prices(assets, quotes, prices, history)
    missing = assets.join(got.updated.select("asset_id"), "asset_id", "left_anti").select("asset_id")
    kind = lambda df, name: df.withColumn("kind", F.lit(name)).select("kind", *(c for c in ("asset_id", "date_key", "price") if c in df.columns))
    return kind(got.prices, "price").unionByName(kind(got.updated, "updated")).unionByName(kind(missing, "missing"), allowMissingColumns=True)


# ---- adjusted prices ------------------------------------------------------------------------------------------------
RECENT = 14


@query("prices_adjusted_in_buckets", with_tables("market", then=f"""-- more{_EVENTS_SQL},
recent AS (SELECT company_id, count(*) AS n FROM events WHERE back <= {RECENT} GROUP BY 1),
lists AS (SELECT company_id, list(day ORDER BY day) AS days, list(factor ORDER BY day) AS factors FROM events SEMI JOIN recent USING (company_id) WHERE close > 0 AND abs(factor - 1) >= 2e-2 GROUP BY 1),
later AS (SELECT s.company_id, s.day, s.close, coalesce(list_filter(factors, lambda f, i: days[i] > day), []) AS rest FROM steps s LEFT JOIN lists USING (company_id))
SELECT company_id, day, CASE WHEN close > 0 THEN list_reduce(list_prepend(close, rest), lambda p, f: CASE WHEN p > 0 THEN round_even(p * f, 0) ELSE p END) ELSE close END AS close,
       coalesce(n, 0) AS recent_events
FROM later LEFT JOIN recent USING (company_id)"""))
def prices_adjusted_in_buckets(t: Tables) -> DataFrame:
    """Prices kept in buckets, after a run that adjusts only companies with an event among their latest rows."""
    target = fresh_folder(t.spark, "adjusted")
    put(domain.market_prices(t).select("company_id", "day", "close"), target, 0, ["company_id"])
    touched = adjust_touched(t.spark, target, 1, last=RECENT)
    rows = current(t.spark, target).select("company_id", "day", "close")
    return rows.join(touched, "company_id", "left").select("company_id", "day", "close", F.coalesce("events", F.lit(0)).cast("long").alias("recent_events"))


# ---- bound parameters -----------------------------------------------------------------------------------------------
#: A name that ends a pasted literal and widens the condition.
BREAKS_OUT = "x' OR '1' = '1"


@query("bound_names", """
SELECT s_suppkey AS company_id, s_name AS company_name FROM supplier ORDER BY s_suppkey LIMIT 20""")
def bound_names(t: Tables) -> DataFrame:
    """Companies by a list of names that is bound as one value, among them one that would break out of a pasted list."""
    names = [r["company_name"] for r in domain.companies(t).orderBy("company_id").limit(20).collect()]  # a user's watch list
    return select(t, "SELECT company_id, company_name FROM {companies} WHERE array_contains(:names, company_name)", names=[*names, BREAKS_OUT])


@query("bound_patterns", with_tables("monthly", then="""
SELECT company_id, max(report_key) AS report_key FROM monthly JOIN supplier ON s_suppkey = company_id WHERE s_name LIKE '%#0000%' AND coalesce(value3, 0) >= 1000000 GROUP BY 1"""))
def bound_patterns(t: Tables) -> DataFrame:
    """The latest report over a least amount of each company whose name holds a text; the text that would break out finds none."""
    text = """SELECT company_id, max(report_key) AS report_key FROM {sales} JOIN {companies} USING (company_id)
              WHERE company_name LIKE concat('%', :name, '%') AND coalesce(value3, 0) >= :least GROUP BY company_id"""
    found = select(t, text, name="#0000", least=1_000_000)
    return found.unionAll(select(t, text, name=BREAKS_OUT, least=1_000_000))


@query("bound_latest", with_tables("interim", then="""
SELECT company_id, jyear, jmonth, revenue FROM interim WHERE jyear * 100 + jmonth < 199912
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY jyear DESC, jmonth DESC) <= 3"""))
def bound_latest(t: Tables) -> DataFrame:
    """Each company's latest reports before a bound month, as many as a bound number says."""
    return select(t, """SELECT company_id, jyear, jmonth, revenue FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY jyear DESC, jmonth DESC) AS rn FROM {reports} WHERE jyear * 100 + jmonth < :before) WHERE rn <= :top""", before=199912, top=3)
