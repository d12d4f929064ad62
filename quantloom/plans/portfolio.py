"""Portfolios and household assets: valuation, as-of prices, histories, JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import cents, ratio, round_half
from quantloom.operators.asof import asof_join, asof_one
from quantloom.plans.registry import query
from quantloom.sources import domain
from quantloom.sources.domain import Tables, with_tables

HOLDING = "array<struct<item:string,count:bigint>>"


def value_holdings(held: DataFrame, live: DataFrame) -> DataFrame:
    """held (user_id, item_id, quantity, cost) with live price, value, gain, percent, and weight in the user's whole.

    Without a live price over 0 the value is 0 and the gain is minus the cost.
    """
    rows = held.join(live.filter("price > 0"), "item_id", "left").withColumn("value", F.col("quantity") * F.coalesce("price", F.lit(0.0)))
    whole = F.sum("value").over(Window.partitionBy("user_id"))
    return rows.withColumns({"gain": F.col("value") - F.col("cost"), "gain_pct": ratio(F.col("value") - F.col("cost"), F.col("cost")) * 100.0,
                             "weight": F.coalesce(ratio(F.col("value"), whole) * 100.0, F.lit(0.0))})


_LIVE_SQL = "live AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 5 <> 0 THEN floor(p_retailprice * 100.0 + 0.5) ELSE 0e0 END AS price FROM part)"


def live_prices(t: Tables, *more: Column) -> DataFrame:
    price = F.floor(F.col("p_retailprice") * 100.0 + 0.5).cast("double")
    return t("part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 5 != 0, price).otherwise(0.0).alias("price"), *more)


@query("portfolio_valuation", with_tables("held", then=f"""-- more{_LIVE_SQL},
valued AS (SELECT h.*, quantity * coalesce(price, 0) AS value FROM held h LEFT JOIN live l ON l.item_id = h.item_id AND price > 0)
SELECT user_id, item_id, value, value - cost AS gain, floor((value - cost) / nullif(cost, 0) * 1e2 * 1e4 + 5e-1) / 1e4 AS gain_pct,
       floor(coalesce(value / nullif(sum(value) OVER (PARTITION BY user_id), 0) * 1e2, 0e0) * 1e4 + 5e-1) / 1e4 AS weight FROM valued"""))
def portfolio_valuation(t: Tables) -> DataFrame:
    df = value_holdings(domain.holdings(t), live_prices(t))
    return df.select("user_id", "item_id", "value", "gain", round_half(F.col("gain_pct"), 4).alias("gain_pct"), round_half(F.col("weight"), 4).alias("weight"))


@query("viewed_item_counts", "SELECT user_id, event_type AS item, count(*) AS n FROM events GROUP BY 1, 2")
def viewed_item_counts(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id", F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))


def count_view(items, item):
    """A JSON list of items and counts with one more view of item; malformed JSON counts as an empty list."""
    held = F.coalesce(F.from_json(items, HOLDING), F.array().cast(HOLDING))
    raised = F.transform(held, lambda e: F.when(e["item"] == item, F.struct(e["item"].alias("item"), (e["count"] + 1).alias("count"))).otherwise(e))
    new = F.array(F.struct(item.alias("item"), F.lit(1).cast("bigint").alias("count")))
    return F.to_json(F.when(F.exists(held, lambda e: e["item"] == item), raised).otherwise(F.concat(held, new)))


def drop_item(items, item):
    held = F.coalesce(F.from_json(items, HOLDING), F.array().cast(HOLDING))
    return F.to_json(F.filter(held, lambda e: e["item"] != item))


@query("portfolio_json_upsert", """
SELECT c_custkey AS user_id,
       CASE c_custkey % 3 WHEN 0 THEN '[{"item":"a","count":2}]' WHEN 1 THEN '[{"item":"b","count":5},{"item":"a","count":1}]' ELSE '[{"item":"a","count":1}]' END AS items,
       CASE c_custkey % 3 WHEN 1 THEN '[{"item":"b","count":5}]' ELSE '[]' END AS without FROM customer""")
def portfolio_json_upsert(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    before = F.when(k == 0, '[{"item":"a","count":1}]').when(k == 1, '[{"item":"b","count":5}]').otherwise("not json")
    rows = t("customer").select(F.col("c_custkey").alias("user_id"), count_view(before, F.lit("a")).alias("items"))
    return rows.withColumn("without", drop_item(F.col("items"), F.lit("a")))


@query("json_props_extract", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_props_extract(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


# ---- household assets: people are nations, assets are parts ---------------------------------------------------------
#: Commission by category, fixed values.
COMMISSION = {"gold": 0.015, "dollar": 0.01, "stock": 0.0088, "other": 0.0}
_CATEGORY = "CASE p_partkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'dollar' WHEN 2 THEN 'stock' ELSE 'other' END"
_RATE = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {COMMISSION[c] * 1e4:.0f}e-4" for i, c in enumerate(("gold", "dollar", "stock"))) + " ELSE 0e0 END"


def assets(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("asset_id"), F.expr(_CATEGORY).alias("category"), F.expr(_RATE).alias("rate"), (F.col("p_partkey") % 9 != 0).alias("active"))


def family_holdings(t: Tables) -> DataFrame:
    people = t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("person_id"))
    return domain.holdings(t).join(people, "user_id").groupBy("person_id", F.col("item_id").alias("asset_id")).agg(F.sum("quantity").alias("quantity"), F.sum("cost").alias("cost"))


def asset_prices(t: Tables) -> DataFrame:
    """Monthly mean unit prices in cents: asset_id, day (of the month's first), price."""
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    return t("lineitem").groupBy(F.col("l_partkey").alias("asset_id"), month.alias("day")).agg(
        F.floor(F.sum(F.floor(F.col("l_extendedprice") * 100.0 + 0.5).cast("double")) / F.sum("l_quantity") + 0.5).cast("double").alias("price"))


_FAMILY_SQL = f"""
assets AS (SELECT p_partkey AS asset_id, {_CATEGORY} AS category, {_RATE} AS rate, p_partkey % 9 <> 0 AS active FROM part),
fam AS (SELECT c_nationkey AS person_id, item_id AS asset_id, sum(quantity) AS quantity, sum(cost) AS cost FROM held JOIN customer ON c_custkey = user_id GROUP BY 1, 2),
prices AS (SELECT l_partkey AS asset_id, date_trunc('month', l_shipdate)::DATE AS day, floor(sum(floor(l_extendedprice * 100.0 + 0.5)) / sum(l_quantity) + 0.5) AS price FROM lineitem GROUP BY 1, 2),
latest AS (SELECT asset_id, max_by(price, day) AS price FROM prices GROUP BY 1)"""


@query("latest_price_subquery", with_tables("held", then=f"-- more{_FAMILY_SQL}\nSELECT * FROM latest"))
def latest_price(t: Tables) -> DataFrame:
    return asset_prices(t).groupBy("asset_id").agg(F.max_by("price", "day").alias("price"))


def net_value():
    return F.floor(F.col("quantity") * F.col("price") * (1.0 - F.col("rate")) + 0.5).cast("double")


@query("family_state_assets", with_tables("held", then=f"""-- more{_FAMILY_SQL},
valued AS (SELECT f.*, category, floor(quantity * price * (1e0 - rate) + 5e-1) AS value FROM fam f JOIN assets a USING (asset_id) LEFT JOIN latest USING (asset_id) WHERE active)
SELECT asset_id, category, sum(quantity) AS quantity, coalesce(sum(value), 0) AS value, sum(cost) AS cost FROM valued GROUP BY 1, 2"""))
def family_state_assets(t: Tables) -> DataFrame:
    """Totals of each active asset over all people."""
    return _valued(t).groupBy("asset_id", "category").agg(F.sum("quantity").alias("quantity"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.sum("cost").alias("cost"))


def _valued(t: Tables) -> DataFrame:
    return family_holdings(t).join(assets(t).filter("active"), "asset_id").join(latest_price(t), "asset_id", "left").withColumn("value", net_value())


@query("family_state_people", with_tables("held", then=f"""-- more{_FAMILY_SQL},
valued AS (SELECT f.*, category, floor(quantity * price * (1e0 - rate) + 5e-1) AS value FROM fam f JOIN assets a USING (asset_id) LEFT JOIN latest USING (asset_id) WHERE active),
cash AS (SELECT c_nationkey AS person_id, sum(floor(c_acctbal * 100.0 + 0.5)) AS cash FROM customer GROUP BY 1)
SELECT person_id, coalesce(sum(value) FILTER (category = 'gold'), 0) AS gold, coalesce(sum(value) FILTER (category = 'dollar'), 0) AS dollar,
       coalesce(sum(value) FILTER (category NOT IN ('gold', 'dollar')), 0) AS stocks, any_value(cash) AS cash, floor((sum(value) - sum(cost)) / nullif(sum(cost), 0) * 1e6 + 5e-1) / 1e6 AS gain_share
FROM valued LEFT JOIN cash USING (person_id) GROUP BY 1"""))
def family_state_people(t: Tables) -> DataFrame:
    """Value by category, cash and gain of each person; categories other than gold and dollar count as stocks."""
    c = F.col("category")
    part = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0.0)).alias(name)
    people = _valued(t).groupBy("person_id").agg(
        part(c == "gold", "gold"), part(c == "dollar", "dollar"), part(~c.isin("gold", "dollar"), "stocks"),
        round_half(ratio(F.sum("value") - F.sum("cost"), F.sum("cost")), 6).alias("gain_share"))
    cash = t("customer").groupBy(F.col("c_nationkey").alias("person_id")).agg(F.sum(F.floor(F.col("c_acctbal") * 100.0 + 0.5).cast("double")).alias("cash"))
    return people.join(cash, "person_id", "left")


@query("family_total_asof", with_tables("held", then=f"""-- more{_FAMILY_SQL},
past AS (SELECT asset_id, max_by(price, day) AS price FROM prices WHERE day <= DATE '1998-06-15' GROUP BY 1)
SELECT coalesce(sum(floor(quantity * price * (1e0 - rate) + 5e-1)), 0) AS total FROM fam JOIN assets USING (asset_id) JOIN past USING (asset_id)"""))
def family_total_asof(t: Tables) -> DataFrame:
    """What all holdings, of inactive assets too, were worth on one day."""
    past = asof_one(asset_prices(t), "asset_id", "day", "price", F.lit("1998-06-15").cast("date"))
    return family_holdings(t).join(assets(t), "asset_id").join(past, "asset_id").agg(F.coalesce(F.sum(net_value()), F.lit(0.0)).alias("total"))


def half_years() -> list[str]:
    """A fixed list of days."""
    ends = [(f"{year}-06-30", f"{year}-12-30") for year in range(1995, 2002)]
    return [day for both in ends for day in both]


def family_history(t: Tables) -> DataFrame:
    """person_id, day, total: holdings at each half year's price, or the earliest price before there is one.

    Of each asset the prices of all days are columns of one row, so a holding meets one row and no day, and is added up to
    all days' totals at once; prices are grouped once."""
    days = half_years()
    known = F.when(F.col("price").isNotNull(), F.col("day"))
    at = lambda d: F.coalesce(F.max_by("price", F.when(F.col("day") <= F.lit(d).cast("date"), known)), F.min_by("price", known))
    prices = asset_prices(t).groupBy("asset_id").agg(*(at(d).alias(f"price{k}") for k, d in enumerate(days)))
    held = family_holdings(t).join(assets(t), "asset_id").join(prices, "asset_id")
    worth = lambda k: F.floor(F.col("quantity") * F.col(f"price{k}") * (1.0 - F.col("rate")) + 0.5).cast("double")
    totals = held.groupBy("person_id").agg(*(F.sum(worth(k)).alias(f"total{k}") for k in range(len(days))))
    rows = F.inline(F.array(*(F.struct(F.lit(d).cast("date").alias("day"), F.col(f"total{k}").alias("total")) for k, d in enumerate(days))))
    return totals.select("person_id", rows)


_HISTORY_SQL = f"""{_FAMILY_SQL},
dates AS (SELECT (DATE '1995-06-30' + INTERVAL (6 * i) MONTH)::DATE AS day FROM range(14) r(i) WHERE DATE '1995-06-30' + INTERVAL (6 * i) MONTH <= DATE '2001-12-31'),
seen AS (
  SELECT p.asset_id, d.day, coalesce(max_by(p.price, p.day) FILTER (p.day <= d.day), min_by(p.price, p.day)) AS price FROM prices p CROSS JOIN dates d GROUP BY 1, 2),
history AS (SELECT person_id, day, sum(floor(quantity * price * (1e0 - rate) + 5e-1)) AS total FROM fam JOIN seen USING (asset_id) JOIN assets USING (asset_id) GROUP BY 1, 2)"""


@query("family_history_rebuild", with_tables("held", then=f"-- more{_HISTORY_SQL}\nSELECT * FROM history"))
def family_history_rebuild(t: Tables) -> DataFrame:
    return family_history(t)


@query("family_history_delta", with_tables("held", then=f"""-- more{_HISTORY_SQL}
SELECT person_id, day, total, total - lag(total) OVER p AS change_value, floor((total - lag(total) OVER p) / nullif(lag(total) OVER p, 0) * 1e6 + 5e-1) / 1e6 AS change_share
FROM history WINDOW p AS (PARTITION BY person_id ORDER BY day)"""))
def family_history_delta(t: Tables) -> DataFrame:
    before = F.lag("total").over(Window.partitionBy("person_id").orderBy("day"))
    rows = family_history(t).withColumn("before", before)
    change = F.col("total") - F.col("before")
    return rows.select("person_id", "day", "total", change.alias("change_value"), round_half(ratio(change, F.col("before")), 6).alias("change_share"))


@query("family_history_recorded", with_tables("held", then=f"""-- more{_FAMILY_SQL},
recorded AS (SELECT max(o_orderdate::DATE) AS day, sum(floor(o_totalprice * 100.0 + 0.5)) AS total FROM orders GROUP BY date_trunc('month', o_orderdate)),
seen AS (
  SELECT p.asset_id, r.day, coalesce(max_by(p.price, p.day) FILTER (p.day <= r.day), min_by(p.price, p.day)) AS price FROM prices p CROSS JOIN recorded r GROUP BY 1, 2),
worth AS (SELECT person_id, day, sum(floor(quantity * price * (1e0 - rate) + 5e-1)) AS worth FROM fam JOIN seen USING (asset_id) JOIN assets USING (asset_id) GROUP BY 1, 2),
people AS (SELECT c_nationkey AS person_id, sum(floor(c_acctbal * 100.0 + 0.5)) AS cash FROM customer GROUP BY 1)
SELECT r.day, p.person_id, coalesce(worth, 0e0) + cash AS worth, total FROM recorded r CROSS JOIN people p LEFT JOIN worth w ON w.day = r.day AND w.person_id = p.person_id"""))
def family_history_recorded(t: Tables) -> DataFrame:
    """Each person's holdings and cash on every date that has a recorded total, beside that total: what somebody holds counts at the
    price of the date, or the earliest price before there is one.

    No holding meets all dates. A price changes what a holding is worth by a difference; the differences of a person and day
    add up before they meet the dates, and run on over them, the first price's from the beginning of time.
    """
    month = F.date_trunc("month", "o_orderdate")
    recorded = t("orders").groupBy(month.alias("m")).agg(F.max(F.to_date("o_orderdate")).alias("day"), F.sum(cents(F.col("o_totalprice"))).alias("total")).drop("m")
    before = F.lag("price").over(Window.partitionBy("asset_id").orderBy("day"))
    prices = asset_prices(t).withColumn("before", before)
    held = family_holdings(t).join(assets(t), "asset_id").select("person_id", "asset_id", "quantity", "rate")
    worth = lambda price: F.floor(F.col("quantity") * price * (1.0 - F.col("rate")) + 0.5).cast("double")
    start = F.when(F.col("before").isNotNull(), F.col("day")).otherwise(F.lit("0001-01-01").cast("date"))
    moves = held.join(prices, "asset_id").select("person_id", start.alias("day"), (worth(F.col("price")) - F.coalesce(worth(F.col("before")), F.lit(0.0))).alias("change"))
    moves = moves.groupBy("person_id", "day").agg(F.sum("change").alias("change"))
    accounts = t("customer").groupBy(F.col("c_nationkey").alias("person_id")).agg(F.sum(cents(F.col("c_acctbal"))).alias("cash"))
    people = accounts.join(moves.select("person_id").distinct(), "person_id", "full")
    asked = people.crossJoin(F.broadcast(recorded))  # a row a month; the rows of the result
    both = moves.withColumn("asked", F.lit(0)).unionByName(asked.withColumn("asked", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("person_id").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("worth", F.coalesce(F.sum("change").over(so_far), F.lit(0.0)) + F.coalesce("cash", F.lit(0.0))).filter("asked = 1")
    return rows.select("day", "person_id", "worth", "total")


_PROBES_SQL = """
probes AS (SELECT o_orderkey AS probe_id, o_custkey % (SELECT count(*) FROM supplier) + 1 AS company_id, o_orderdate::DATE AS day FROM orders)"""


@query("asof_tolerance", with_tables("market", then=f"""-- more{_PROBES_SQL}
SELECT probe_id, p.company_id, p.day, CASE WHEN date_diff('day', m.day, p.day) <= 30 THEN close END AS close, CASE WHEN date_diff('day', m.day, p.day) <= 30 THEN m.day END AS close_at
FROM probes p ASOF LEFT JOIN market m ON m.company_id = p.company_id AND m.day <= p.day"""))
def asof_tolerance(t: Tables) -> DataFrame:
    """The last close before each order's day, unless it is older than 30 days."""
    n = t("supplier").agg(F.count(F.lit(1)).alias("n"))
    probes = t("orders").crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("probe_id"), (F.col("o_custkey") % F.col("n") + 1).alias("company_id"), F.to_date("o_orderdate").alias("day"))
    return asof_join(probes, domain.market_prices(t), "company_id", "day", "close", tolerance_days=30)
