"""Prices of assets from the market's: the latest, or all since the history's first day, and adjustment of what events touch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.corporate import back_adjust, find_events
from quantloom.operators.joins import spread_join
from quantloom.operators.state import merge_upsert
from quantloom.sources.buckets import current, rewrite
from quantloom.sources.store import written

#: What a day's key looks like, fixed.
DATE_KEY = r"^\d{4}/\d{2}/\d{2}$"


@dataclass(frozen=True)
class Synced:
    prices: DataFrame
    updated: DataFrame
    missing: DataFrame


def sync_prices(assets: DataFrame, quotes: DataFrame, prices: DataFrame, history: DataFrame | None = None) -> Synced:
    """prices (date_key, asset_id, price) brought up to date from quotes (symbol, day, date_key, last, close).

    An asset (asset_id, name, symbol) without a symbol is traded by its name. The price of a day is the last one, or the
    close where that isn't above zero, or none. Without history the latest quote of each symbol counts, whatever its
    key; with it, all quotes from the first key of history (date_key) on, and prices before that are removed; an empty
    history sets no bound. Quotes without a proper key are passed over. updated has, of each asset for which a price
    was set, that of its latest quote, 0 where this one had none; missing names the others.
    """
    c = F.col
    assets = assets.withColumn("symbol", F.coalesce(F.nullif("symbol", F.lit("")), "name"))
    proper = c("date_key").rlike(DATE_KEY)
    if history is None:
        latest = quotes.groupBy("symbol").agg(F.max_by(F.struct("day", "date_key", "last", "close"), "day").alias("q"))
        rows = latest.select("symbol", "q.*").filter(proper)
    else:
        floor = F.broadcast(history.agg(F.coalesce(F.min("date_key"), F.lit("")).alias("__floor")))  # one row
        rows = quotes.crossJoin(floor).filter(proper & (c("date_key") >= c("__floor"))).drop("__floor")
        prices = prices.crossJoin(floor).filter(c("date_key") >= c("__floor")).drop("__floor")
    price = F.when(c("last") > 0, c("last")).when(c("close") > 0, c("close"))
    met = spread_join(rows.withColumn("price", price), assets, ["symbol"], ["day"])
    set_ = met.filter(c("price").isNotNull()).select("date_key", "asset_id", "price")
    last = met.groupBy("asset_id", "name", "symbol").agg(F.max_by(F.struct("date_key", "price"), "day").alias("q"), F.count("price").alias("n")).filter("n > 0")
    updated = last.select("asset_id", "name", "symbol", c("q.date_key").alias("date_key"), F.coalesce("q.price", F.lit(0.0)).alias("price"))
    return Synced(merge_upsert(prices, set_, ["date_key", "asset_id"]), updated, assets.join(updated.select("asset_id"), "asset_id", "left_anti").select("name"))


def adjust_touched(spark, target: str, number: int, threshold_pct: float = 12.0, last: int = 14, columns: Sequence[str] = ("close",)) -> DataFrame:
    """Adjust the prices kept in buckets under target for corporate events among each company's latest `last` rows.

    Only the buckets that hold a company with such an event are read again and written, as version `number`; within them
    the other companies' rows go over as they are. Files of other buckets are not touched. Returns the companies.
    """
    events = find_events(current(spark, target).drop("bucket"), threshold_pct, last=last)
    touched = written(events.groupBy("company_id").agg(F.count(F.lit(1)).alias("events")), "touched")

    def adjusted(rows: DataFrame) -> DataFrame:
        own = rows.join(touched.select("company_id"), "company_id", "left_semi")
        return back_adjust(own, threshold_pct, columns=columns).unionByName(rows.join(touched.select("company_id"), "company_id", "left_anti"))

    rewrite(spark, target, number, ["company_id"], touched.select("company_id"), adjusted)
    return touched
