"""Statements with named parameters over the domain's tables: values are bound, never pasted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quantloom.sources import domain
from quantloom.sources.domain import Tables

#: Names by which a statement may use the tables, in braces.
VIEWS = {"companies": domain.companies, "sales": domain.monthly_sales, "reports": domain.interim_reports, "prices": domain.market_prices}


def select(t: Tables, text: str, **values) -> DataFrame:
    """The rows of a statement in which {companies} and the like stand for tables and :name for a value.

    A value is bound to the parsed statement, so quotes in it are part of the value; a list is bound as an array. Names
    without a value, or unknown tables, are errors.
    """
    used = {name: make(t) for name, make in VIEWS.items() if f"{{{name}}}" in text}
    return t.spark.sql(text, args=values, **used)
