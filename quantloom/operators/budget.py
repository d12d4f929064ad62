"""Work in order until its budget is spent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.ranking import with_running
from quantloom.sources.store import written


def within_budget(todo: DataFrame, order: Sequence[Column], cost: Column, budget: float) -> tuple[DataFrame, DataFrame]:
    """What of todo a run gets done before its budget is spent, and what is left for the next one, in order.

    The first row that would pass the budget stops the run, though a cheaper one may stand behind it. Costs run on by
    ranges of the order, so no task holds the whole list. Costs are not below zero; null counts as none.
    """
    spent = F.coalesce(cost.cast("double"), F.lit(0.0))
    rows = written(with_running(todo, [], order, spent, "__before").withColumn("__cost", spent), "budget")
    done = F.col("__before") + F.col("__cost") <= budget
    return rows.filter(done).select(*todo.columns), rows.filter(~done).select(*todo.columns)
