"""The cross sections' prices: one shuffle of lines, thirty-row figures of month ends alone."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators.corporate import price_index
from quantloom.plans.crosssection import _prices, cross_sections, steady_prices
from quantloom.plans.score import market_summary
from quantloom.sources.domain import Tables, market_prices
from tests.conftest import SMALL


@pytest.mark.parametrize("made", [_prices, lambda t: market_summary(market_prices(t, ["company_id"])), lambda t: market_prices(t)], ids=["month ends", "summary", "prices"])
def test_lines_are_shuffled_once_and_sorted_after_it(spark, made):
    text = made(Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "Sort" not in text[text.index("Exchange hashpartitioning"):]


def test_figures_of_thirty_rows_are_those_of_windows_over_all_days(spark):
    t = Tables(spark, SMALL)
    order = Window.partitionBy("company_id").orderBy("day")
    last = order.rowsBetween(-29, 0)
    rows = price_index(steady_prices(t)).withColumns({
        "i": F.row_number().over(order), "vol": F.stddev_samp(F.col("day_return") * 100.0).over(last), "liq": F.avg("trade_value").over(last), "next": F.lead("day").over(order)})
    rows = rows.filter("next IS NULL OR date_trunc('month', next) > date_trunc('month', day)")
    late = lambda c: F.when(F.col("i") >= 31, F.col(c)).alias(c)
    want = {(r[0], r[1]): tuple(r)[2:] for r in rows.select("company_id", "day", "i", late("vol"), late("liq")).collect()}
    got = {(r[0], r[1]): tuple(r)[2:] for r in _prices(t).select("company_id", "day", "p.i", "p.vol", "p.liq").collect()}
    assert got.keys() == want.keys() and any(v[1] is not None for v in want.values())
    for key, (i, vol, liq) in want.items():
        assert got[key][0] == i and got[key][2] == liq
        assert got[key][1] is None if vol is None else got[key][1] == pytest.approx(vol, rel=1e-12, abs=1e-12)


def test_projections_too_long_for_the_compiler_are_not_generated_whole(spark):
    cross_sections(Tables(spark, SMALL))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
