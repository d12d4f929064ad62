"""Files that leave, facts by ticker, names of queries, household history by differences."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.functions import text
from quantloom.plans import exports, lookups, registry
from quantloom.sources import files


def shown(spark, make, values, kind):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("x"))).collect()]


def test_cells(spark):
    number = lambda d: lambda x: text.csv_number(x, d)
    assert shown(spark, number(1), [0.0, None, 0.25, 0.35, -0.04, 12345678.95, 1e15], "double") == ["", "", "0.2", "0.3", "-0.0", "12345678.9", "1000000000000000.0"]
    assert shown(spark, number(0), [0.5, 1.5, -2.5, 56.99999999999999], "double") == ["0", "2", "-2", "57"]
    assert shown(spark, text.csv_quoted, ['a "b",\r\nc', "", None], "string") == ['"a \'b\', c"', '""', '""']
    assert shown(spark, text.csv_flag, [True, False, None], "boolean") == ["بله", "", ""]


def test_headed_lines(spark, tmp_path):
    lines = spark.range(100).repartitionByRange(3, "id").select(F.col("id").cast("string").alias("line"))
    head = files.write_headed_lines(lines, f"{tmp_path}/out", ["a", "نام"])
    texts = [p.read_text("utf-8") for p in sorted(Path(tmp_path).glob("out/part-*")) if p.stat().st_size]
    assert len(texts) == 3 and all(t.startswith("﻿a,نام\n") and t.count("نام") == 1 for t in texts)
    assert head == "﻿a,نام"
    assert sorted(int(x) for t in texts for x in t.splitlines()[1:]) == list(range(100))
    files.write_headed_lines(lines.limit(0), f"{tmp_path}/none", ["a"])
    assert spark.read.text(f"{tmp_path}/none").filter("value <> ''").count() == 0


def test_list_has_a_header_for_each_cell():
    assert len(exports.HEADERS) == 2 + len(exports.LIST) + len(exports.FLAGS) == 37
    assert len(set(exports.HEADERS)) == 37


def facts(spark, rows):
    return spark.createDataFrame(rows, "report_id int, fact_name string, value double")


def test_facts_are_imported_once(spark, tmp_path):
    companies = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "company_id int, ticker string")
    reports = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (40, 4)], "report_id int, company_id int")
    published = facts(spark, [(10, "x", 1.0), (11, "x", 2.0), (11, "x", 2.0), (20, "y", 3.0), (40, "z", 4.0)])
    store = f"{tmp_path}/store"
    facts(spark, [(10, "x", 1.0)]).write.parquet(store)

    def read(*tickers):
        asked = spark.createDataFrame([(t,) for t in tickers], "ticker string")
        rows = lookups.facts_of(asked, store, reports, companies, published).collect()
        return sorted((r["ticker"], r["report_id"], r["value"], r["imported"]) for r in rows)

    # what the store has of a ticker is all that it gives; a ticker without any is imported whole
    assert read("A", "B", "B", "C", "none", None) == [("A", 10, 1.0, False), ("B", 20, 3.0, True)]
    assert read("A", "B") == [("A", 10, 1.0, False), ("B", 20, 3.0, False)]
    assert spark.read.parquet(store).count() == 2
    assert read() == []


def test_repeated_facts_are_imported_as_they_are(spark, tmp_path):
    companies = spark.createDataFrame([(1, "A")], "company_id int, ticker string")
    reports = spark.createDataFrame([(11, 1)], "report_id int, company_id int")
    published, store = facts(spark, [(11, "x", 2.0), (11, "x", 2.0), (None, "x", 5.0)]), f"{tmp_path}/store"
    facts(spark, []).write.parquet(store)
    rows = lookups.facts_of(spark.createDataFrame([("A",)], "ticker string"), store, reports, companies, published)
    assert [(r["value"], r["imported"]) for r in rows.collect()] == [(2.0, True)] * 2


def test_a_name_is_registered_once():
    registry.queries()
    with pytest.raises(ValueError, match="registered already"):
        registry.query("quant_score")(lambda t: None)


def test_raw_and_normal_keys_differ(spark):
    raw, normal = shown(spark, lambda x: F.struct(lookups.raw_key(x).alias("raw"), text.company_key(x).alias("normal")), ["شركت ۱", "شرکت 1"], "string")
    assert raw["normal"] == normal["normal"] == normal["raw"] != raw["raw"]


def test_view_keeps_stability_unrounded(spark):
    """The rank key of the same name is rounded to six digits; what is shown is rounded once, from the figure itself."""
    from quantloom.plans.score import base_metrics, derived, score_view
    from quantloom.sources.domain import Tables
    from tests.conftest import SMALL

    t = Tables(spark, SMALL)
    want = dict(derived(base_metrics(t)).select("company_id", "st").collect())
    got = dict(score_view(t).select("company_id", "st").collect())
    assert got == want and any(x is not None and round(x, 6) != x for x in got.values())
