"""Stores, quotas, synced and adjusted prices, element trees, bound parameters, joins on hot keys."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quantloom.operators import budget, elements, html, joins, ranking, sync
from quantloom.sources import buckets, cache, parameters, store
from quantloom.sources.domain import Tables
from tests.conftest import SMALL

DAY = datetime.date(2024, 1, 1)


def test_read_through_fetches_what_is_absent_or_old(spark, tmp_path):
    asked_for: list[list[str]] = []
    remote = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "key string, val int")

    def fetch(keys):
        asked_for.append(sorted(r["key"] for r in keys.collect()))
        return remote.join(keys, "key", "left_semi")

    def read(run, keys, now):
        rows, absent = cache.read_through(spark.createDataFrame([(k,) for k in keys], "key string"), f"{tmp_path}/store", run, fetch, ["key"], now, 10)
        assert absent.count() == len(asked_for[-1])
        return sorted((r["key"], r["val"]) for r in rows.collect())

    assert read(1, ["a", "b", "a"], "2024-01-01") == [("a", 1), ("a", 2), ("b", 3)] and asked_for[-1] == ["a", "b"]
    before = sorted(Path(tmp_path).glob("store/run=1/*.parquet"))
    assert read(2, ["a", "b"], "2024-01-05") == [("a", 1), ("a", 2), ("b", 3)] and asked_for[-1] == []
    assert read(3, ["b", "c", "none"], "2024-01-05") == [("b", 3), ("c", 4)] and asked_for[-1] == ["c", "none"]
    remote = spark.createDataFrame([("a", 9)], "key string, val int")
    assert read(4, ["a", "c"], "2024-01-13") == [("a", 9), ("c", 4)] and asked_for[-1] == ["a"]
    assert sorted(Path(tmp_path).glob("store/run=1/*.parquet")) == before  # nothing stored is written again
    assert read(4, ["a", "c"], "2024-01-13") == [("a", 9), ("c", 4)] and asked_for[-1] == ["a"]  # a run that is repeated
    assert read(5, ["a", "c"], "2024-01-13") == [("a", 9), ("c", 4)] and asked_for[-1] == []
    assert cache.stored(spark, f"{tmp_path}/none", ["key"]) is None


def test_budget_stops_at_the_first_row_beyond_it(spark):
    todo = spark.createDataFrame([(i, c) for i, c in enumerate([5, None, 3, 4, 1, 0])], "k int, cost int")
    keys = lambda df: sorted(r["k"] for r in df.collect())
    done, left = budget.within_budget(todo, [F.asc("k")], F.col("cost"), 8)
    assert (keys(done), keys(left)) == ([0, 1, 2], [3, 4, 5])
    again, rest = budget.within_budget(left, [F.asc("k")], F.col("cost"), 8)
    assert keys(again) == [3, 4, 5] and keys(rest) == []
    none, all_ = budget.within_budget(todo, [F.desc("cost"), F.asc("k")], F.col("cost"), 4)
    assert keys(none) == [] and len(keys(all_)) == 6
    assert [x.count() for x in budget.within_budget(todo.limit(0), [F.asc("k")], F.col("cost"), 4)] == [0, 0]


def quotes_of(spark, rows):
    return spark.createDataFrame([(s, DAY + datetime.timedelta(d), k, a, b) for s, d, k, a, b in rows], "symbol string, day date, date_key string, last double, close double")


def test_sync_prices(spark):
    assets = spark.createDataFrame([(1, "one", "S1"), (2, "S2", ""), (3, "S3", None), (4, "four", "none"), (5, "five", "S5")], "asset_id int, name string, symbol string")
    quotes = quotes_of(spark, [("S1", 0, "1402/01/01", 5.0, 6.0), ("S1", 1, "1402/01/02", 0.0, 7.0), ("S2", 0, "1402/01/01", 8.0, 1.0), ("S2", 1, "bad", 9.0, 1.0),
                               ("S3", 0, "1402/01/01", None, 0.0), ("S5", 0, "1402/01/01", 2.0, 2.0), ("S5", 1, "1402/01/02", None, None)])
    prices = spark.createDataFrame([("1401/12/29", 1, 1.0), ("1402/01/02", 1, 1.0)], "date_key string, asset_id int, price double")
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    got = sync.sync_prices(assets, quotes, prices)
    assert rows(got.prices, "asset_id", "date_key", "price") == [(1, "1401/12/29", 1.0), (1, "1402/01/02", 7.0)]
    assert rows(got.updated, "asset_id", "symbol", "price") == [(1, "S1", 7.0)]
    assert rows(got.missing, "name") == [("S2",), ("S3",), ("five",), ("four",)]
    history = spark.createDataFrame([("1402/01/01",)], "date_key string")
    full = sync.sync_prices(assets, quotes, prices, history)
    assert rows(full.prices, "asset_id", "date_key", "price") == [(1, "1402/01/01", 5.0), (1, "1402/01/02", 7.0), (2, "1402/01/01", 8.0), (5, "1402/01/01", 2.0)]
    assert rows(full.updated, "asset_id", "date_key", "price") == [(1, "1402/01/02", 7.0), (2, "1402/01/01", 8.0), (5, "1402/01/02", 0.0)]
    assert rows(full.missing, "name") == [("S3",), ("four",)]
    none = sync.sync_prices(assets, quotes, prices, history.limit(0))
    assert none.prices.filter("date_key = '1401/12/29'").count() == 1


def test_adjustment_leaves_other_buckets_alone(spark, tmp_path):
    target = f"{tmp_path}/prices"
    steady = [(k, DAY + datetime.timedelta(d), 1000.0 + d) for k in range(40) for d in range(20)]
    halved = [(k, d, c / 2 if k == 7 and (d - DAY).days >= 18 else c / 2 if k == 8 and (d - DAY).days >= 3 else c) for k, d, c in steady]
    buckets.put(spark.createDataFrame(halved, "company_id long, day date, close double"), target, 0, ["company_id"])
    names = lambda: {p.parent.name: p.name for p in Path(target).glob("v=000000000/bucket=*/*.parquet")}
    before = names()
    touched = sync.adjust_touched(spark, target, 1, last=5)
    assert [r["company_id"] for r in touched.collect()] == [7]
    assert names() == before  # the first version stays, and only the bucket of company 7 has another
    assert len(list(Path(target).glob("v=000000001/bucket=*"))) == 1
    rows = {(r["company_id"], (r["day"] - DAY).days): r["close"] for r in buckets.current(spark, target).collect()}
    assert len(rows) == 800 and rows[7, 0] == round(1000 * rows[7, 18] / 1017) and rows[8, 0] == 1000.0 and rows[8, 5] == 502.5 and rows[9, 4] == 1004.0
    assert sync.adjust_touched(spark, target, 2, last=5).count() == 0 and not list(Path(target).glob("v=000000002"))


def test_element_rows(spark):
    page = """<body><div class=row onclick='pick(1)'><div><a href=x>A&amp;B</a> <i>new<div>in <b>ner</div></div><p>one<p>two<div
        data-x="<div>">&#1777; </div><br/></span></div><DIV ONCLICK="pick(2)"><div>open<div>deeper"""
    pages = spark.createDataFrame([(1, page, "p"), (2, None, "q"), (3, "<div onclick=other()><div>1</div></div>", "r")], "id int, html string, path string")
    rows = elements.element_rows(pages, "div", "onclick", "^pick").orderBy("row_no").collect()
    assert [(r["id"], r["row_no"], r["path"]) for r in rows] == [(1, 0, "body[1]/div[1]"), (1, 1, "body[1]/div[2]")]
    assert [tuple(b) for b in rows[0]["boxes"]] == [("A&Bnewinner", "A&B"), ("inner", None), ("\u06f1", None)]
    assert [tuple(b) for b in rows[1]["boxes"]] == [("opendeeper", None), ("deeper", None)]
    assert elements.element_rows(pages, "p", inner="b").count() == 2
    got = spark.range(1).select(html.links(F.lit("""<a href="a b">x</a><a class=k href='c'>y</a><A x><a HREF=no><a href = d>z</a><a data-href="e">""")).alias("l")).collect()[0]["l"]
    assert got == ["a b", "c", "no", "d"]


def test_statements_parse_pages_once(spark):
    """What is left of a statement's plan has no Python node: the cells are written."""
    from quantloom.plans import registry

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for name in ("income_statement", "monthly_report", "balance_and_cash"):
        df = registry.queries()[name](spark, SMALL)
        assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_bound_values_never_break_out(spark):
    t = Tables(spark, SMALL)
    text = "SELECT company_name FROM {companies} WHERE company_name = :name"
    name = t("supplier").first()["s_name"]
    assert [r[0] for r in parameters.select(t, text, name=name).collect()] == [name]
    for value in ("x' OR '1' = '1", "x'; DROP TABLE companies; --", "\\' OR 1=1"):
        assert parameters.select(t, text, name=value).count() == 0
    with pytest.raises(Exception, match="name"):
        parameters.select(t, text).count()


def test_spread_join(spark):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.9 else rnd.randrange(1, 50), i) for i in range(20_000)] + [(None, -1)]
    many, one = spark.createDataFrame(rows, "k int, i int"), spark.createDataFrame([(k, f"v{k}") for k in range(40)] + [(None, "n")], "k int, v string")
    got = joins.spread_join(many, one, ["k"], ["i"])
    assert sorted((r["i"], r["v"]) for r in got.collect()) == sorted((i, f"v{k}") for k, i in rows if k is not None and k < 40)
    left = joins.spread_join(many, one, ["k"], ["i"], "left")
    assert left.count() == len(rows) and left.filter("v IS NULL").count() == sum(k is None or k >= 40 for k, _ in rows)


def test_percentiles_with_a_value_that_most_share(spark):
    values = [7.0] * 5000 + [ranking.SENTINEL] * 3000 + [float(i) for i in range(100)] + [None] * 10
    df = store.written(spark.createDataFrame(list(enumerate(values)), "k int, f double"), "hot")
    got = {r["k"]: r["f_rank"] for r in ranking.percentiles(df, "k", {"f": ranking.Factor()}).collect()}
    known = [v for v in values if v is not None]
    for k in (0, 4999, 5000, 8000, 8050, 8099, 8105):
        v = values[k]
        want = 0.3 if v is None else 0.0 if v >= ranking.SENTINEL else (2 * sum(x < v for x in known) + known.count(v) - 1) / (2 * (len(known) - 1))
        assert got[k] == pytest.approx(want, abs=1e-12)


def test_clear_removes_the_tables_of_the_session(spark):
    df = store.written(spark.range(3), "gone")
    assert df.count() == 3
    store.clear(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(store.session_folder(spark))
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


@pytest.mark.parametrize("least", [0.1, 0.4, 0.75, 1.0])
def test_nearest_sets(spark, least):
    """Against all pairs, with sets of many words and of none; candidates grow with the sets, not with their square."""
    from quantloom.operators.resolve import nearest_sets

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["all"]
    make = lambda: ["all"] * (rnd.random() < 0.8) + rnd.sample(words, rnd.choice([0, 1, 2, 3, 4, 5, 10, 12]))
    left, right = [(i, make()) for i in range(120)], [(i, make()) for i in range(150)]
    a, b = spark.createDataFrame(left, "a int, words array<string>"), spark.createDataFrame(right, "b int, words array<string>")
    got = {r["a"]: (r["b"], r["near"]) for r in nearest_sets(a, b, least).collect()}
    want = {}
    for i, x in left:
        near = [(-len(set(x) & set(y)) / len(set(x) | set(y)), j) for j, y in right if set(x) & set(y)]
        if near and -min(near)[0] >= least - 1e-12:
            want[i] = (min(near)[1], pytest.approx(-min(near)[0]))
    assert got == want


def test_search_forms_no_pairs_of_common_words(spark):
    """A thousand names share a word and a letter: what a text is held against stays a row a text."""
    from quantloom.operators import resolve

    listed = spark.createDataFrame([(i, f"S{i}", f"common house {i}") for i in range(1000)], "item_id int, symbol string, name string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["S", "common", "s5 common", "house common", "S7", "zz", "", None, "mm common house 9 oo"])], "query_id int, text string")
    got = {r["query_id"]: (r["item_id"], r["how"]) for r in resolve.search(queries, listed).collect()}
    assert got == {0: (0, "substring"), 1: (0, "substring"), 3: (0, "fuzzy"), 4: (7, "exact"), 8: (9, "substring")}
    sets = lambda k, n: spark.createDataFrame([(i, ["common", "house", f"x{i}"]) for i in range(n)], f"{k} int, words array<string>")
    plan = resolve.nearest_sets(sets("a", 500), sets("b", 500), 0.1)
    assert plan.count() == 500 and "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()


def test_marked_csv(spark, tmp_path):
    from quantloom.sources import files

    rows = spark.createDataFrame([("a, \"b\"\r\nc", 1.25, 3.0), (None, None, 0.5), ("d", -2.0, None)], "name string, x double, y double").repartition(2)
    files.write_marked_csv(rows, f"{tmp_path}/csv", {"name": ("نام", None), "x": ("X", 1), "y": ("Y", 0)})
    lines = []
    for path in Path(tmp_path).glob("csv/*.csv"):
        raw = path.read_bytes()
        assert raw.startswith(b"\xef\xbb\xbf" + "نام,X,Y\n".encode())
        lines += raw.decode("utf-8-sig").splitlines()[1:]
    assert sorted(lines) == sorted(["\"a, 'b' c\",1.3,3", ",,1", "d,-2.0,"])


def test_a_failed_replacement_changes_nothing(spark, tmp_path):
    from quantloom.sources import files

    folder = f"{tmp_path}/t"
    first = files.replace_table(spark.range(3), folder)
    second = files.replace_table(spark.range(5), folder)
    with pytest.raises(Exception, match="stopped"):
        files.replace_table(spark.range(2).withColumn("id", F.when(F.col("id") == 1, F.raise_error(F.lit("stopped")).cast("long")).otherwise(F.col("id"))), folder)
    assert (first.count(), second.count()) == (3, 5)  # the version before stays for its readers
    assert files.replace_table(spark.range(7), folder).count() == 7
    assert files.ensure_table(spark, f"{tmp_path}/e", "a int, b string").count() == 0
    spark.createDataFrame([(1,)], "a int").write.mode("append").parquet(f"{tmp_path}/e")
    assert [tuple(r) for r in files.ensure_table(spark, f"{tmp_path}/e", "a int, b string").collect()] == [(1, None)]


def test_history_meets_no_day_with_a_holding_and_groups_prices_once(spark):
    from quantloom.plans.portfolio import family_history
    from quantloom.sources.domain import Tables

    plan = family_history(Tables(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and plan.count("date_trunc(month") == 1
    generated = [line for line in plan.splitlines() if "Generate" in line]
    assert len(generated) == 1 and plan.splitlines()[0] == generated[0]  # days come last, of totals


def test_deliveries_read_prices_that_are_written_once(spark):
    from quantloom.plans.runs import _arrivals

    for rows in _arrivals(Tables(spark, SMALL)):
        files = rows.inputFiles()
        assert files and not any("lineitem" in f for f in files)
