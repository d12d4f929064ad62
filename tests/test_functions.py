"""Column functions and operators on literal rows."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions import calendar, numeric, text
from quantloom.operators import asof, corporate, html, ranking, state, statements
from quantloom.sources import files


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("(۱٬۲۳۴)", -1234.0), ("-", None), ("12,5", 125.0), ("۳٫۵", 3.5), ("x1", None), ("", None), (None, None)])
def test_to_number(spark, given, want):
    assert one(spark, numeric.to_number(F.lit(given).cast("string"))) == want


def test_normalize_text(spark):
    assert one(spark, text.normalize_text(F.lit("  شركت‌ نمونه  "))) == "شرکت نمونه"


def test_first_day_of_1403(spark):
    assert one(spark, calendar.jalali_to_date(F.lit(1403), F.lit(1), F.lit(1))) == datetime.date(2024, 3, 20)


def test_calendar_round_trip(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1990-01-01', DATE'2030-12-31')) AS day")
    keys = days.withColumn("t", calendar.key_text(*calendar.date_to_jalali(F.col("day"))))
    assert keys.filter(calendar.jalali_to_date(*calendar.parts(F.col("t"))) != F.col("day")).count() == 0
    assert keys.select("t").distinct().count() == keys.count()
    leap = keys.filter(F.col("t").endswith("/12/30")).select(F.substring("t", 1, 4).alias("y")).collect()
    assert {"1399", "1403"} <= {r["y"] for r in leap} and "1402" not in {r["y"] for r in leap}


def test_date_keys(spark):
    assert one(spark, calendar.date_key(F.lit("1403/6/31"))) == 14030631 and one(spark, calendar.date_key(F.lit("soon"))) is None
    assert one(spark, calendar.either_calendar(F.lit(14030101))) == datetime.date(2024, 3, 20)
    assert one(spark, calendar.either_calendar(F.lit(20240320))) == datetime.date(2024, 3, 20)
    assert one(spark, calendar.either_calendar(F.lit(99990))) is None


@pytest.mark.parametrize(("a", "b", "want"), [(5e3, 5.0, 1e3), (5.0, 5.0, 1.0), (6.5e3, 5.0, None), (5.0, -5.0, None), (0.0, 1.0, None)])
def test_power_of_ten_ratio(spark, a, b, want):
    assert one(spark, numeric.power_of_ten_ratio(F.lit(a), F.lit(b))) == want


def test_clip_and_ramp(spark):
    assert one(spark, numeric.clip(F.lit(None).cast("double"), -1, 1)) is None and one(spark, numeric.clip(F.lit(9.0), -1, 1)) == 1.0
    assert [one(spark, numeric.ramp(F.lit(x).cast("double"), 20, 100, 8.0)) for x in (None, 10.0, 60.0, 200.0)] == [0.0, 0.0, 4.0, 8.0]


@pytest.mark.parametrize(("values", "want"), [
    ([None, None], [0.3, 0.3]), ([7.0], [0.5]), ([4.0, 4.0, 4.0], [0.5, 0.5, 0.5]), ([1.0, 2.0, 3.0], [0.0, 0.5, 1.0]),
    ([1.0, 999999.0, 3.0], [0.0, 0.0, 0.5]), ([None, 1.0, 1.0, 2.0], [0.3, 0.25, 0.25, 1.0])])
def test_percentiles(spark, values, want):
    df = spark.createDataFrame(list(enumerate(values)), "k int, f double")
    assert [r["f_rank"] for r in ranking.percentiles(df, "k", {"f": ranking.Factor()}).orderBy("k").collect()] == want
    low = ranking.percentiles(df, "k", {"f": ranking.Factor(lower_is_better=True)}).orderBy("k").collect()
    assert [r["f_rank"] for r in low] == [w if v is None or v >= ranking.SENTINEL or len([x for x in values if x is not None]) < 2 else 1 - w for v, w in zip(values, want)]


def test_asof_join(spark):
    seen = spark.sql("SELECT * FROM VALUES ('a', 5, 1.0), ('a', 9, 2.0), ('b', 3, 7.0) AS t(k, d, v)")
    asks = spark.sql("SELECT * FROM VALUES ('a', 4), ('a', 5), ('a', 8), ('a', 12), ('c', 1), ('b', 1) AS t(k, d)")
    got = {(r["k"], r["d"]): r["v"] for r in asof.asof_join(asks, seen, "k", "d", "v").collect()}
    assert got == {("a", 4): None, ("a", 5): 1.0, ("a", 8): 1.0, ("a", 12): 2.0, ("c", 1): None, ("b", 1): None}
    early = {(r["k"], r["d"]): r["v"] for r in asof.asof_join(asks, seen, "k", "d", "v", or_earliest=True).collect()}
    assert early["a", 4] == 1.0 and early["b", 1] == 7.0 and early["c", 1] is None


@pytest.mark.parametrize("keys", [1, 4])
def test_asof_join_hot_key(spark, keys):
    """A key that holds nine tenths of all rows is cut into ranges; what stands at a cut comes from the ranges before it."""
    rnd = random.Random(keys)
    key = lambda: None if keys > 1 and rnd.random() < 0.03 else 0 if rnd.random() < 0.9 else rnd.randrange(keys)
    seen = {(key(), rnd.randrange(50, 4000)): rnd.random() for _ in range(300)}
    asks = [(key(), rnd.randrange(0, 5000), i) for i in range(3000)]
    observed = spark.createDataFrame([(k, d, v) for (k, d), v in seen.items()], "k int, d int, v double")
    probes = spark.createDataFrame(asks, "k int, d int, i int")

    def plain(k, d, early=False):
        past = [t for x, t in seen if x == k and t <= d]
        ahead = [t for x, t in seen if x == k and t > d] if early else []
        return seen[k, max(past)] if past else seen[k, min(ahead)] if ahead else None

    joined = asof.asof_join(probes, observed, "k", "d", "v")
    assert {r["i"]: r["v"] for r in joined.collect()} == {i: plain(k, d) for k, d, i in asks}
    assert "hashpartitioning(k" not in joined._jdf.queryExecution().toString().split("Physical Plan")[1]
    early = asof.asof_join(probes, observed, "k", "d", "v", or_earliest=True)
    assert {r["i"]: r["v"] for r in early.collect()} == {i: plain(k, d, True) for k, d, i in asks}



def test_merges_are_idempotent(spark):
    old = spark.sql("SELECT * FROM VALUES (1, 10, 'x'), (2, 20, NULL) AS t(k, v, w)")
    new = spark.sql("SELECT * FROM VALUES (2, 21, 'y'), (3, 30, 'z') AS t(k, v, w)")
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "v", "w").collect())
    merged = state.merge_upsert(old, new, ["k"])
    assert rows(merged) == [(1, 10, "x"), (2, 21, "y"), (3, 30, "z")] == rows(state.merge_upsert(merged, new, ["k"]))
    assert rows(state.fill_nulls(old, new, ["k"])) == [(1, 10, "x"), (2, 20, "y"), (3, 30, "z")]
    assert rows(state.insert_absent(old, new, ["k"])) == rows(state.insert_absent(state.insert_absent(old, new, ["k"]), new, ["k"]))
    assert rows(state.update_by_key(old, new, ["k"], ["w"])) == [(1, 10, "x"), (2, 20, "y")]
    ids = state.with_new_ids(old, spark.sql("SELECT * FROM VALUES ('q', 1), ('p', 2) AS t(w, v)"), "k", ["w"])
    assert sorted((r["k"], r["w"]) for r in ids.collect()) == [(3, "p"), (4, "q")]


def price_rows(spark, closes, start=datetime.date(2020, 1, 1)):
    """Rows of one company; a close is a number, or a number and the days since the row before."""
    rows, day = [], start
    for c in closes:
        close, gap = c if isinstance(c, tuple) else (c, 1)
        day += datetime.timedelta(days=gap)
        rows.append((1, day, close))
    return spark.createDataFrame(rows, "company_id int, day date, close double")


@pytest.mark.parametrize(("closes", "want"), [
    ([100.0, 150.0], [1]), ([100.0, 70.0], [1]), ([100.0, 88.0], []), ([100.0, 87.9], [1]), ([100.0, 112.1], [1]), ([100.0, 112.0], []),
    ([100.0, 0.0, 90.0], [1]), ([100.0, None, 50.0], []), ([None, 100.0, 99.0], []), ([100.0, (119.0, 4)], []), ([100.0, (130.0, 4)], [1]),
    ([100.0, (140.0, 90)], []), ([100.0, (143.0, 90)], [1]), ([100.0], []), ([], [])])
def test_corporate_events(spark, closes, want):
    """Both ways, beyond 12 % and beyond 6 % a trading day of the gap, six days at most."""
    days = [r["day"] for r in price_rows(spark, closes).orderBy("day").collect()]
    got = corporate.find_events(price_rows(spark, closes)).collect()
    assert sorted(r["day"] for r in got) == [days[k] for k in want]


def test_events_among_the_latest_rows(spark):
    prices = price_rows(spark, [100.0, 50.0, 50.0, 80.0, 80.0])
    assert corporate.find_events(prices).count() == 2 and corporate.find_events(prices, last=2).count() == 1


def test_back_adjustment_rounds_each_event(spark):
    prices = price_rows(spark, [1001.0, 701.0, 455.0, 455.0]).withColumns({"low": F.col("close") - 1, "yesterday": F.lit(7.0)})
    out = corporate.back_adjust(prices, columns=("close", "low", "yesterday")).orderBy("day").collect()
    assert [r["close"] for r in out] == [455.0] * 4 and [r["yesterday"] for r in out] == [None, 455.0, 455.0, 455.0]
    assert [r["low"] for r in out] == [round(round(1000 * 701 / 1001) * 455 / 701), round(700 * 455 / 701), 454.0, 454.0]
    out = corporate.back_adjust(price_rows(spark, [5.0, 0.0, None, 4.0, 2.0]).withColumn("yesterday", F.lit(9.0)), columns=("close", "yesterday")).orderBy("day").collect()
    assert [r["close"] for r in out] == [2.0, 0.0, None, 2.0, 2.0]  # 5 * 0.5 is half way to 3, and 2 is even
    assert [r["yesterday"] for r in out] == [None, 2.0, 4.0, None, 2.0]
    quiet = price_rows(spark, [100.0, 101.0]).withColumn("yesterday", F.lit(9.0))
    assert [r["yesterday"] for r in corporate.back_adjust(quiet, columns=("close", "yesterday")).collect()] == [9.0, 9.0]


def test_price_index_keeps_every_day(spark):
    rows = [(1, datetime.date(2020, 1, k + 1), c, f) for k, (c, f) in enumerate([(100.0, 100.0), (160.0, 150.0), (80.0, 75.0), (40.0, None), (0.0, 38.0), (10.0, 9.0)])]
    out = corporate.price_index(spark.createDataFrame(rows, "company_id int, day date, close double, first double")).orderBy("day").collect()
    assert [round(r["day_return"], 6) for r in out] == [0.0, 0.6, round(80 / 75 - 1, 6), 0.0, -1.0, 0.0]
    assert out[1]["log_index"] == pytest.approx(math.log(1.6)) and out[5]["log_index"] == -math.inf


def test_resolve_reaches_each_stage(spark):
    from quantloom.operators.resolve import resolve

    md5 = "0123456789abcdef0123456789ABCDEF"
    known = [("1", "gamma delta"), ("2", "شركت ابزار سازی"), ("3", "فولاد"), ("4", "one two three four"), ("5", "alpha beta"), ("6", "alpha beta"), ("7", None)]
    names = [(1, "s1", "x"), (2, "s2", "y"), (3, "z", "شرکت ابزار‌ سازی "), (4, "فولاد", "q"), (5, "stored", "w"), (6, "n", "xgamma deltay"),
             (7, "n", "two three four one five"), (8, "n", "one two nine ten"), (9, None, None), (10, "n", "alpha beta"), (11, "n", "gamma"), (12, "s3", "alpha beta"),
             (13, "n", "gamma-delta (شرکت)")]
    got = resolve(spark.createDataFrame(names, "name_id int, symbol string, name string"), spark.createDataFrame(known, "company_id string, company_name string"),
                  spark.createDataFrame([("s1", md5), ("s2", "شرکت ابزار سازی"), ("s3", "nobody")], "symbol string, value string"),
                  spark.createDataFrame([("stored", "5"), (None, "1"), ("n", None)], "symbol string, company_id string"))
    assert {r["name_id"]: (r["company_id"], r["how"]) for r in got.collect()} == {
        1: (md5, "override(id)"), 2: ("2", "override(name)"), 3: ("2", "exact-name"), 4: ("3", "symbol-equals-name"), 5: ("5", "stored-symbol"), 6: ("1", "containment"),
        7: ("4", "fuzzy"), 10: ("5", "exact-name"), 12: ("5", "exact-name"), 13: ("1", "containment")}


def test_similar_and_contained_pairs_are_those_of_brute_force(spark):
    from quantloom.operators.resolve import contained_pairs, similar_pairs

    rnd = random.Random(1)
    sets = lambda n: [(k, [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 7))]) for k in range(n)]
    left, right = sets(60), sets(80)
    for least in (0.4, 0.75, 1.0):
        want = {(a, b) for a, x in left for b, y in right if x and y and len(set(x) & set(y)) >= least * len(set(x) | set(y))}
        got = similar_pairs(spark.createDataFrame(left, "a int, words array<string>"), spark.createDataFrame(right, "b int, words array<string>"), least).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    texts = lambda n, m: [(k, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, m)))) for k in range(n)]
    inner, outer = texts(60, 7), texts(60, 12)
    for n, small in ((5, 5), (3, 1)):
        want = {(a, b) for a, x in inner for b, y in outer if len(x) >= small and x in y}
        got = contained_pairs(spark.createDataFrame(inner, "a int, text string"), spark.createDataFrame(outer, "b int, text string"), n, small).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_symbol_search(spark):
    from quantloom.operators.resolve import search

    listed = spark.createDataFrame([(1, "ABC", "first metal works"), (2, "K", "second metal works"), (3, "XYZW", "third big company"), (4, None, "ABC")], "item_id int, symbol string, name string")
    asked = [(1, "ABC"), (2, "second metal works"), (3, "XYZ"), (4, "aKa"), (5, "metal"), (6, "met"), (7, "third big one"), (8, "nothing"), (9, None), (10, "works metal x")]
    got = search(spark.createDataFrame(asked, "query_id int, text string"), listed)
    assert {r["query_id"]: (r["item_id"], r["how"]) for r in got.collect()} == {
        1: (1, "exact"), 2: (2, "exact"), 3: (3, "substring"), 4: (2, "substring"), 5: (1, "substring"), 7: (3, "fuzzy"), 10: (1, "fuzzy")}


def test_jaccard_threshold(spark):
    sets = lambda s: F.array(*map(F.lit, s))
    assert one(spark, text.jaccard(sets("abc"), sets("abcd"))) == 0.75 and one(spark, text.jaccard(sets("abc"), F.array().cast("array<string>"))) == 0.0


def test_html_cells(spark):
    page = """<table class="a b"><thead><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><th>c</th><th>d</th></tr></thead>
    <tr><td>1</td><td hidden>no</td><td style="display : none">no</td><td aria-hidden="TRUE">no</td><td style="visibility: hidden">no</td>
    <td style="opacity:0">no</td><td colspan="2">2</td><td title="t">3 <b>4</b><span style="display:none">[5.00]</span></td></tr></table>"""
    wide = f"<table><thead><tr><th colspan={10**9} rowspan={10**9}>w</th></tr></thead></table>"
    nested = "<table><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table>"
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "<table><td>x", "x"), (4, wide, "x"), (5, nested, "x"), (6, "no table", "x")], "id int, html string, cell string")
    rows = html.cells(pages).collect()
    of = lambda k, part: {(r["table_no"], r["row_no"], r["col_no"]): r["cell"] for r in rows if r["id"] == k and r["part"] == part}
    assert of(1, "head") == {(0, 0, 0): "a", (0, 0, 1): "b", (0, 0, 2): "b", (0, 1, 0): "a", (0, 1, 1): "c", (0, 1, 2): "d"}
    assert of(1, "body") == {(0, 0, 0): "1", (0, 0, 1): "2", (0, 0, 2): "2", (0, 0, 3): "3 4 [5.00]"}
    assert [(r["exact"], r["title"], r["class"]) for r in rows if r["id"] == 1 and r["part"] == "body" and r["col_no"] == 3] == [("5.00", "t", "a b")]
    assert of(3, "body") == {(0, 0, 0): "x"} and len(of(4, "head")) == html.MOST_COLUMNS and of(5, "body") == {(0, 0, 0): "out in", (1, 0, 0): "in"}
    assert {r["id"] for r in rows} == {1, 3, 4, 5} and html.cells(pages.limit(0)).count() == 0


def test_statement_lines(spark):
    """Exact titles come before partial ones, excluded parts and rows without digits are passed over, headers merge."""
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    table = ('<table class="rayanDynamicStatement"><thead><tr><th>شرح</th><th>حسابرسی شده</th><th>حسابرسی نشده</th><th>درصد تغییر</th></tr></thead><tbody>'
             + row("جمع کل دارایی", "(۱٬۰۰۰)", "x2x", "9") + row("جمع دارایی ها", "—", "") + row("جمع دارایی ها", "7", "junk") + row("", "1", "2") + "</tbody></table>")
    cells = html.cells(spark.createDataFrame([(1, table)], "id int, html string"))
    assert sorted((r["col_no"], r["period"]) for r in statements.period_columns(statements.column_headers(cells, ["id"]), ["id"]).collect()) == [(1, 1), (2, 2)]
    lines = {"total": statements.BALANCE["total_assets"], "partly": statements.Line((), ("جمع", "دارایی")), "none": statements.Line(("x",), ("جمع",), ("دارایی",))}
    found = statements.find_lines(cells, ["id"], lines).first()
    assert (found["total"]["v1"], found["total"]["v2"], found["total"]["v3"]) == (7.0, 0.0, None)
    assert (found["partly"]["v1"], found["partly"]["v2"]) == (-1000.0, 2.0) and found["none"] is None
    assert statements.income_statement(cells, ["id"]).count() == 0 and statements.monthly_report(cells, ["id"]).count() == 0


@pytest.mark.parametrize(("given", "want"), [("(۱٬۲۳۴)", -1234.0), ("-", 0.0), ("x1", 1.0), ("", 0.0), (None, 0.0), ("1,234.5 ریال", 1234.5), ("−7", -7.0), ("1-2", 0.0)])
def test_to_amount(spark, given, want):
    assert one(spark, numeric.to_amount(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("1431237513660.00", 1431237513660), ("(7)", -7), ("-3 B", -3), ("a5b6", 5), ("۱۲٬۰۰۰", 12000), ("-", None), (None, None), ("9" * 30, None)])
def test_to_whole(spark, given, want):
    assert one(spark, numeric.to_whole(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("1403/01/01", "2024-03-20"), ("1403/12/30", "2025-03-20"), ("1402/12/30", None), ("1403/07/31", None), ("1403/13/01", None),
                                             ("2024-02-30", None), ("2024-02-29 10:00", "2024-02-29"), ("1200/01/01", None), ("14030", None), (None, None)])
def test_dates_in_either_calendar(spark, given, want):
    got = one(spark, calendar.either_calendar(calendar.eight_digits(F.lit(given).cast("string"))))
    assert (None if got is None else str(got)) == want


def test_jalali_months(spark):
    ago = lambda y, m, d, n: one(spark, calendar.jalali_months_ago(F.lit(y), F.lit(m), F.lit(d), n))
    assert [ago(1403, 1, 31, 1), ago(1403, 7, 30, 1), ago(1403, 8, 15, 20), ago(1403, 4, 31, 7)] == ["1402/12/29", "1403/06/30", "1401/12/15", "1402/09/30"]
    year, month = (one(spark, x) for x in calendar.add_jalali_months(F.lit(1403), F.lit(11), 14))
    assert (year, month) == (1405, 1)
    day = lambda x: one(spark, calendar.epoch_date(F.lit(x), 2030))
    assert str(day("1700000000")) == "2023-11-14" and str(day("1700000000123")) == "2023-11-14" and day("1500") is None and day("1000000001") is None and day("x") is None


def test_ingest_files(spark, tmp_path):
    (tmp_path / "o.json").write_text('{" شركت ": "x", "b": null}')
    assert [tuple(r) for r in files.read_overrides(spark, f"file://{tmp_path}/o.json").collect()][0] == ("شرکت", "x")
    (tmp_path / "l.json").write_text("[1, 2]")
    assert files.read_overrides(spark, f"file://{tmp_path}/l.json").count() == 0
    with pytest.raises(Exception, match="JSON object"):
        files.read_documents(spark, f"file://{tmp_path}/l.json", "a int").collect()
    (tmp_path / "t.txt").write_text("1;A;n\n2; ;n\n3;B\n\n")
    assert [tuple(r) for r in files.read_fields(spark, f"file://{tmp_path}/t.txt", ["i", "t", "n"]).collect()] == [("1", "A", "n")]


@pytest.mark.parametrize(("x", "digits", "want"), [(-2.5, 0, -3.0), (2.5, 0, 3.0), (-0.125, 2, -0.13), (1.005, 2, 1.0), (0.0, 2, 0.0)])
def test_round_away_from_zero(spark, x, digits, want):
    assert one(spark, numeric.round_away(F.lit(x), digits)) == want


@pytest.mark.parametrize(("op", "revenue", "eps", "net", "want"), [
    (5.0, 1e6, 10.0, 2000.0, 1000.0), (5000.0, 1e6, 10.0, 2000.0, 5000.0), (5.0, None, 10.0, 2000.0, 1000.0), (0.4, None, 10.0, 2000.0, 0.4),
    (150.0, None, 10.0, 2000.0, 150.0), (5.0, 0.0, 10.0, 2000.0, 1000.0), (5.0, 1e6, -1.0, 2000.0, 5.0), (None, 1.0, 1.0, 1.0, None)])
def test_operating_amount(spark, op, revenue, eps, net, want):
    cols = [F.lit(x).cast("double") for x in (op, revenue, eps, net)]
    assert one(spark, numeric.operating_amount(*cols)) == want


def test_updates_write_nulls_and_hashes_do_not_collide(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    new = spark.createDataFrame([(1, None)], "k int, x string")
    assert sorted(map(tuple, state.update_by_key(old, new, ["k"], ["x"]).collect())) == [(1, None, "b"), (2, "c", "d")]
    rows = spark.createDataFrame([("x|=y", "z"), ("x", "y|=z"), (None, "z"), ("", "z")], "a string, b string")
    assert rows.select(state.content_hash("a", "b").alias("h")).distinct().count() == 4


def test_running_sums_by_ranges(spark):
    rows = spark.createDataFrame([(k % 3, k % 17, k) for k in range(400)], "g int, o int, v long")
    got = ranking.with_running(rows, ["g"], [F.col("o").asc(), F.col("v").asc()], F.col("v"), "before", "whole").collect()
    for r in got:
        group = sorted((x % 17, x) for x in range(400) if x % 3 == r["g"])
        assert r["before"] == sum(v for o, v in group if (o, v) < (r["o"], r["v"])) and r["whole"] == sum(v for _, v in group)
    assert len(got) == 400 and ranking.with_running(rows.limit(0), ["g"], [F.col("o").asc()], F.col("v")).count() == 0


def test_identifiers_units_and_links(spark):
    say = lambda f, *xs: [one(spark, f(F.lit(x).cast("string"))) for x in xs]
    assert say(text.is_identifier, "a_1", "1a", "a-b", None) == [True, False, False, False]
    assert say(text.is_md5, "0" * 32, "F" * 32, "g" * 32, None) == [True, True, False, False]
    assert say(text.currency_unit, "مبالغ به میلیون ريال", "هزار ریال", "ریال", "دلار", None) == ["million_rial", "thousand_rial", "rial", "unknown", "unknown"]
    join = lambda b, x: one(spark, text.url_join(F.lit(b), F.lit(x)))
    base = "https://a.example/b/c.html?q=1"
    assert [join(base, x) for x in ("d", "/e", "//f/g", "http://h/", "?i=2")] == [
        "https://a.example/b/d", "https://a.example/e", "https://f/g", "http://h/", "https://a.example/b/c.html?i=2"]
    page = lambda u, k: one(spark, text.with_page(F.lit(u), F.lit(k)))
    assert page("http://x/y?a=1&PageNumber=3&b=2", 7) == "http://x/y?a=1&PageNumber=7&b=2" and page("http://x/y", 2) == "http://x/y?PageNumber=2"
    assert one(spark, text.percent_text(F.lit(2.5))) == "+2.5%" and one(spark, text.percent_text(F.lit(None).cast("double"))) == "–"
    with pytest.raises(Exception, match="empty"):
        one(spark, text.normalize_company_name(F.lit(" \u200c ")))


def test_csv_and_compact(spark):
    assert one(spark, text.csv_text(F.lit('a "b"\nc'))) == "a 'b' c" and one(spark, text.compact_number(F.lit(2.5e6))) == "2.5M"
    assert one(spark, text.url_parameter(F.lit("http://x/y?a=1&i=77"), "i")) == "77"


def test_back_adjust_long_series_of_events(spark):
    """An event every day: a row's list of later events is not kept with each row, and the result is that of plain folding."""
    from quantloom.operators.corporate import back_adjust

    closes = [float(100 + (k * 7919) % 400) if k % 17 else None for k in range(300)]
    rows = spark.createDataFrame([(1, k, c, -5.0 if k == 3 else c) for k, c in enumerate(closes)], "company_id long, k int, close double, low double")
    rows = rows.selectExpr("company_id", "date_add(DATE'2000-01-01', k) AS day", "close", "low", "CAST(NULL AS double) AS yesterday")
    out = back_adjust(rows, columns=("close", "low", "yesterday"))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    factors = {k: b / a for k, (a, b) in enumerate(zip(closes, closes[1:]), 1) if a and b and abs(b / a - 1) * 100 > 12.36}

    def fold(x, k):
        for e in sorted(factors):
            if x is not None and e > k and x > 0:
                x = float(round(x * factors[e]))
        return x

    want = [fold(c, k) for k, c in enumerate(closes)]
    got = out.orderBy("day").collect()
    assert [r["close"] for r in got] == want and got[3]["low"] == -5.0
    assert [r["yesterday"] for r in got] == [None if c is None or k == 0 or not want[k - 1] else want[k - 1] for k, c in enumerate(want)]


def test_places_of_values_that_fill_several_ranges(spark):
    """Equal values that fill whole ranges, and groups that begin within one, get the places that plain counting gives; rows are not
    joined with the rows of their group."""
    from pyspark.sql import functions as F

    from quantloom.operators.ranking import with_places

    value = lambda k: -0.0 if k % 10 < 8 else float(k % 7) - 3.0
    rows = [(k, k % 3 if k < 30000 else 3, value(k)) for k in range(30050)]
    df = spark.createDataFrame(rows, "key long, g long, value double").repartition(4)
    got = {r["key"]: (r["g"], r["below"], r["same"], r["n"]) for r in with_places(df, "g", "value", "key").collect()}
    want = {r["key"]: (r["g"], r["below"], r["same"], r["n"]) for r in spark.createDataFrame(rows, "key long, g long, value double").withColumn("value", F.col("value") + 0.0).selectExpr(
        "key", "g", "rank() OVER (PARTITION BY g ORDER BY value) - 1 AS below", "count(*) OVER (PARTITION BY g, value) AS same", "count(*) OVER (PARTITION BY g) AS n").collect()}
    assert got == want and len(got) == len(rows)


def test_cross_sections_deal_by_company_alone(spark):
    """What is known at a month end comes without cutting rows by ranges of company and time and writing them."""
    from quantloom.plans.crosssection import cross_sections
    from quantloom.sources.domain import Tables
    from tests.conftest import SMALL

    plan = cross_sections(Tables(spark, SMALL))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "as-of" not in plan


def test_cells_of_many_pages_are_one_batch(spark, monkeypatch):
    """A batch of pages gives a batch of cells, not one a page; pages without cells in between and at the end give none."""
    import pyarrow as pa

    pages, held = spark.createDataFrame([], "page_id long, html string"), []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, task, schema: held.append(task))
    html.cells(pages)
    page = "<table><tr><td>a</td><td>b</td></tr></table>"
    out = list(held[0]([pa.RecordBatch.from_pydict({"page_id": [1, 2, 3, 4, 5], "html": [page, None, "<p>x", page, ""]})]))
    assert len(out) == 1 and out[0].column("page_id").to_pylist() == [1, 1, 4, 4] and out[0].column("cell").to_pylist() == ["a", "b"] * 2
    many = pa.RecordBatch.from_pydict({"page_id": list(range(15_000)), "html": [page] * 15_000})
    assert [b.num_rows for b in held[0]([many])] == [html.CELLS_AT_ONCE] * 3
