"""Report pages: tables as rows, statements as figures. The pages' own HTML with a report behind it, as each table has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import round_half
from quantloom.operators import html, statements
from quantloom.plans.registry import query
from quantloom.sources.domain import Tables


def filled(template: str, **values: Column) -> Column:
    """A text with values in place of {names}."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def persian(x: Column) -> Column:
    return F.translate(x.cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹")


def _pages(t: Tables, report: Column) -> DataFrame:
    return t("pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("--></script></style>"), report).alias("html"))


@query("html_table_extract", """
SELECT page_id, r AS row_no, c AS col_no, CASE WHEN p = 'head' AND c = 0 THEN 'name' WHEN p = 'head' THEN CASE r WHEN 0 THEN 'period' ELSE 'p' || c END
  WHEN c = 0 THEN 'total ' || length(html) ELSE (page_id * c)::VARCHAR END AS cell, p AS part
FROM pages, (VALUES ('head', 0, 0), ('head', 0, 1), ('head', 0, 2), ('head', 1, 0), ('head', 1, 1), ('head', 1, 2), ('body', 0, 0), ('body', 0, 1), ('body', 0, 2)) v(p, r, c)""")
def html_table_extract(t: Tables) -> DataFrame:
    """Tables with headers that span rows and columns, and hidden cells, as rows."""
    table = """<table><thead><tr><th rowspan=2>name</th><th colspan=2>period</th><th hidden>h</th></tr><tr><th>p1</th><th>p2</th></tr></thead>
        <tbody><tr><td>total {n}</td><td style='display : none'>x</td><td style="visibility:hidden">x</td><td aria-hidden=TRUE>x</td><td>{a}</td><td>{b}</table>"""
    report = filled(table, n=F.length("html"), a=F.col("page_id"), b=F.col("page_id") * 2)
    return html.cells(_pages(t, report)).select("page_id", "part", "row_no", "col_no", "cell")


INCOME_PAGE = """<table class="small"><tr><td>سرمایه</td></tr></table><table class="rayanDynamicStatement grid"><thead><tr><th rowspan="2">شرح</th><th hidden>x</th>
<th colspan="{wide}">دوره منتهی به</th><th rowspan="2">درصد تغییر</th></tr><tr><th>1402/06/31</th><th>1401/06/31</th>{third}</tr></thead><tbody>
<tr><td>درآمدهاي عملياتي</td><td aria-hidden="true">9</td><td>{rev}</td><td>{revly}</td>{rev3}<td>5</td></tr>
<tr><td>سود (زیان) ناخالص</td><td>1</td><td>2</td></tr>
<tr><td>سود (زیان) عملیاتی هر سهم</td><td>1</td><td>2</td></tr>
<tr><td>سود (زیان) عملیاتی</td><td>({op})</td><td>{oply}</td>{op3}</tr>
<tr><td>هزینه‌های مالی</td><td>-</td><td>({fin})</td></tr>
<tr><td>سایر درآمدها و هزینه های غیرعملیاتی</td><td>{oth}</td><td>1</td></tr>{bio}
<tr><td>سود (زیان) خالص</td><td>{net}</td><td>{netly}</td>{net3}</tr>
<tr><td>سود (زیان) خالص هر سهم</td><td></td><td>-</td></tr>
<tr><td>سود (زیان) خالص هر سهم - ریال</td><td>{eps}</td><td>{epsly}</td>{eps3}</tr>
<tr><td>عملیاتی (ریال)</td><td>{oe}</td><td>7</td></tr>{cap}</tbody></table>"""


def income_pages(t: Tables) -> DataFrame:
    """A page's income statement, its figures made of the page's number: three periods, or two; some sell animals; some say
    nothing about their capital."""
    k = F.col("page_id")
    three = k % 3 != 2
    third = lambda x: F.when(three, F.concat(F.lit("<td>"), x.cast("string"), F.lit("</td>"))).otherwise("")
    report = filled(
        INCOME_PAGE, wide=F.when(three, 3).otherwise(2), third=F.when(three, "<th>1401/12/29</th>").otherwise(""), rev=persian(F.format_number(k * 1000, 0)),
        revly=F.format_number(k * 900, 0), rev3=third(k * 2000), op=k + 1, oply=k + 2, op3=third(k + 3), fin=k + 4, oth=k + 5, net=k + 6, netly=F.concat(F.lit("("), k, F.lit(")")),
        net3=third(k + 7), eps=k + 8, epsly=k + 9, eps3=third(k + 10), oe=k + 11, bio=F.when(k % 4 == 0, F.concat(
            F.lit("<tr><td>سود (زیان) فروش دارایی زیستی مولد</td><td>"), k * 10, F.lit("</td><td>3</td></tr>"))).otherwise(""),
        cap=F.when(k % 5 == 0, "").otherwise("<tr><td>افزایش سرمایه</td><td>1</td><td>1</td></tr><tr><td>سرمایه</td><td>100</td><td>200</td><td>300</td></tr>"))
    return _pages(t, report)


@query("income_statement", """
WITH p AS (SELECT page_id AS k, page_id % 3 <> 2 AS three FROM pages WHERE page_id % 5 <> 0)
SELECT k AS page_id, CASE WHEN three THEN 3 ELSE 2 END::BIGINT AS n_periods, '1402/06/31' AS report_date,
       (k + 8)::DOUBLE AS num1_value1, 100e0 AS num2_value1, (k + 11)::DOUBLE AS num4_value1, (k + 8) * 100e0 AS product1,
       (k + 9)::DOUBLE AS num1_value2, 200e0 AS num2_value2, 7e0 AS num4_value2, (k + 9) * 200e0 AS product2,
       CASE WHEN three THEN (k + 10)::DOUBLE END AS num1_value3, CASE WHEN three THEN 300e0 END AS num2_value3, CASE WHEN three THEN 0e0 END AS num4_value3,
       CASE WHEN three THEN (k + 10) * 300e0 END AS product3,
       -(k + 1)::DOUBLE AS operating_profit_new, (k + 2)::DOUBLE AS operating_profit_last_year, CASE WHEN three THEN (k + 3)::DOUBLE END AS operating_profit_fyprev,
       0e0 AS finance_costs_new, -(k + 4)::DOUBLE AS finance_costs_last_year,
       (k + 5 + CASE WHEN k % 4 = 0 THEN k * 10 ELSE 0 END)::DOUBLE AS other_non_op_new, (1 + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END)::DOUBLE AS other_non_op_last_year,
       k * 1000e0 AS revenue_new, k * 900e0 AS revenue_last_year, CASE WHEN three THEN k * 2000e0 END AS revenue_fyprev,
       (k + 6)::DOUBLE AS net_profit_amount, -k::DOUBLE AS net_profit_amount_ly, CASE WHEN three THEN (k + 7)::DOUBLE END AS net_profit_amount_fyprev
FROM p""")
def income_statement(t: Tables) -> DataFrame:
    rows = statements.income_statement(html.parsed(income_pages(t)), ["page_id"])
    return rows.withColumn("n_periods", F.col("n_periods").cast("long"))


@query("income_facts", """
SELECT page_id, metric, period::BIGINT AS period, value FROM (
  SELECT page_id, 'revenue' AS metric, unnest([1, 2]) AS period, unnest([page_id * 1000e0, page_id * 900e0]) AS value FROM pages
  UNION ALL SELECT page_id, 'net_profit', unnest([1, 2]), unnest([(page_id + 6)::DOUBLE, -page_id::DOUBLE]) FROM pages)""")
def income_facts(t: Tables) -> DataFrame:
    """The same pages as facts: a row for each of two metrics and the first two periods, also of pages that lack required lines."""
    lines = {name: statements.INCOME[name] for name in ("revenue", "net_profit")}
    cells = html.parsed(income_pages(t))
    own = cells.join(statements.best_tables(cells, ["page_id"], statements.INCOME_MARKS), ["page_id", "table_no"])
    found = statements.find_lines(own, ["page_id"], lines)
    wide = found.select("page_id", *(F.col(f"{n}.v{p}").alias(f"{n}:{p}") for n in lines for p in (1, 2)))
    facts = wide.unpivot("page_id", [c for c in wide.columns if c != "page_id"], "name", "value")
    part = lambda k: F.split_part("name", F.lit(":"), F.lit(k))
    return facts.select("page_id", part(1).alias("metric"), part(2).cast("long").alias("period"), "value")


BALANCE_PAGE = """<table class="rayanDynamicStatement"><thead><tr><th>شرح</th><th>1402/06/31</th><th>1401/12/29</th></tr></thead><tbody>
<tr><td>جمع دارایی‌های غیرجاری</td><td>1</td><td>1</td></tr><tr><td>جمع دارایی‌های جاری</td><td>{ca}</td><td>2</td></tr><tr><td>جمع دارایی‌ها</td><td>{ta}</td><td>3</td></tr>{rest}
</tbody></table><table class="rayanDynamicStatement"><thead><tr><th>شرح</th><th>دوره منتهی به 1402/06/31</th><th>دوره منتهی به 1401/06/31</th></tr></thead><tbody>
<tr><td>خالص جریان ارزی عملیاتی</td><td>5</td><td>5</td></tr><tr><td>خالص جریان‌های نقدی ناشی از فعالیت‌های عملیاتی</td><td>({cf})</td><td>4</td></tr></tbody></table>"""


@query("balance_and_cash", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id * 3e0 END AS total_assets, CASE WHEN page_id % 2 = 0 THEN page_id * 2e0 END AS current_assets,
       CASE WHEN page_id % 2 = 0 THEN 9e0 END AS total_equity_ly, CASE WHEN page_id % 2 = 0 THEN 6e0 END AS current_liabilities_ly,
       CASE WHEN page_id % 2 = 0 THEN 8e0 END AS total_liabilities, -page_id::DOUBLE AS operating_cash_flow, 4e0 AS operating_cash_flow_ly FROM pages""")
def balance_and_cash(t: Tables) -> DataFrame:
    """Balance sheet and cash flow of each page; every second balance sheet has too few lines."""
    k = F.col("page_id")
    rest = "".join(f"<tr><td>{title}</td><td>{a}</td><td>{b}</td></tr>" for title, a, b in (
        ("جمع بدهی‌های جاری", 5, 6), ("جمع بدهی‌ها", 8, 7), ("جمع حقوق مالکانه", 1, 9)))
    fair = F.replace(F.lit(BALANCE_PAGE), F.lit("{rest}"), F.when(k % 2 == 0, rest).otherwise(""))
    poor = F.replace(F.replace(fair, F.lit("جمع دارایی‌ها<"), F.lit("جمع<")), F.lit("جمع دارایی‌های جاری"), F.lit("جمع"))
    report = F.when(k % 2 == 0, fair).otherwise(poor)
    for name, value in (("ca", k * 2), ("ta", k * 3), ("cf", k)):
        report = F.replace(report, F.lit("{" + name + "}"), value.cast("string"))
    cells = html.parsed(_pages(t, report))
    both = statements.balance_sheet(cells, ["page_id"]).join(statements.cash_flow(cells, ["page_id"]), "page_id", "full_outer")
    return both.select("page_id", "total_assets", "current_assets", "total_equity_ly", "current_liabilities_ly", "total_liabilities", "operating_cash_flow", "operating_cash_flow_ly")


def _monthly_page(columns: str, rows: str) -> str:
    return f"""<span id="ctl00_lblPeriodEndToDate"> ۱۴۰۲/۰۶/۳۱ </span><table class="rayanDynamicStatement"><thead><tr><th rowspan=2>شرح</th>{columns}</tr></thead>
        <tbody>{rows}</tbody></table>"""


_MEASURES = "<th>تعداد تولید</th><th>تعداد فروش</th><th>نرخ</th><th>مبلغ فروش</th>"
_CELLS = "".join(f"<td>{{c{i}}}</td>" for i in range(1, 15))
PRODUCT_PAGE = _monthly_page(
    '<th colspan="4">از ابتدای سال</th><th colspan="4">دوره یک ماهه منتهی به 1402/06/31</th><th hidden>x</th><th colspan="6">دوره 6 ماهه</th></tr><tr>' + _MEASURES + _MEASURES,
    f'<tr><td>جمع فروش داخلی</td>{_CELLS}</tr><tr><td>جمع فروش صادراتی</td>{_CELLS.replace("c14", "x14")}</tr><tr><td>جمع</td>{_CELLS}</tr><tr><td>یادداشت</td><td>1</td></tr>')
SERVICE_PAGE = _monthly_page(
    "<th colspan=2>دوره یک ماهه منتهی به 1402/06/31</th><th>توضیح</th></tr><tr><th>درآمد از ابتدا</th><th>درآمد شناسایی شده طی دوره</th>",
    "<tr><td>خدمات</td><td>5</td><td>6</td></tr><tr><td>جمع کل درآمدهای عملیاتی</td><td>7</td><td>{s}</td></tr>")
TOTALLESS_PAGE = _monthly_page("<th colspan=1>دوره یک ماهه</th></tr><tr><th>درآمد</th>", "<tr><td>خدمات</td><td>5</td></tr>")


@query("monthly_report", """
SELECT page_id, '1402/06/31' AS report_date, CASE WHEN page_id % 3 = 0 THEN page_id * 10e0 + 5 ELSE 0e0 END AS production, CASE WHEN page_id % 3 = 0 THEN page_id * 10e0 + 6 ELSE 0e0 END AS sales_quantity,
       CASE WHEN page_id % 3 = 0 THEN page_id * 10e0 + 8 ELSE page_id + 1e0 END AS sales_amount, CASE WHEN page_id % 3 = 0 THEN page_id * 20e0 + 15 ELSE page_id + 1e0 END AS total
FROM pages WHERE page_id % 3 <> 2""")
def monthly_report(t: Tables) -> DataFrame:
    """Product reports, service reports, and reports without a total, which give nothing."""
    k = F.col("page_id")
    product = F.lit(PRODUCT_PAGE)
    for i in range(1, 15):
        product = F.replace(product, F.lit(f"{{c{i}}}"), (k * 10 + i).cast("string"))
    product = F.replace(product, F.lit("{x14}"), persian(F.format_number(k * 10 + 1, 0)))
    pages = _pages(t, F.when(k % 3 == 0, product).when(k % 3 == 1, filled(SERVICE_PAGE, s=k + 1)).otherwise(TOTALLESS_PAGE))
    dates = pages.select("page_id", statements.normalize_text(html.element_text(F.col("html"), "ctl00_lblPeriodEndToDate")).alias("report_date"))
    figures = statements.monthly_report(html.parsed(pages), ["page_id"])
    return figures.join(dates, "page_id").select("page_id", "report_date", "production", "sales_quantity", "sales_amount", "total")


HISTORY_PAGE = """<div id="trade"><table class="obj"><tbody>{rows}<tr class="odd_modern"><td>2020-01-01</td><td>short</td></tr></tbody></table></div>"""


@query("history_grid", """
SELECT page_id, DATE '2020-01-01' + r::INT AS gregorian_date, '1398/10/' || (11 + r) AS jalali_date, page_id * 100 + r AS high_price, -15e-1 AS closing_change_percent,
       1234567890123 + page_id AS trade_value, page_id AS volume, -7::BIGINT AS last_change FROM pages, range(3) v(r)""")
def history_grid(t: Tables) -> DataFrame:
    """Price histories of 16 columns, three days a page, with exact values in hidden spans and in titles."""
    k = F.col("page_id")
    plain = lambda n: "".join(f"<td>{i}</td>" for i in range(n))
    rows = "".join(
        f"<tr class='ev_modern'><td>2020/01/0{1 + r}</td><td></td><td>{{h{r}}}</td><td>1</td><td>-1.5 %</td><td>3</td><td>4</td><td>0.5</td><td>(7)</td>{plain(3)}"
        f"<td><span style='display:none'>[{{v}}.00]</span><div>1.2B</div></td><td title='{{k}}'>5 K</td><td>9</td><td>۱۳۹۸/۱۰/{11 + r}</td></tr>" for r in range(3))
    report = filled(HISTORY_PAGE.replace("{rows}", rows), h0=k * 100, h1=k * 100 + 1, h2=k * 100 + 2, v=F.lit(1234567890123) + k, k=k)
    found = statements.price_history(html.parsed(_pages(t, report)), ["page_id"])
    return found.select("page_id", "gregorian_date", "jalali_date", "high_price", round_half(F.col("closing_change_percent"), 4).alias("closing_change_percent"),
                        "trade_value", "volume", "last_change")
