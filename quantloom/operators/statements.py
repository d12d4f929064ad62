"""Financial statements on report pages: from the cells of their tables to figures by period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.numeric import to_amount, to_whole
from quantloom.functions.text import normalize_label, normalize_text

DATE = "(?:13|14)\\d{2}/\\d{1,2}/\\d{1,2}"
#: What the pages say, fixed values: the class of statement tables, headers, and marks of an income statement.
STATEMENT = "rayanDynamicStatement"
DESCRIPTION, CHANGE, PERIOD = "شرح", "درصد تغییر", "دوره منتهی"
INCOME_MARKS = ("درآمدهای عملیاتی", "سود زیان ناخالص", "سود زیان عملیاتی", "سود زیان خالص", "سرمایه")
TOTALS = ("جمع", "جمع کل", "مجموع")
TOTAL_REVENUE = "^جمع(?: کل)? درآمدهای? عملیاتی$"
ONE_MONTH = "دوره\\s*(?:یک|1)\\s*ماهه"
PRODUCED, SOLD, AMOUNT, REVENUE, OLD_REVENUE, DURING = "تعداد تولید", "تعداد فروش", "مبلغ فروش", "درآمد", "درامد", "طی دوره"
DOMESTIC, EXPORTED, SALES_CELL = "جمع فروش داخلی", "جمع فروش صادراتی", 14


@dataclass(frozen=True)
class Line:
    """How a line of a statement is found by its title: exactly, or by all of some parts, never with others."""

    exact: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


#: The lines of an income statement, fixed values.
INCOME = {
    "net_eps": Line(("سود (زیان) خالص هر سهم - ریال", "سود (زیان) خالص هر سهم– ریال", "سود زیان خالص هر سهم ریال"), ("سود", "زیان", "خالص", "هر سهم", "ریال"), ("درصد",)),
    "base_eps": Line(("سود (زیان) پایه هر سهم",), ("سود", "زیان", "پایه", "هر سهم")),
    "capital": Line(("سرمایه",), ("سرمایه",), ("افزایش", "کاهش")),
    "operating_eps": Line(("عملیاتی (ریال)", "عملیاتی ریال"), ("عملیاتی", "ریال"), ("غیرعملیاتی", "سود", "زیان")),
    "operating_profit": Line(("سود (زیان) عملیاتی", "سود(زیان) عملیاتی"), ("سود", "زیان", "عملیاتی"),
                             ("هر سهم", "قبل از مالیات", "در حال تداوم", "متوقف شده", "غیرعملیاتی")),
    "revenue": Line(("درآمدهای عملیاتی",), ("درآمد", "عملیاتی"), ("بهای تمام شده", "تامین", "هر سهم", "سایر", "هزینه")),
    "finance_costs": Line(("هزینه مالی", "هزینه‌های مالی", "هزینه های مالی"), ("هزینه", "مالی"), ("مالیات", "فروش", "کاهش", "سایر")),
    "other_non_op": Line(("سایر درآمدها و هزینه‌های غیرعملیاتی", "سایر درآمدها و هزینه های غیرعملیاتی"), ("سایر", "غیرعملیاتی"), ("هر سهم", "ریال")),
    "biological_sale": Line(("سود (زیان) فروش دارایی زیستی مولد", "سود زیان فروش دارایی زیستی مولد", "سود (زیان) فروش دارایی‌های زیستی مولد"), ("فروش", "دارایی", "زیستی")),
    "net_profit": Line(("سود (زیان) خالص", "سود(زیان) خالص"), ("سود", "زیان", "خالص"), ("هر سهم", "عملیات", "در حال تداوم", "متوقف شده", "پایه", "جامع")),
}
#: The lines of a balance sheet and of a cash flow statement, fixed values.
BALANCE = {
    "total_assets": Line(("جمع دارایی ها",), ("جمع", "دارایی"), ("جاری", "غیرجاری", "درآمد", "هزینه", "بدهی")),
    "current_assets": Line((), ("جمع", "دارایی", "جاری"), ("بدهی", "غیرجاری")),
    "total_liabilities": Line(("جمع بدهی ها",), ("جمع", "بدهی"), ("جاری", "غیرجاری", "حقوق")),
    "current_liabilities": Line((), ("جمع", "بدهی", "جاری"), ("غیرجاری", "دارایی")),
    "total_equity": Line((), ("جمع", "حقوق مالکانه"), ("فرعی",)),
}
CASH = {"operating_cash_flow": Line(("خالص جریان های نقدی عملیاتی", "خالص جریانهای نقدی عملیاتی"), ("خالص", "جریان", "عملیاتی"),
                                    ("سرمایه گذاری", "تامین مالی", "تأمین مالی", "تمویل مالی", "ارزی", "ابتدای", "پایان"))}
#: The columns of a price history's table, fixed values.
HISTORY = ("high_price", "low_price", "closing_change_percent", "closing_change", "closing_price", "last_change_percent", "last_change", "last_price",
           "first_price", "yesterday_price", "trade_value", "volume", "trade_count")


def column_headers(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, table_no, col_no, parts, text: what stands above each column, each text once, from the top down."""
    head = cells.filter((F.col("part") == "head") & (F.col("cell") != ""))
    rows = F.array_sort(F.collect_list(F.struct("row_no", normalize_text(F.col("cell")).alias("cell"))))
    merged = head.groupBy(*keys, "table_no", "col_no").agg(F.array_distinct(F.transform(rows, lambda r: r["cell"])).alias("parts"))
    return merged.withColumn("text", normalize_label(F.array_join("parts", " ")))


def period_columns(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, table_no, col_no, period (from 1 on), parts: columns whose header has a date or says that a period ends; in tables
    without any, all but the description and the change in percent."""
    rows = headers.filter((F.col("col_no") > 0) & (F.col("text") != DESCRIPTION) & ~F.col("text").contains(CHANGE))
    dated = F.array_join("parts", " ").rlike(DATE) | F.col("text").contains(PERIOD)
    some = F.max(dated).over(Window.partitionBy(*keys, "table_no"))
    rows = rows.withColumns({"__dated": dated, "__some": some}).filter("__dated OR NOT __some")
    order = Window.partitionBy(*keys, "table_no").orderBy("col_no")
    return rows.withColumn("period", F.row_number().over(order)).select(*keys, "table_no", "col_no", "period", "parts")


def best_tables(cells: DataFrame, keys: Sequence[str], marks: Sequence[str], least: int = 2) -> DataFrame:
    """keys, table_no of each page's statement table that holds most of marks, the first of equals, if it holds least of them."""
    own = cells.filter(F.array_contains(F.split("class", "\\s+"), STATEMENT))
    order = F.struct((F.col("part") != "head").alias("p"), "row_no", "col_no", "cell")
    text = normalize_label(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["cell"]), " "))
    whole = own.groupBy(*keys, "table_no").agg(text.alias("text"))
    score = sum((F.col("text").contains(_label(m)).cast("int") for m in marks), F.lit(0))
    best = whole.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.col("table_no")).alias("t"))).alias("b")).filter(F.col("b.score") >= least)
    return best.select(*keys, (-F.col("b.t")).cast("int").alias("table_no"))


def _label(title: str) -> Column:
    return normalize_label(F.lit(title))


def find_lines(cells: DataFrame, keys: Sequence[str], lines: Mapping[str, Line]) -> DataFrame:
    """keys, table_no, n_periods, period_header, and a struct (title, v1, v2, v3) for each of lines.

    A line is the first row whose title is exactly one of its titles, else the first whose title has all parts; rows
    with an excluded part, or without a digit in the first three periods, are none. Missing cells and junk are 0, a
    missing third period is null, a line that isn't found is null. One shuffle a table: all lines are picked at once.
    """
    periods = period_columns(column_headers(cells, keys), keys)
    few = periods.filter("period <= 3")
    counts = few.groupBy(*keys, "table_no").agg(F.count(F.lit(1)).alias("n_periods"), F.array_join(F.min_by("parts", "period"), " ").alias("period_header"))
    body = cells.filter(F.col("part") == "body").withColumn("cell", normalize_text(F.col("cell")))
    valued = body.join(few.select(*keys, "table_no", "col_no", "period"), [*keys, "table_no", "col_no"], "left")
    value = lambda p: F.max(F.when(F.col("period") == p, F.col("cell"))).alias(f"v{p}")
    rows = valued.groupBy(*keys, "table_no", "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, normalize_label(F.col("cell")))).alias("title"), *map(value, (1, 2, 3)),
        F.max(F.col("period").isNotNull() & F.col("cell").rlike("[0-9]")).alias("numeric"))
    rows = rows.filter("title <> '' AND numeric").join(counts, [*keys, "table_no"])
    amounts = [F.when(F.col("n_periods") >= p, to_amount(F.col(f"v{p}"))).alias(f"v{p}") for p in (1, 2, 3)]

    def pick(line: Line) -> Column:
        title = F.col("title")
        exact = title.isin(*map(_label, line.exact)) if line.exact else F.lit(False)
        partly = F.lit(bool(line.parts))
        for part in line.parts:
            partly = partly & title.contains(_label(part))
        for part in line.without:
            exact, partly = exact & ~title.contains(_label(part)), partly & ~title.contains(_label(part))
        return F.min(F.when(exact | partly, F.struct((~exact).alias("late"), "row_no", "title", *amounts)))

    found = rows.groupBy(*keys, "table_no").agg(F.max("n_periods").alias("n_periods"), F.max("period_header").alias("period_header"),
                                                *(pick(line).alias(name) for name, line in lines.items()))
    return found.select(*keys, "table_no", "n_periods", "period_header", *(
        F.when(F.col(name).isNotNull(), F.struct(*(F.col(f"{name}.{c}").alias(c) for c in ("title", "v1", "v2", "v3")))).alias(name) for name in lines))


def income_statement(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The figures of each page's income statement: EPS, capital, operating EPS and their product by period (num1_, num2_, num4_,
    product_), and the amounts of the period, of last year's, and of the last full year. Pages without the four required
    lines, or with fewer than two periods, give no row; biological sales are added to other income."""
    own = cells.join(best_tables(cells, keys, INCOME_MARKS), [*keys, "table_no"])
    found = find_lines(own, keys, INCOME).withColumn("net_eps", F.coalesce("net_eps", "base_eps"))
    found = found.filter("n_periods >= 2 AND net_eps IS NOT NULL AND capital IS NOT NULL AND operating_eps IS NOT NULL AND operating_profit IS NOT NULL")
    c = F.col
    out = {}
    for p in (1, 2, 3):
        out |= {f"num1_value{p}": c(f"net_eps.v{p}"), f"num2_value{p}": c(f"capital.v{p}"), f"num4_value{p}": c(f"operating_eps.v{p}"),
                f"product{p}": c(f"net_eps.v{p}") * c(f"capital.v{p}")}
    ends = (("new", 1), ("last_year", 2))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out |= {f"operating_profit_{e}": c(f"operating_profit.v{p}") for e, p in ends} | {"operating_profit_fyprev": c("operating_profit.v3")}
    out |= {f"finance_costs_{e}": zero(c(f"finance_costs.v{p}")) for e, p in ends}
    out |= {f"other_non_op_{e}": zero(c(f"other_non_op.v{p}")) + zero(c(f"biological_sale.v{p}")) for e, p in ends}
    out |= {f"revenue_{e}": c(f"revenue.v{p}") for e, p in (*ends, ("fyprev", 3))}
    out |= {f"net_profit_amount{e}": c(f"net_profit.v{p}") for e, p in (("", 1), ("_ly", 2), ("_fyprev", 3))}
    date = F.nullif(F.regexp_extract(normalize_text(c("period_header")), DATE, 0), F.lit(""))
    return found.select(*keys, "n_periods", date.alias("report_date"), *(x.alias(n) for n, x in out.items()))


def balance_sheet(cells: DataFrame, keys: Sequence[str], least: int = 4) -> DataFrame:
    """Ten figures a balance sheet, this year's and last year's; tables with fewer than least of them are none, and of a page's
    tables the first with most stays."""
    found = find_lines(cells, keys, BALANCE).filter("n_periods >= 2")
    values = [F.col(f"{n}.v{p}").alias(n + e) for n in BALANCE for e, p in (("", 1), ("_ly", 2))]
    known = sum((F.col(n).isNotNull().cast("int") * 2 for n in BALANCE), F.lit(0))
    return _first_best(found.select(*keys, "table_no", *values, known.alias("__known")).filter(F.col("__known") >= least), keys)


def cash_flow(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The operating cash flow of the period, of last year's and of the last full year."""
    found = find_lines(cells, keys, CASH).filter("n_periods >= 2 AND operating_cash_flow IS NOT NULL")
    values = [F.col(f"operating_cash_flow.v{p}").alias(f"operating_cash_flow{e}") for e, p in (("", 1), ("_ly", 2), ("_fyprev", 3))]
    return _first_best(found.select(*keys, "table_no", *values, F.lit(1).alias("__known")), keys)


def _first_best(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("__known"), "table_no")
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__known", "table_no")


def monthly_report(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, production, sales_quantity, sales_amount, domestic, exported, total: a page's figures for one month.

    The table is the first statement with a one-month header and a known measure, else the first statement. Of the last
    total row the one-month columns of product reports are taken, else, of service reports, the revenue, that recognised
    during the period first. Sales at home and abroad stand in a fixed cell of their rows; without these the total is
    the amount. Pages without a total row or a known column give no row.
    """
    own = cells.filter(F.array_contains(F.split("class", "\\s+"), STATEMENT))
    said = normalize_text(F.col("cell"))
    measure = said.contains(PRODUCED) | said.contains(SOLD) | said.contains(AMOUNT) | said.contains(REVENUE) | said.contains(OLD_REVENUE)
    marks = own.groupBy(*keys, "table_no").agg(
        (F.max((F.col("part") == "head") & said.rlike(ONE_MONTH)) & F.max((F.col("part") == "head") & measure)).alias("fits"))
    chosen = marks.groupBy(*keys).agg(F.min(F.struct((~F.col("fits")).alias("late"), "table_no"))["table_no"].alias("table_no"))
    own = own.join(chosen, [*keys, "table_no"])
    heads = column_headers(own, keys).filter(F.exists("parts", lambda x: x.rlike(ONE_MONTH))).withColumn("above", F.array_join("parts", " | "))
    body = own.filter(F.col("part") == "body").withColumn("cell", said)
    titles = body.filter("col_no = 0").select(*keys, "row_no", F.regexp_replace("cell", "\\s+", " ").alias("row_title"))
    total = titles.filter(F.col("row_title").isin(*TOTALS) | F.col("row_title").rlike(TOTAL_REVENUE)).groupBy(*keys).agg(F.max("row_no").alias("row_no"))
    figures = body.join(total, [*keys, "row_no"]).join(heads.select(*keys, "col_no", "above"), [*keys, "col_no"], "right").withColumn("amount", to_amount(F.col("cell")))
    above, at = F.col("above"), F.col("col_no")
    kinds = F.when(above.contains(PRODUCED), "production").when(above.contains(SOLD), "sales_quantity").when(above.contains(AMOUNT), "sales_amount")
    figures = figures.withColumn("kind", kinds)
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("col_no", F.col("cell").isNotNull().alias("there"), "amount")))
    earns = above.contains(REVENUE) | above.contains(OLD_REVENUE)
    service = F.min(F.when(earns, F.struct((~above.contains(DURING)).alias("late"), at, F.col("cell").isNotNull().alias("there"), "amount")))
    picked = figures.groupBy(*keys).agg(*(last(k).alias(k) for k in ("production", "sales_quantity", "sales_amount")), service.alias("service"))
    product = F.col("production").isNotNull() & F.col("sales_quantity").isNotNull() & F.col("sales_amount").isNotNull()
    there = F.when(product, F.col("production.there") & F.col("sales_quantity.there") & F.col("sales_amount.there")).otherwise(F.coalesce("service.there", F.lit(False)))
    month = picked.filter(there).select(*keys, *(F.when(product, F.col(f"{k}.amount")).otherwise(
        F.col("service.amount") if k == "sales_amount" else F.lit(0.0)).alias(k) for k in ("production", "sales_quantity", "sales_amount")))
    sums = body.filter(F.col("col_no") == SALES_CELL).join(titles, [*keys, "row_no"])
    sale = lambda mark: F.max_by(F.when(F.col("cell").rlike("^[-+]?[0-9,٬]*(\\.[0-9]+)?$"), to_amount(F.col("cell"))).otherwise(0.0),
                                 F.when(F.col("row_title").contains(mark), F.col("row_no")))
    sums = sums.groupBy(*keys).agg(sale(DOMESTIC).alias("domestic"), sale(EXPORTED).alias("exported"))
    out = month.join(sums, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("domestic", "exported")})
    both = F.col("domestic") + F.col("exported")
    return out.withColumn("total", F.when(both == 0, F.col("sales_amount")).otherwise(both))


def price_history(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, gregorian_date, jalali_date and 13 figures from tables of 16 columns: the exact value that a hidden span or the
    title gives, else the text. Rows with fewer columns or without both dates are left out."""
    body = cells.filter(F.col("part") == "body")
    exact = F.coalesce(to_whole(F.col("exact")), to_whole(F.col("title")), to_whole(F.col("cell")))
    at = lambda k, x: F.max(F.when(F.col("col_no") == k, x))
    values = []
    for k, name in enumerate(HISTORY, 2):
        values.append(at(k, to_amount(F.col("cell"), junk=None) if name.endswith("percent") else exact).alias(name))
    date = F.regexp_replace(normalize_text(at(0, F.col("cell"))), "[/.]", "-")
    rows = body.groupBy(*keys, "table_no", "row_no").agg(
        (F.max("col_no") + 1).alias("n"), F.try_to_date(F.regexp_extract(date, "\\d{4}-\\d{1,2}-\\d{1,2}", 0), "y-M-d").alias("gregorian_date"),
        F.nullif(normalize_text(at(15, F.col("cell"))), F.lit("")).alias("jalali_date"), *values)
    return rows.filter("n >= 16 AND gregorian_date IS NOT NULL AND jalali_date IS NOT NULL").drop("n", "table_no", "row_no")
