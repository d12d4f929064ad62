"""What leaves the library: the score as the list that users download, the backtest's files, the best companies for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import clip, round_away
from quantloom.functions.text import csv_flag, csv_number, csv_quoted
from quantloom.plans.crosssection import TOPS, _section, backtest_portfolios, book_summary, mean_correlations, portfolios, scored
from quantloom.plans.market import _away
from quantloom.plans.registry import query, sql_of
from quantloom.plans.score import _FLAGS, WEIGHTS, _view, score_view
from quantloom.plans.shown import _FINAL, CUT, CUT_HIGH, CUT_LOW, DIGITS, _cut_sql
from quantloom.sources.domain import Tables
from quantloom.sources.files import read_json, write_headed_lines, write_marked_csv
from quantloom.sources.store import fresh_folder, written

# ---- the score as a list ----------------------------------------------------------------------------------------------
#: Price over sales, known for a sound P/E and a margin above zero, at most a hundred.
_PS = "CASE WHEN pe_raw > 0 AND pe_raw <= 60 AND nm_raw > 0 AND pe_raw * (nm_raw / 1e2) <= 1e2 THEN pe_raw * (nm_raw / 1e2) END"
#: The list's columns in order: the header that users see, what it is made from, and the digits shown. Fixed values.
LIST = (
    ("امتیاز_کل", "quant_score", 1), *zip(("امتیاز_رشد", "امتیاز_سودآوری", "امتیاز_ارزش‌گذاری", "امتیاز_بازار"), (f"{n}_score" for n in WEIGHTS), (1,) * 4), ("کیفیت_داده", "dq", 0),
    ("رشد_فروش_سالانه_٪", "sg_raw", 1), ("رشد_فروش_۳ماهه_٪", "sg3_raw", 1), ("رشد_درآمد_YoY_٪", "rg_raw", 1), ("ثبات_فروش", "st", 2), ("رشد_سود_عملیاتی_٪", "opg_raw", 1),
    ("رشد_سود_خالص_٪", "npg_raw", 1), ("حاشیه_عملیاتی_٪", "om_raw", 1), ("حاشیه_خالص_٪", "nm_raw", 1), ("روند_حاشیه_٪", "mt_raw", 1), ("پوشش_بهره", "coverage", 2),
    ("سهم_غیرعملیاتی_٪", "non_operating", 1), ("EPS", "ttm_eps", 2), ("قیمت", "price", 0), ("P/E", "pe_raw", 1), ("P/S", "ps_shown", 2), ("بازده_۷روز_٪", "return7", 1),
    ("بازده_۳۰روز_٪", "return30", 1), ("بازده_۹۰روز_٪", "return90", 1), ("ارزش_معاملات_۳۰روز", "avg_value", 0), ("حجم_میانگین_۳۰روز", "avg_volume", 0), ("نوسان_۳۰روز_٪", "volatility", 2),
    ("جایگاه_قیمتی_۹۰روز_٪", "position90", 1))
FLAGS = (("فلگ_PE_نامعتبر", _FLAGS["bad_pe"]), ("فلگ_فروش_ضعیف", _FLAGS["weak_sales"]), ("فلگ_سود_عملیاتی_ضعیف", _FLAGS["weak_operating"]),
         ("فلگ_نقدشوندگی_ضعیف", "coalesce(avg_value <= 0, true)"), ("فلگ_زیان‌ده", _FLAGS["loss_maker"]), ("فلگ_پوشش_بهره_ضعیف", _FLAGS["weak_coverage"]),
         ("فلگ_انقباض_حاشیه", _FLAGS["margin_contraction"]))
HEADERS = ("نماد", "نام_شرکت", *(h for h, _, _ in LIST), *(h for h, _ in FLAGS))
#: Digits to which the view gives the columns that the display rounding doesn't name.
_MORE_DIGITS = {"ps_shown": 2, "avg_volume": 2, "quant_score": 2, **{f"{n}_score": 1 for n in WEIGHTS}}


def _listed_sql(c: str, digits: int) -> str:
    x = _away(f"({_PS if c == 'ps_shown' else _cut_sql(c)})", (DIGITS | _MORE_DIGITS)[c])
    x = f"({x}) * 1e2" if c == "dq" else x
    return f"CASE WHEN coalesce({x}, 0) = 0 THEN '' ELSE printf('%.{digits}f', {x}) END"


def shown(df: DataFrame) -> DataFrame:
    """The view's figures as they are displayed: rounded by column, growths cut."""
    cut = lambda c: clip(F.col(c), CUT_LOW, CUT_HIGH) if c in CUT else F.col(c)
    return df.withColumn("ps_shown", F.expr(_PS)).withColumns({c: round_away(cut(c), d) for c, d in (DIGITS | _MORE_DIGITS).items()})


@query("score_list_file", _view(*_FINAL, then=f"""SELECT concat_ws(',', '"S' || company_id || '"', '"' || company_name || ' ''a'', b"', {", ".join(_listed_sql(c, d) for _, c, d in LIST)},
  {", ".join(f"CASE WHEN {x} THEN 'بله' ELSE '' END" for _, x in FLAGS)}) AS line FROM final"""))
def score_list_file(t: Tables) -> DataFrame:
    """The whole list as users download it, best first: the mark, headers in their language, texts in quotes, nothing for zero, words
    for flags. Read back as the files' lines, without those of headers."""
    view = score_view(t)
    flags = {f"__flag{k}": F.expr(x) for k, (_, x) in enumerate(FLAGS)}  # from the view's own figures, before they are rounded
    rows = shown(view.withColumns(flags))
    number = lambda c, d: csv_number(F.col(c) * 100.0 if c == "dq" else F.col(c), d)
    cells = [csv_quoted(F.concat(F.lit("S"), F.col("company_id"))), csv_quoted(F.concat(F.col("company_name"), F.lit(' "a",\r\nb'))),
             *(number(c, d) for _, c, d in LIST), *(csv_flag(F.col(f)) for f in flags)]
    folder = fresh_folder(t.spark, "score-list")
    head = write_headed_lines(rows.orderBy(F.desc("quant_score"), "company_id").select(F.concat_ws(",", *cells).alias("line")), folder, HEADERS)
    return t.spark.read.text(folder).select(F.col("value").alias("line")).filter(~F.col("line").isin(head, head[1:]))  # readers may drop the mark


# ---- the backtest's files -----------------------------------------------------------------------------------------------
_BOOKS = ("bench", *(f"top{k}" for k in TOPS), *(f"top{k}_excess" for k in TOPS))


@query("backtest_portfolio_file", sql_of("backtest_portfolios"))
def backtest_portfolio_file(t: Tables) -> DataFrame:
    """The portfolios of each date as marked CSV files, which give the same figures when read."""
    rows = backtest_portfolios(t).select("day", "h", "n", *_BOOKS)
    folder = fresh_folder(t.spark, "backtest-books")
    write_marked_csv(rows, folder, {c: (c, None) for c in rows.columns})
    return t.spark.read.schema(rows.schema).options(header=True, encoding="UTF-8").csv(folder)


@query("backtest_results_file", f"""
SELECT 'ic' AS part, series AS name, n, mean, t, positive FROM ({sql_of("backtest_ic")})
UNION ALL SELECT 'portfolio', h || '/' || top, n, mean_excess, NULL, hit_rate FROM ({sql_of("backtest_summary")})""")
def backtest_results_file(t: Tables) -> DataFrame:
    """The backtest's summary as one JSON document, correlations by series and portfolios by horizon and size, and read from it.
    Companies are scored once for both."""
    rows = written(scored(_section(t)), "scored")
    ic = mean_correlations(rows).select(F.col("series").alias("name"), F.struct("n", "mean", "t", "positive").alias("v"))
    books = book_summary(portfolios(rows)).select(F.concat_ws("/", "h", "top").alias("name"), F.struct("n", F.col("mean_excess").alias("mean"), F.lit(None).cast("double").alias("t"), F.col("hit_rate").alias("positive")).alias("v"))
    # some twenty series and a handful of portfolios, however many companies there are
    both = ic.withColumn("part", F.lit("ic")).unionByName(books.withColumn("part", F.lit("portfolio")))
    parts = both.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("m"))
    document = parts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("part", "m"))), {"pretty": "true"}).alias("value"))
    folder = fresh_folder(t.spark, "backtest-results")
    document.coalesce(1).write.text(folder)
    kind = "struct<n:bigint,mean:double,t:double,positive:double>"
    read = read_json(t.spark, folder, f"ic map<string,{kind}>, portfolio map<string,{kind}>", whole=True)
    rows = read.select(F.explode(F.create_map(F.lit("ic"), "ic", F.lit("portfolio"), "portfolio")).alias("part", "m")).select("part", F.explode("m").alias("name", "v"))
    return rows.select("part", "name", "v.*")


# ---- prompts ------------------------------------------------------------------------------------------------------------
_ASKED = (*DIGITS, "quant_score", *(f"{n}_score" for n in WEIGHTS))


@query("prompt_rows", _view(*_FINAL, then="SELECT row_number() OVER (ORDER BY quant_score DESC, company_id) AS place, company_id, company_name, "
       + ", ".join(f"{_away(f'({_cut_sql(c)})', (DIGITS | _MORE_DIGITS)[c])} AS {c}" for c in _ASKED) + " FROM final ORDER BY quant_score DESC, company_id LIMIT 8"))
def prompt_rows(t: Tables) -> DataFrame:
    """The best eight with all their displayed figures as the indented JSON text of a prompt, best first, nulls written out; read from
    the text again."""
    best = shown(score_view(t)).orderBy(F.desc("quant_score"), "company_id").limit(8)
    fields = ("company_id", "company_name", *_ASKED)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("quant_score")).alias("__k"), "company_id", F.struct(*fields).alias("__row"))))
    payload = best.agg(F.to_json(F.transform(ordered, lambda r: r["__row"]), {"pretty": "true", "ignoreNullFields": "false"}).alias("payload"))
    kind = "array<struct<" + ",".join(f"{c}:{best.schema[c].dataType.simpleString()}" for c in fields) + ">>"
    rows = payload.select(F.posexplode(F.from_json("payload", kind)).alias("i", "r"))
    return rows.select((F.col("i") + 1).cast("long").alias("place"), "r.*")
