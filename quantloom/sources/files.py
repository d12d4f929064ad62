"""Files that other systems leave: JSON documents and lines, semicolon-separated text, override maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.text import csv_text, normalize_name


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON lines, or with whole, files of one document or list each. Missing fields are null, broken records come as nulls."""
    return spark.read.schema(schema).option("multiLine", whole).option("mode", "PERMISSIVE").json(path)


def read_fields(spark: SparkSession, path: str, names: Sequence[str], needed: int = 3, mark: str = ";") -> DataFrame:
    """Lines of fields between marks, by name; lines with fewer than needed fields or an empty second one are left out."""
    parts = F.split(F.rtrim(F.col("value")), mark)
    lines = spark.read.text(path).filter((F.size(parts) >= needed) & (F.trim(F.get(parts, F.lit(1))) != ""))
    return lines.select(*(F.trim(F.get(parts, F.lit(k))).alias(name) for k, name in enumerate(names)))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """symbol, value of a file with one JSON object of names, symbols in normal form; anything else gives no rows."""
    files = spark.read.text(path, wholetext=True)
    said = F.from_json("value", "map<string,string>")
    rows = files.filter(F.ltrim(F.col("value")).startswith("{")).select(F.explode(said).alias("symbol", "value"))
    return rows.select(normalize_name(F.col("symbol")).alias("symbol"), "value").filter("symbol <> ''")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file, which has to hold a JSON object: a list or broken JSON raises an error."""
    files = spark.read.text(path, wholetext=True)
    body = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    good = F.ltrim(F.col("value")).startswith("{") & F.try_parse_json("value").isNotNull()
    checked = F.when(good, body).otherwise(F.raise_error(F.lit("an ingest document has to be a JSON object")))
    return files.select(checked.alias("d")).select("d.*")


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c) for c in columns))


#: The byte order mark, by which spreadsheet programs know UTF-8.
MARK = "\ufeff"


def write_marked_csv(rows: DataFrame, folder: str, columns: dict[str, tuple[str, int | None]]) -> None:
    """Files under folder, each with the mark, the headers and its rows, so that each can be opened alone. columns gives each
    column's header and digits, None for text.

    In texts quotes become single ones and line ends blanks; texts with a comma stand in quotes. Nulls are empty.
    """
    def shown(c: str, digits: int | None) -> Column:
        if digits is not None:
            return F.format_string(f"%.{digits}f", F.col(c))
        return csv_text(F.col(c).cast("string"))

    named = [F.when(F.col(c).isNotNull(), shown(c, digits)).alias((MARK if k == 0 else "") + header) for k, (c, (header, digits)) in enumerate(columns.items())]
    rows.select(*named).write.options(header=True, encoding="UTF-8", emptyValue="", nullValue="").mode("overwrite").csv(folder)


def write_headed_lines(lines: DataFrame, folder: str, headers: Sequence[str]) -> str:
    """Lines made already, in their column line, as files under folder in the rows' order; each file begins with the mark and the
    headers. Gives that first line. A task without rows writes no headers."""
    head = MARK + ",".join(headers)
    first = F.monotonically_increasing_id() % F.lit(1 << 33) == 0
    lines.select(F.when(first, F.concat(F.lit(head + "\n"), F.col("line"))).otherwise(F.col("line")).alias("value")).write.mode("overwrite").text(folder)
    return head


def ensure_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table under folder with the columns of schema: made empty where there is none, and read with nulls for columns that its
    older files lack. Nothing that is there is written again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def replace_table(rows: DataFrame, folder: str) -> DataFrame:
    """rows as the whole new content of the table under folder, read back. The new version is written beside the old one, which
    stays for who still reads it; older ones go. A write that fails leaves the table as it was."""
    spark = rows.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    store = make(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    held = sorted(s.getPath().getName() for s in store.listStatus(make(folder))) if store.exists(make(folder)) else []
    whole = [name for name in held if store.exists(make(f"{folder}/{name}", "_SUCCESS"))]
    target = f"{folder}/v={int(held[-1][2:]) + 1 if held else 0:09d}"
    rows.write.parquet(target)
    for name in whole[:-1]:
        store.delete(make(f"{folder}/{name}"), True)
    return spark.read.schema(rows.schema).parquet(target)
