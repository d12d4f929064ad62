"""HTML tables as rows: a task parses its pages with the standard library; spans filled, hidden cells left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.sources.store import small_batches, written

#: Columns that a cell may span, as browsers have it; rows are bounded by the table's own.
MOST_COLUMNS = 1000
#: Cells after which a batch of them is passed on, with those of the page at hand.
CELLS_AT_ONCE = 10_000
EXACT = re.compile(r"\[([-\d.,]+)\]")


def hidden(attrs: dict) -> bool:
    style = re.sub(r"\s", "", attrs.get("style") or "").lower()
    return ("hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true"
            or any(x in style for x in ("display:none", "visibility:hidden", "opacity:0")))


def span(value: str | None, most: int) -> int:
    digits = (value or "").strip().lstrip("0")
    return min(int(digits[:9]), most) if digits.isascii() and digits.isdigit() else 1


class _Tables(HTMLParser):
    """tables: of each table its class, and its rows: part (head or body), and the visible cells: tag, text, columns, rows,
    exact, title. Exact is what a hidden span gives in brackets."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "table":
            self.tables.append((given.get("class") or "", []))
            self.open.append({"rows": self.tables[-1][1], "part": "body", "cell": None, "spans": []})
        if not self.open:
            return
        top = self.open[-1]
        if tag in ("thead", "tbody", "tfoot"):
            top["part"] = "head" if tag == "thead" else "body"
        elif tag == "tr":
            self._close(top)
            top["rows"].append((top["part"], []))
        elif tag in ("td", "th"):
            self._close(top)
            if not top["rows"]:
                top["rows"].append((top["part"], []))
            top["cell"] = {"tag": tag, "text": [], "wide": span(given.get("colspan"), MOST_COLUMNS), "high": span(given.get("rowspan"), 1 << 16),
                           "hidden": hidden(given), "exact": None, "title": given.get("title")}
            top["spans"] = []
        elif tag == "span" and top["cell"]:
            top["spans"].append(hidden(given))

    def _close(self, top: dict) -> None:
        cell, top["cell"] = top["cell"], None
        if cell and not cell["hidden"]:
            top["rows"][-1][1].append((cell["tag"], " ".join(" ".join(cell["text"]).split()), cell["wide"], cell["high"], cell["exact"], cell["title"]))

    def handle_endtag(self, tag):
        if not self.open:
            return
        top = self.open[-1]
        if tag == "span" and top["spans"]:
            top["spans"].pop()
        elif tag in ("td", "th", "tr"):
            self._close(top)
        elif tag == "thead":
            top["part"] = "body"
        elif tag == "table":
            self._close(top)
            self.open.pop()

    def handle_data(self, data):
        for top in self.open:
            if top["cell"]:
                top["cell"]["text"].append(data)
                found = EXACT.search(data) if any(top["spans"]) else None
                if found and top["cell"]["exact"] is None:
                    top["cell"]["exact"] = found[1]


def parse_tables(html: str | None) -> list[tuple[str, list]]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    while parser.open:  # tables that never end
        parser._close(parser.open.pop())
    return parser.tables


def grid(rows: list[list[tuple]]) -> Iterator[tuple[int, int, tuple]]:
    """(row, column, cell) of cells at their places, each repeated over the columns and rows, of the table, that it spans."""
    filled: set[tuple[int, int]] = set()
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in filled:
                c += 1
            for i in range(r, min(r + cell[3], len(rows))):
                for j in range(c, c + cell[2]):
                    if (i, j) not in filled:
                        filled.add((i, j))
                        yield i, j, cell
            c += cell[2]


def cells(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The other columns of pages with table_no, class, part, row_no, col_no, cell, exact, title: a row for each visible cell
    of each table on each page.

    part is head or body, each with rows from 0 on. In the head, cells fill the columns and rows that they span; in the
    body, the columns. Pages come in Arrow batches; null and malformed pages give what can be read, others nothing.
    Columns of pages by the new names are replaced.
    """
    made = {"table_no": "int", "class": "string", "part": "string", "row_no": "int", "col_no": "int", "cell": "string", "exact": "string", "title": "string"}
    pages = pages.drop(*(c for c in made if c != html_col))
    kept = [c for c in pages.columns if c != html_col]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def rows_of(html: str | None) -> Iterator[tuple]:
        for k, (css, rows) in enumerate(parse_tables(html)):
            head, body = ([r for part, r in rows if part == p] for p in ("head", "body"))
            for r, c, cell in grid(head):
                yield k, css, "head", r, c, cell[1], cell[4], cell[5]
            for r, row in enumerate(body):
                c = 0
                for cell in row:
                    for _ in range(cell[2]):
                        yield k, css, "body", r, c, cell[1], cell[4], cell[5]
                        c += 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            for k, html in enumerate(batch.column(html_col).to_pylist()):
                before = len(found)
                found += rows_of(html)
                at += [k] * (len(found) - before)
                if len(found) >= CELLS_AT_ONCE or found and k + 1 == batch.num_rows:
                    own = [batch.column(c).take(pa.array(at, pa.int32())) for c in kept]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(zip(*found), kinds))], [*kept, *made])
                    at, found = [], []

    schema = T.StructType([pages.schema[c] for c in kept] + T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in made.items())).fields)
    return pages.mapInArrow(task, schema)


def parsed(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """cells, written once: pages are parsed in batches bounded by bytes, and what reads the cells again and again, as a
    statement's finder does, parses nothing."""
    with small_batches(pages.sparkSession):
        return written(cells(pages, html_col), "cells")


def links(html: Column) -> Column:
    """The targets of all links, in order, quoted either way or not at all."""
    found = F.regexp_extract_all(html, F.lit("""(?i)<a(?:\\s[^>]*?)?\\shref\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>]+)"""), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, """^["']|["']$""", ""))


def element_text(html: Column, element: str) -> Column:
    """The text of the element with an id, null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(html, f"<[^>]*\\bid=[\"']{element}[\"'][^>]*>([^<]*)<", 1)), F.lit(""))
