"""Elements of HTML pages as rows: a task builds each page's tree and gives what stands in the elements asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements that have no end tag, and those that the start of another of their kind ends; fixed values.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
ENDS_ITSELF = frozenset(("li", "p", "option", "tr", "td", "th", "dt", "dd"))


class Tree(HTMLParser):
    """nodes in the order of their start tags: tag, attributes, parent, place among its parent's children of that tag, the
    node behind its last descendant, and where its text begins and ends in `pieces`."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.pieces: list[str] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_ITSELF and self.open and self.nodes[self.open[-1]]["tag"] == tag:
            self._end()
        parent = self.open[-1] if self.open else None
        counts = self.nodes[parent]["kinds"] if parent is not None else self.__dict__.setdefault("roots", {})
        counts[tag] = counts.get(tag, 0) + 1
        self.nodes.append({"tag": tag, "attrs": dict(attrs), "parent": parent, "place": counts[tag], "kinds": {}, "end": None, "text": [len(self.pieces), None]})
        self.open.append(len(self.nodes) - 1)
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end()

    def _end(self) -> None:
        node = self.nodes[self.open.pop()]
        node["end"], node["text"][1] = len(self.nodes), len(self.pieces)

    def handle_endtag(self, tag):
        if any(self.nodes[i]["tag"] == tag for i in self.open):  # else an end without a start
            while self.nodes[self.open[-1]]["tag"] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        self.pieces.append(data)

    def text(self, i: int) -> str:
        """The stripped pieces of text under a node, one after another."""
        return "".join(p.strip() for p in self.pieces[slice(*self.nodes[i]["text"])])

    def under(self, i: int, tag: str) -> Iterator[int]:
        return (j for j in range(i + 1, self.nodes[i]["end"]) if self.nodes[j]["tag"] == tag)

    def path(self, i: int | None) -> str:
        steps = []
        while i is not None:
            node = self.nodes[i]
            steps.append(f"{node['tag']}[{node['place']}]")
            i = node["parent"]
        return "/".join(reversed(steps))


def parse_tree(html: str | None) -> Tree:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    while tree.open:  # elements that never end
        tree._end()
    return tree


def element_rows(pages: DataFrame, tag: str, attribute: str | None = None, pattern: str = "", inner: str = "div", html_col: str = "html") -> DataFrame:
    """The other columns of pages with row_no, path, boxes (text, link): a row for each element by a tag of which an attribute
    holds the pattern, with all elements by the tag `inner` under it, at any depth, in order.

    text joins the stripped texts under a box, whatever stands between them; link is the text of its first link, null
    without one. Attributes may be quoted either way or not at all, character references are resolved, ends without a
    start are passed over, elements that never end do so with what they stand in. Null pages give no row; columns of pages
    by the new names are replaced.
    """
    made = {"row_no": "int", "path": "string", "boxes": "array<struct<text:string,link:string>>"}
    pages = pages.drop(*(c for c in made if c != html_col))
    kept, wanted = [c for c in pages.columns if c != html_col], re.compile(pattern)
    box = pa.list_(pa.struct([("text", pa.string()), ("link", pa.string())]))

    def rows_of(html: str | None) -> Iterator[tuple]:
        tree, k = parse_tree(html), 0
        for i, node in enumerate(tree.nodes):
            if node["tag"] == tag and (attribute is None or wanted.search(node["attrs"].get(attribute) or "")):
                boxes = []
                for j in tree.under(i, inner):
                    link = next(tree.under(j, "a"), None)
                    boxes.append({"text": tree.text(j), "link": None if link is None else tree.text(link)})
                yield k, tree.path(i), boxes
                k += 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, html in enumerate(batch.column(html_col).to_pylist()):
                found = list(rows_of(html))
                if found:
                    own = [pa.array([batch.column(c)[at].as_py()] * len(found), batch.column(c).type) for c in kept]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.string(), box)))], [*kept, *made])

    schema = T.StructType([pages.schema[c] for c in kept] + T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in made.items())).fields)
    return pages.mapInArrow(task, schema)
