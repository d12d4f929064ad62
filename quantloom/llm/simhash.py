"""SimHash near-duplicates: fingerprints, a binary trie self-join within an error budget, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import join_split, materialize, small_batches, table

BITS = 64
WORDS = 4
BUDGET = 4
GROUP_ROWS = 4096
TASK_ROWS = 20_000
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 value of each word shingle of a text, repeats included; a text of fewer words is one shingle, one without
    words has none."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    line = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(split))
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts[: len(split) - width + 1].tolist(), ends[width - 1:].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at:at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 values of a text's word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS, out_col: str = "fp", text_col: str = "text") -> DataFrame:
    """docs with out_col, the 64 bits as a long; a column by that name is replaced. Null text counts as empty; null ids and
    repeated rows come out as they are; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, out_col])

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField(out_col, T.LongType())]))


class Forest:
    """Union-find over positions of an array, roots being the least position."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, high, low)
            a, b = high, low


def trie_walk(values: np.ndarray, budget: int, edges: np.ndarray, roots: np.ndarray, found: Callable, chunk: int = 1 << 16) -> None:
    """Call found(i, j) with places of values within budget bits whose roots differ; it may return newer roots.

    edges cut values into tries, each sorted for itself. A sorted array is a binary trie, a node being the range of values
    that share leading bits. Pairs of nodes are walked down together with the bits that differ so far; a pair goes when
    the budget is exceeded, or when both nodes already lie in one and the same group. Pairs wait on a stack in pieces of
    bounded size, deepest first. Equal values are parted by their places.
    """
    first = edges[:-1], edges[1:], edges[:-1], edges[1:], np.zeros(len(edges) - 1, np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(BITS - 1, first)]
    runs_of = lambda r: np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
    runs = runs_of(roots)
    while stack:
        bit, (a0, a1, b0, b1, cost) = stack.pop()
        if len(a0) > chunk:
            stack += [(bit, tuple(x[at:at + chunk] for x in (a0, a1, b0, b1, cost))) for at in range(0, len(a0), chunk)]
            continue
        open_ = (runs[a0] != runs[a1 - 1]) | (runs[b0] != runs[b1 - 1]) | (roots[a0] != roots[b0])
        a0, a1, b0, b1, cost = (x[open_] for x in (a0, a1, b0, b1, cost))
        small = (a1 - a0) * (b1 - b0) <= 64
        if small.any():
            x0, x1, y0, y1 = a0[small], a1[small], b0[small], b1[small]
            wide = y1 - y0
            size = (x1 - x0) * wide
            at = np.repeat(np.arange(len(size)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = x0[at] + k // wide[at], y0[at] + k % wide[at]
            near = (i < j) & (roots[i] != roots[j])
            i, j = i[near], j[near]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            newer = found(i[near], j[near])
            if newer is not None:
                roots, runs = newer, runs_of(newer)
        a0, a1, b0, b1, cost = (x[~small] for x in (a0, a1, b0, b1, cost))
        if not len(a0):
            continue
        same = a0 == b0
        if bit < 0:
            am, bm, apart = (a0 + a1) // 2, (b0 + b1) // 2, 0
        else:
            if bit not in ones:
                ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1))]).astype(np.int32)
            am, bm, apart = a1 - (ones[bit][a1] - ones[bit][a0]), b1 - (ones[bit][b1] - ones[bit][b0]), 1
        parts = [
            (a0, am, b0, bm, cost, None), (am, a1, bm, b1, cost, None),
            (a0, am, bm, b1, cost + apart, None), (am, a1, b0, bm, cost + apart, ~same),
        ]
        nxt = []
        for x0, x1, y0, y1, c, only in parts:
            ok = (x0 < x1) & (y0 < y1) & (c <= budget)
            if only is not None:
                ok &= only
            ok &= ~((x1 - x0 == 1) & (y1 - y0 == 1) & (x0 == y0))
            nxt.append(tuple(x[ok] for x in (x0, x1, y0, y1, c)))
        stack.append((max(bit - 1, -1), tuple(np.concatenate([p[k] for p in nxt]) for k in range(5))))


def trie_join(values: np.ndarray, budget: int, edges: np.ndarray | None = None) -> np.ndarray:
    """Group sorted 64-bit values that chains of links within budget bits connect: a root position for each. edges cut values
    into tries; by default all are one."""
    n, forest, since = len(values), Forest(len(values)), 0

    def found(i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
        nonlocal since
        forest.join(i, j)
        since += len(i)
        if since <= n // 8:
            return None
        since = 0
        return forest.roots()

    if n > 1:
        trie_walk(values, budget, np.array([0, n]) if edges is None else edges, forest.roots(), found)
    return forest.roots()


def blocks(bits: list[int], parts: int) -> list[list[int]]:
    """Cut bit numbers into runs of nearly equal length."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _shares(mask: int) -> F.Column:
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.col("fp").bitwiseAND(F.lit(signed).cast("long"))


def links(prints: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows a, b that connect the distinct fingerprints of prints (column fp) as pairs within budget bits do.

    Two fingerprints within budget bits agree on one of budget + 1 blocks of bits at least, so equal blocks bring
    partners together; a trie join finds the links of a group and returns one row for each fingerprint that has any,
    never all pairs. Groups of over group_rows fingerprints are dealt again by blocks of the bits that they don't share
    yet, to any depth: no group is dropped or cut.
    """
    whole = (1 << 64) - 1
    level = prints.select("fp").distinct().select("fp", F.lit(0).cast("long").alias("fixed"))
    found = None
    todo: list[int] = [0]
    while todo:
        rows = None
        for fixed in todo:
            free = [b for b in range(BITS) if not fixed >> b & 1]
            masks = [fixed | sum(1 << b for b in part) for part in blocks(free, budget + 1)]
            one = level.filter(F.col("fixed") == _signed(fixed)).select(
                "fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("mask"), _shares(m).alias("key")) for m in masks])).alias("g"))
            rows = one if rows is None else rows.unionByName(one)
        rows = rows.select("fp", "g.mask", "g.key")
        rows = rows.distinct() if found is not None else rows
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        large = sizes.filter((F.col("n") > group_rows) & (F.bit_count(F.col("mask")) < BITS - budget))
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most (budget + 1) ** depth masks
        if masks:
            rows, large = materialize(rows, "simhash-rows"), materialize(large, "simhash-large")
            level = rows.join(large.select("mask", "key"), ["mask", "key"], "left_semi").select("fp", F.col("mask").alias("fixed")).distinct()
            level = materialize(level, "simhash-level")
            rows = rows.join(large.select("mask", "key"), ["mask", "key"], "left_anti")
        made = _join_groups(rows, budget)
        found = made if found is None else found.unionByName(made)
        todo = [m & whole for m in masks]
    return found


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _join_groups(rows: DataFrame, budget: int) -> DataFrame:
    """Trie joins of all groups (mask, key) of a partition, each group whole in one partition."""
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [np.empty(0, np.int64)] * 3, 0

        def joined(mask, key, fp, last):
            """Links of the complete groups; the rest, the last group, waits for more rows."""
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            edges = np.concatenate([[0], change, [len(fp)] if last else []]).astype(np.int64)
            done = edges[-1]
            values = fp[:done].view(np.uint64) ^ np.uint64(1 << 63)  # in the order in which Spark sorts longs
            roots = trie_join(values, budget, edges)
            other = np.flatnonzero(roots != np.arange(done))
            out = pa.RecordBatch.from_arrays([pa.array(fp[roots[other]]), pa.array(fp[other])], ["a", "b"])
            return out, [mask[done:], key[done:], fp[done:]]

        more = []
        for batch in batches:
            more.append([batch.column(c).to_numpy() for c in ("mask", "key", "fp")])
            waiting += batch.num_rows
            if waiting >= TASK_ROWS:
                out, held = joined(*(np.concatenate(x) for x in zip(held, *more)), False)
                more, waiting = [], len(held[0])
                yield out
        held = [np.concatenate(x) for x in zip(held, *more)] if more else held
        if len(held[0]):
            yield joined(*held, True)[0]

    return dealt.select("mask", "key", "fp").mapInArrow(task, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows node, root for all nodes of edges (columns a, b): the least node that edges lead to.

    Each round hangs every node's root, and its neighbours' roots, below the least root among them, then halves the
    paths; it ends when no root changes. A round is three aggregations that combine before they shuffle, and joins
    whose large side may be split, so a node with very many edges is no single group. Rounds are written out.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = materialize(both.distinct(), f"{name}-edges")
    roots = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
    roots = materialize(roots, name)
    while True:
        near = join_split(both, roots.select(F.col("node").alias("v"), F.col("root").alias("near")), ["v"], ["u"])
        best = near.groupBy("u").agg(F.min("near").alias("near"))
        seen = roots.join(best, roots["node"] == best["u"]).select("node", "root", F.least("root", "near").alias("low"))
        hook = seen.select(F.col("root").alias("node"), "low").union(seen.select("node", "low")).groupBy("node").agg(F.min("low").alias("low"))
        up = hook.select(F.col("node").alias("low"), F.col("low").alias("top"))
        after = materialize(
            hook.join(up, "low", "left").select("node", F.least("low", F.coalesce("top", "low")).alias("root")), name)
        changed = after.join(roots.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        roots = after
        if not changed:
            return roots


def _members(prints: DataFrame, budget: int, group_rows: int) -> DataFrame:
    """Rows fp, root of all fingerprints in the table prints."""
    joined = components(links(prints, budget, group_rows), "simhash-components")
    return prints.select("fp").distinct().join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def link_documents(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, group_rows: int = GROUP_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, fp, component_id (the least id of the component), one for each row of docs.

    Equal fingerprints are one vertex, so copies cost one row. Null text counts as empty; all texts without words have
    fingerprint 0, linked like any other. A null id is kept, and component_id is null only where all ids are. Repeated
    rows come out repeated. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(fingerprints(slim, words).select("doc_id", "fp"), "simhash-prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(_members(prints, budget, group_rows), "fp")
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = materialize(rooted.join(tops, "root").select("fp", "component_id"), "simhash-members")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_documents(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
