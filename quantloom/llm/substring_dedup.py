"""Exact substring dedup: shards' Burrows-Wheeler transforms, merged by interleave refinement, show repeated strings.

A string of `length` bytes is a window. Each window chooses the least hash among its grams of `gram` bytes as its anchor;
equal windows choose equal anchors at equal places, so windows can only repeat among the stretches of text that share an
anchor. Anchors that occur once end in an aggregation. Where all stretches of an anchor are one and the same string, all
windows in them repeat. Only the rest, where texts agree in part, goes to the merge of transforms.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import join_split, materialize, small_batches, table, text_key

LENGTH = 200
GRAM = 50
STEP = 8
PIECE = 1 << 18
BIN_BYTES = 1 << 20
SHARD_BYTES = 1 << 18
HOT_STRETCHES = 20_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
PLACE = np.uint64((1 << 20) - 1)


class Powers:
    """Powers of an odd 64-bit factor and of its inverse, for hashes of all grams at once by differences of sums."""

    def __init__(self, factor: np.uint64 = FACTOR) -> None:
        self.factor, self.up, self.down = factor, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(n, self.factor, np.uint64)
            base[0] = 1
            self.up = np.cumprod(base)
            base[1:] = np.uint64(pow(int(self.factor), -1, 1 << 64))
            self.down = np.cumprod(base)
        return self.up[:n], self.down[:n]


_powers, _second = Powers(), Powers(SECOND)


def prefix_sums(data: np.ndarray, powers: Powers = _powers) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.upto(len(data) + 1)[0][:-1], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:span - width], values[width - span:]) if width > span else values


def pieces(starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut the texts at [start, end) of one buffer into (first text, last text + 1, from, to) of about PIECE bytes; a long
    text is cut into pieces that overlap, so that each window lies in exactly one."""
    first, n = 0, len(starts)
    while first < n:
        if ends[first] - starts[first] > PIECE:
            for at in range(int(starts[first]), int(ends[first]) - length + 1, PIECE):
                yield first, first + 1, at, min(int(ends[first]), at + PIECE + length - 1)
            first += 1
            continue
        last = first
        while last < n and ends[last] - starts[last] <= PIECE and ends[last] - starts[first] <= PIECE:
            last += 1
        yield first, last, int(starts[first]), int(ends[last - 1])
        first = last


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Runs of windows with one anchor place in the texts [start, end) of data: text, start, windows, offset of the
    anchor, anchor, hash of the content (the bytes from the first window's start to the last one's end)."""
    n = len(data)
    if n < length:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    _, down = _powers.upto(n + 1)
    sums = prefix_sums(data)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, length - gram + 1)
    change = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(change[: len(least)]) > 0)
    chosen = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    text = np.searchsorted(starts, at, "right") - 1
    new[1:] |= text[1:] != text[:-1]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    start = at[head]
    place = (chosen[head] & PLACE).astype(np.int64)
    content = (sums[start + count + length - 1] - sums[start]) * down[start]
    return [text[head], start, count, place - start, grams[place], content]


def find_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows k1, k2, start, n, off, anchor, content of docs (k1, k2, body)."""
    names = ["k1", "k2", "start", "n", "off", "anchor", "content"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("body")
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            edges = np.frombuffer(body.buffers()[1], np.int32)[body.offset: body.offset + len(body) + 1].astype(np.int64)
            if not len(edges) or edges[-1] == edges[0]:
                continue
            data = np.frombuffer(body.buffers()[2], np.uint8)
            for first, last, lo, hi in pieces(edges[:-1], edges[1:], length):
                begins, stops = np.maximum(edges[first:last], lo) - lo, np.minimum(edges[first + 1:last + 1], hi) - lo
                filled = stops > begins
                begins, stops, who = begins[filled], stops[filled], np.arange(first, last)[filled]
                text, start, n, off, anchor, content = stretches(data[lo:hi], begins, stops, length, gram)
                who = who[text] if len(text) else text
                made = [k1[who], k2[who], start + lo - edges[who], n, off, anchor.view(np.int64), content.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int32() if c in ("n", "off") else pa.int64()) for x, c in zip(made, names)], names)

    return docs.mapInArrow(task, "k1 long, k2 long, start long, n int, off int, anchor long, content long")


def packed(data: np.ndarray) -> np.ndarray:
    """The STEP bytes from each place on as one number, in the order of strings; zeros follow the end."""
    data = np.concatenate([data, np.zeros(STEP, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) - STEP, np.uint64)
    for k in range(STEP):
        out = (out << np.uint64(8)) | data[k: k + len(out)]
    return out


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of keys from 0 on, equal keys alike; and the order."""
    order = np.argsort(keys, kind="stable")
    change = np.empty(len(keys), np.int64)
    change[:1] = 0
    change[1:] = keys[order[1:]] != keys[order[:-1]]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(change)
    return ranks, order


class Shard:
    """The transform of a few strings: for each suffix, in sorted order, the STEP bytes before it and the row there.

    Suffixes are sorted to `length` bytes by doubling, which is as far as the merge looks. The suffix row of a place STEP
    bytes further to the front is the last-to-first step; it is -1 where fewer bytes precede.
    """

    def __init__(self, strings: list[bytes], length: int) -> None:
        sizes = np.array([len(s) for s in strings])
        slots = np.concatenate([[0], np.cumsum(sizes + 1)])  # one more place a string, for its empty suffix
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        n = len(data)
        string = np.repeat(np.arange(len(strings)), sizes + 1)
        ends = slots[1:][string]
        symbols = packed(data)
        ranks, order = dense(symbols)
        span, places = STEP, np.arange(n)
        while span < length and ranks.max(initial=0) < n - 1:
            ahead = np.where(places + span < ends, ranks[np.minimum(places + span, n - 1)] + 1, 0)
            ranks, order = dense(ranks * (n + 1) + ahead)
            span *= 2
        row = np.empty(n, np.int64)
        row[order] = places
        before = order - STEP
        inside = before >= slots[string[order]]
        self.symbols = np.where(inside, symbols[np.maximum(before, 0)], 0)
        self.back = np.where(inside, row[np.maximum(before, 0)], -1)
        self.string, self.place = string[order], order - slots[string[order]]


def stable_order(codes: np.ndarray) -> np.ndarray:
    """A stable order of codes under 2**32, by two counting passes of 16 bits."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if len(codes) and codes.max() > 0xFFFF:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge_shards(shards: list[Shard], length: int) -> np.ndarray:
    """Rows, numbered through all shards, of the suffixes that share their first `length` bytes with another suffix.

    The interleave begins with the shards one after another. A round puts each row's preceding bytes in front: a stable
    sort by these bytes alone, in the order of the round before, interleaves the suffixes that begin STEP bytes earlier,
    and rows stay in one interval while their common prefix, now STEP bytes longer, is equal. Intervals of one row are
    left out at once. Suffixes themselves are never compared or sorted again. `length` is a multiple of STEP.
    """
    offsets = np.concatenate([[0], np.cumsum([len(s.back) for s in shards])])
    codes = dense(np.concatenate([s.symbols for s in shards]))[0].astype(np.uint32)
    back = np.concatenate([np.where(s.back >= 0, s.back + o, -1) for s, o in zip(shards, offsets)]).astype(np.int32)
    rows, interval = np.arange(offsets[-1], dtype=np.int32), np.zeros(offsets[-1], np.int32)
    for _ in range(length // STEP):
        inside = back[rows] >= 0
        rows, interval = rows[inside], interval[inside]
        code = codes[rows]
        order = stable_order(code)
        code, interval, rows = code[order], interval[order], back[rows[order]]
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = (code[1:] != code[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(new[:-1] & new[1:])
        rows, interval = rows[shared], np.cumsum(new[:-1])[shared].astype(np.int32)
    return rows


def repeated_runs(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places in strings where a string of `length` bytes begins that begins at another place too: number of the
    string, first place, number of places."""
    shards, firsts, held, size = [], [], [], 0
    for k, s in enumerate(strings):
        held.append(s)
        size += len(s)
        if size >= SHARD_BYTES or k == len(strings) - 1:
            firsts.append(k + 1 - len(held))
            shards.append(Shard(held, length))
            held, size = [], 0
    if not shards:
        return (np.empty(0, np.int64),) * 3
    rows = merge_shards(shards, length)
    string = np.concatenate([s.string + f for s, f in zip(shards, firsts)])[rows]
    place = np.concatenate([s.place for s in shards])[rows]
    order = np.lexsort([place, string])
    string, place = string[order], place[order]
    head = np.ones(len(rows), bool)
    head[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(head)
    return string[at], place[at], np.diff(np.append(at, len(rows)))


def may_repeat(anchors: list[int], offs: list[int], bodies: list[bytes], length: int, gram: int) -> list[bool]:
    """Whether a stretch shares a half's worth of bytes left or right of its anchor with another of the same anchor; a
    window around the anchor holds one of the two whole."""
    half = (length - gram) // 2
    left = [(a, b[o - half:o]) if o >= half else None for a, o, b in zip(anchors, offs, bodies)]
    right = [(a, b[o + gram:o + gram + half]) if len(b) >= o + gram + half else None for a, o, b in zip(anchors, offs, bodies)]
    seen_left, seen_right = Counter(left), Counter(right)
    return [(x is not None and seen_left[x] > 1) or (y is not None and seen_right[y] > 1) for x, y in zip(left, right)]


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_STRETCHES) -> DataFrame:
    """Rows k1, k2, start, n: n consecutive windows from byte start on of the text (k1, k2) repeat. docs: k1, k2, body."""
    found = materialize(find_stretches(docs, length, gram), "repeat-stretches")
    common = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("many"), (F.min("content") != F.max("content")).alias("varied")).filter("many > 1").drop("many")
    shared = materialize(join_split(found, common, ["anchor"], ["k1", "k2", "start"]).select(*found.columns, "varied"), "repeat-shared")
    plain = shared.filter(~F.col("varied")).select("k1", "k2", "start", "n")
    varied = shared.filter("varied")
    at = F.struct("k1", "k2", "start", "n", "off")
    contents = materialize(varied.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("many"), F.min(at).alias("at")), "repeat-contents")
    copied = join_split(varied, contents.filter("many > 1").select("anchor", "content"), ["anchor", "content"], ["k1", "k2", "start"])
    heavy = contents.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor")

    wanted = contents.groupBy("at.k1", "at.k2").agg(F.collect_list(
        F.struct(F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.off").alias("off"), "anchor", "many")).alias("wanted"))
    texts = docs.join(wanted, ["k1", "k2"])
    spec = {"k1": pa.int64(), "k2": pa.int64(), "start": pa.int64(), "off": pa.int32(), "anchor": pa.int64(), "many": pa.int64(), "stretch": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            for k1, k2, body, parts in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "body", "wanted"))):
                if (k1, k2) != before:  # copies of a text stand together in the join's order
                    rows += [(k1, k2, p["start"], p["off"], p["anchor"], p["many"], body[p["start"]: p["start"] + p["n"] + length - 1]) for p in parts]
                before = k1, k2
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), spec.values())], list(spec))

    bodies = materialize(texts.mapInArrow(cut, "k1 long, k2 long, start long, off int, anchor long, many long, stretch binary"), "repeat-bodies")
    total = bodies.agg(F.sum(F.octet_length("stretch"))).first()[0] or 0
    bins = max(1, -(-total // BIN_BYTES))

    def merged(group: pa.Table) -> pa.Table:
        rows = {}
        for row in group.to_pylist():  # copies of a text that a split join has cut twice
            rows[row["k1"], row["k2"], row["start"]] = row
        kept = list(rows.values())
        keep = may_repeat([r["anchor"] for r in kept], [r["off"] for r in kept], [r["stretch"] for r in kept], length, gram)
        kept = [r for r, k in zip(kept, keep) if k]
        string, place, n = repeated_runs([r["stretch"] for r in kept], length)
        out = [(kept[s]["k1"], kept[s]["k2"], kept[s]["start"] + p, c) for s, p, c in zip(string.tolist(), place.tolist(), n.tolist()) if kept[s]["many"] == 1]
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("k1", "k2", "start", "n"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))})

    light = bodies.join(heavy, "anchor", "left_anti").withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(bins)))
    runs = light.groupBy("bin").applyInArrow(lambda t: merged(t.drop_columns(["bin"])), "k1 long, k2 long, start long, n int")
    out = plain.unionByName(copied.select("k1", "k2", "start", "n")).unionByName(runs)
    if not heavy.isEmpty():
        out = out.unionByName(_hashed_windows(bodies.join(heavy, "anchor", "left_semi"), length))
    return out


def _hashed_windows(bodies: DataFrame, length: int) -> DataFrame:
    """For anchors with more stretches than one task should hold: a row for each window, by two 64-bit hashes, which
    spreads and combines however common the anchor."""
    names = ["k1", "k2", "start", "many", "w1", "w2"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, start, many, body in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "start", "many", "stretch"))):
                data = np.frombuffer(body, np.uint8)
                n = len(data) - length + 1
                hashes = []
                for powers in (_powers, _second):
                    sums = prefix_sums(data, powers)
                    hashes.append(((sums[length:] - sums[:-length]) * powers.upto(len(data) + 1)[1][:n]).view(np.int64))
                cols = [np.full(n, k1), np.full(n, k2), start + np.arange(n), np.full(n, many), *hashes]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    windows = bodies.dropDuplicates(["k1", "k2", "start"]).select("k1", "k2", "start", "many", "stretch").mapInArrow(
        task, ", ".join(f"{c} long" for c in names))
    windows = materialize(windows, "repeat-windows")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w1", "w2")
    return windows.filter("many = 1").join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "start", F.lit(1).alias("n"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_STRETCHES,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans (array of start, end), one a row of docs.

    Each byte that a string of `length` bytes covers which also begins anywhere else, in the same document or another, is
    removed; overlaps count, matches don't cross documents, and strings are judged on the input. `length` is a multiple
    of 8, `gram` at most half of it. Texts are UTF-8 bytes, null counts as empty. Equal texts, with equal or different or
    null ids, repeat each other wholly if they have `length` bytes. Shorter texts are kept whole. An empty table gives no
    rows. Other columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text_col), text.cast("binary").alias("body"))
    spans = find_repeats(slim.drop("doc_id"), length, gram, hot)
    cuts = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, parts in zip(batch.column("body").to_pylist(), batch.column("cuts").to_pylist()):
                runs: list[list[int]] = []
                for start, stop in sorted((p["start"], p["start"] + p["n"] + length - 1) for p in parts or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                edges = [0, *(x for run in runs for x in run), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, runs))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    schema = T._parse_datatype_string(
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
    return slim.join(cuts, ["k1", "k2"], "left").select("doc_id", "body", "cuts").mapInArrow(task, schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
