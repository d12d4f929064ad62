"""Near copies by SimHash: the trie self-join of fingerprints proposes pairs at a loose budget, exact Jaccard decides.

Texts with a Jaccard similarity of 0.8 differ by about ten of 64 bits, by twenty at times, where blocks of equal bits bring
no partners together any more. So the groups in which tries are walked come from least shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import join_split, materialize, scratch, small_batches
from quantloom.llm.simhash import SEED, components, majority, shingle_hashes, trie_walk

WORDS = 5
LEAST = 0.8
#: Of 64 bits, pairs at 0.8 differ by 9.7 on average with a deviation of 2.9; this is four deviations more.
BUDGET = 22
#: Two texts of similarity s share one band at least with probability 1 - (1 - s ** 4) ** 24: all but three in a million at 0.8.
BANDS, ROWS = 24, 4
#: Of 96 minima, pairs at 0.8 agree on 77 on average and, but for five in a million, on 60.
LEAST_MINIMA = 60
GROUP_ROWS = 4000
#: Bytes of sets that a part of a group has, about.
GROUP_BYTES = 32 << 20
MIX = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, words))


def minima(hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The least value of a set, which isn't empty, under each of the mixes."""
    least = np.full(len(MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), chunk):
        np.minimum(least, np.multiply.outer(MIX, hashes[at:at + chunk]).min(axis=1), out=least)
    return least


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sets' Jaccard similarity is at least least."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _sketches(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """docs with set1 and set2, two hashes of the set of shingles, keys, one a band, fp, the fingerprint, and sketch, a byte of each
    minimum."""
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, others, keys, prints, bytes_ = [], [], [], [], []
            for text in batch.column(at).to_pylist():
                hashes = shingle_hashes(text, words)
                own = np.unique(hashes)
                sets.append(xxhash.xxh64_intdigest(own.tobytes()))
                others.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                prints.append(majority(hashes))
                least = minima(own) if len(own) else np.empty(0, np.uint64)
                keys.append(np.array([xxhash.xxh64_intdigest(least[k:k + ROWS].tobytes(), k) for k in range(0, len(least), ROWS)], np.uint64).view(np.int64))
                bytes_.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, others)), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64)),
                 pa.array(bytes_, pa.binary())], [*batch.schema.names, "set1", "set2", "keys", "fp", "sketch"])

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField("set1", T.LongType()), T.StructField("set2", T.LongType()),
                                               T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType()),
                                               T.StructField("sketch", T.BinaryType())]))


def _with_sets(bodies: DataFrame, words: int) -> DataFrame:
    """node, sketch and own, the set of shingles, of bodies (node, sketch, text)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["node", "sketch", "own"])

    return bodies.select("node", "sketch", "text").mapInArrow(task, "node long, sketch binary, own binary")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, name: str) -> DataFrame:
    """The rows a, b of pairs, a table, whose texts (columns node, text) are similar. A text in very many pairs is dealt
    over several tasks."""
    joined = join_split(pairs, texts.toDF("a", "left"), ["a"], ["b"])
    joined = join_split(materialize(joined, f"{name}-left"), texts.toDF("b", "right"), ["b"], ["a"]).select("a", "b", "left", "right")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            a, b, lefts, rights = (c.to_pylist() for c in batch.columns)
            keep = []
            for x, y, s, t in zip(a, b, lefts, rights):  # rows come by b, so its set is made once
                if last != y:
                    last, other = y, shingles(t, words)
                keep.append(similar(shingles(s, words), other, least))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return materialize(joined.mapInArrow(task, "a long, b long"), name)


def _apart(members: DataFrame, budget: int, group_rows: int, least: float) -> DataFrame:
    """Links a, b of similar sets in each group (key) of members (key, node, root, fp, sketch, own), a table, whose roots differ:
    at most one a member, which join what they connect.

    The trie self-join of a group's fingerprints proposes pairs within budget bits; those whose minima agree as often as
    similar sets' do are decided at once by the sets, own, and a link prunes the walk further. A group of over group_rows, or
    whose sets take over GROUP_BYTES, is cut into parts, and each two parts meet in a task, so no task holds more than
    two parts of a group.
    """
    bytes_ = F.sum(F.octet_length("own"))
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / group_rows, bytes_ / F.lit(GROUP_BYTES))).cast("int").alias("parts"))
    large = sizes.filter("parts > 1")  # a row for so many rows or bytes of members at least, so that members stay where they are
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("node"), parts)
    dealt = members.join(F.broadcast(large), "key", "left").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp", "node", "root", "sketch", "own")
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")

    def links(key, p, q, fp, node, root, sketch, own) -> pa.RecordBatch:
        change = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        edges = np.concatenate([[0], change, [len(key)]]).astype(np.int64)
        values = fp.view(np.uint64) ^ np.uint64(1 << 63)  # in the order in which Spark sorts longs
        known = np.unique(root, return_inverse=True)[1].astype(np.int64)  # members of one root, in whichever group
        up = list(range(len(known)))
        out: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def found(i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
            before = len(out)
            for at in range(0, len(i), 1 << 17):
                x, y = i[at:at + (1 << 17)], j[at:at + (1 << 17)]
                alike = (sketch[x] == sketch[y]).sum(axis=1) >= LEAST_MINIMA
                for a, b in zip(x[alike].tolist(), y[alike].tolist()):
                    s, t = top(known[a]), top(known[b])
                    if s != t and similar(np.frombuffer(own[a], np.uint64), np.frombuffer(own[b], np.uint64), least):
                        up[max(s, t)] = min(s, t)
                        out.append((a, b))
            return np.array([top(x) for x in range(len(up))])[known] if len(out) > before else None

        if len(values) > 1:
            trie_walk(values, budget, edges, known, found)
        a, b = node[[x for x, _ in out]], node[[y for _, y in out]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = np.empty(batch.num_rows, object)
            sets[:] = batch.column(7).to_pylist()
            cols = [*(c.to_numpy() for c in batch.columns[:6]), np.array([np.frombuffer(x, np.uint8) for x in batch.column(6).to_pylist()]), sets]
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            size += sum(map(len, sets))
            if len(held[0]) < group_rows and size < GROUP_BYTES:
                continue
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            if len(change):  # all but the last group are whole
                yield links(*(x[:change[-1]] for x in held))
                held = [x[change[-1]:] for x in held]
                size = sum(map(len, held[7]))
        if held and len(held[0]):
            yield links(*held)

    return dealt.mapInArrow(task, "a long, b long")


def _roots(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (any table with a node) with root, the least node that edges lead to."""
    found = components(edges, "near-components")
    return members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(docs: DataFrame, words: int = WORDS, least: float = LEAST, budget: int = BUDGET, group_rows: int = GROUP_ROWS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, that of the least id (null last); of rows that share it, one stays.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of least or more, and a group is what
    chains of them connect. Rows of equal sets, by two hashes, are one node, known by its first row. Nodes that share a band of least hashes make up a group. First each
    is held against one node of each of its bands, so that a large group of near copies is linked without pairing it
    with itself; then the trie self-join of the SimHash fingerprints proposes the pairs within budget bits that are
    not linked yet, of which those go on whose least hashes agree as often as near copies' do. Each proposed pair is
    decided by its sets, whose members are 64-bit hashes. Null text counts as empty; all texts without words are one
    group. Repeated rows are copies. Columns keep their names and values, whatever they are called. An empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no column of docs can clash with ours
    text, key = plain[docs.columns.index(text_col)], plain[docs.columns.index(id_col)]
    with scratch(docs.sparkSession) as keep:  # what is written on the way goes before the rows are shuffled
        rows = docs.toDF(*plain).withColumn(text, F.col(text).cast("string"))
        rows = keep(materialize(_sketches(rows, words, text).withColumn("row", F.monotonically_increasing_id()), "near-texts"))
        first = rows.groupBy("set1", "set2").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "row")).alias("first"))
        first = materialize(first.select(F.col("first.row").alias("node"), "first"), "near-nodes")
        alone = rows.select(F.col("row").alias("node"), "keys", "fp").join(first.select("node"), "node", "left_semi")
        bands = materialize(alone.select("node", "fp", F.explode("keys").alias("key")), "near-keys")
        shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node")).alias("hub")).filter("n > 1")
        bands = materialize(join_split(bands, shared.select("key", F.col("hub.node").alias("hub")), ["key"], ["node"]), "near-bands")
        near = bands.select("node").distinct()
        bodies = rows.select(F.col("row").alias("node"), F.col(text).alias("text"), "sketch").join(near, "node", "left_semi")
        bodies = materialize(bodies, "near-bodies")
        texts = bodies.select("node", "text")

        tried = bands.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        tried = materialize(tried, "near-pairs")
        edges = _verified(tried, texts, words, least, "near-edges")
        placed = materialize(_roots(bands.select("node", "key", "fp"), edges), "near-placed")
        split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        mixed = materialize(join_split(placed, split, ["key"], ["node"]).select("key", "node", "root", "fp"), "near-mixed")
        sets = _with_sets(bodies.join(mixed.select("node").distinct(), "node", "left_semi"), words)
        mixed = materialize(mixed.join(sets, "node").select("key", "node", "root", "fp", "sketch", "own"), "near-sets")
        edges = edges.unionByName(materialize(_apart(mixed, budget, group_rows, least), "near-edges"))

        kept = _roots(first, edges).groupBy("root").agg(F.min("first").alias("first"))
        kept = keep(materialize(kept.select(F.col("first.row").alias("row")), "near-kept"))
    return rows.join(kept, "row", "left_semi").select(*plain).toDF(*docs.columns)
