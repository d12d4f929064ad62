"""Line dedup: winnowed line hashes find repeated runs of lines, of which the first stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import WORD, join_split, materialize, scratch, small_batches, table

MIN_LINES = 3
LONG_WORDS = 50
SIZE_MIX = 0x9E3779B97F4A7C15


def line_hashes(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The lines of a text, the places of those that aren't blank, and two hashes of these without outer white space, of 64
    and of 32 bits."""
    lines = (text or "").split("\n")
    bare = [x.strip(" \t\r\v\f") for x in lines]
    at = [i for i, x in enumerate(bare) if x]
    raw = [bare[i].encode() for i in at]
    return lines, np.array(at, np.int64), np.array([*map(xxhash.xxh64_intdigest, raw)], np.uint64), np.array([*map(xxhash.xxh32_intdigest, raw)], np.uint32)


def winnow(hashes: np.ndarray, window: int, weights: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints of a sequence: place, first window, number of windows in a row that chose it.

    Each window of consecutive hashes chooses its least one, the first of equals, and a place is given once for all the
    windows that choose it. Equal windows choose equal places, so a run that two documents share leaves a common
    fingerprint for certain. With weights, windows of a lesser sum than least choose nothing.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    starts = np.arange(n)
    chosen = np.argmin(np.lib.stride_tricks.sliding_window_view(hashes, window), axis=1) + starts
    if weights is not None:
        sums = np.concatenate([[0], np.cumsum(weights)])
        starts = starts[sums[window:] - sums[:-window] >= least]
        chosen = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    return chosen[head], starts[head], np.diff(np.append(head, len(starts)))


def may_be_long(lengths: list[int], lines: int, words: int) -> bool:
    """Whether so many lines in a row have the characters that so many words and the blanks between them take at least."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    lines = min(lines, len(lengths))
    return lines > 0 and int((ends[lines:] - ends[:-lines]).max()) >= 2 * words - lines


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text",
                drop_emptied: bool = False, long_words: int | None = None) -> DataFrame:
    """docs with text_col cleaned, and line_dedup_removed, the number of lines deleted.

    A run of at least min_lines lines, blank ones aside, that has stood earlier, in an earlier document or further up in
    the same one, is deleted; documents are in ascending order of the id, null last, and of those that share an id in
    order of a hash of the text. What a run repeats is judged on the input. In winnowing, the least line hash of each
    window of min_lines lines is a fingerprint, and each fingerprint comes once, with the hashes of the lines about it.
    Fingerprints that occur once end here. The others are joined by their hash and extended line by line both ways, as
    far as the windows that chose them go; each place of an extended stretch but the first is deleted, and stretches that
    overlap make up the whole run. No pair of places is formed: counts and least places combine before the shuffle, and
    the joins on a line or stretch that is very common are split over tasks.

    With long_words, a run of fewer lines is deleted too if it holds so many words: windows of fewer lines with
    long_words words or more choose fingerprints of their own, beside those of min_lines lines, and take the same way.

    Blank lines never match and stay. Null texts stay null and remove nothing; empty and short texts stay as they are.
    Repeated rows, with equal or different or null ids, are copies, of which the first stays. With drop_emptied,
    documents of which only white space is left are left out. A stretch is known by two hashes of its lines. A column of docs by the new name is replaced. An empty table gives no
    rows.
    """
    docs = docs.drop("line_dedup_removed")
    small_batches(docs.sparkSession)
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no column of docs can clash with ours
    text, key = docs.columns.index(text_col), plain[docs.columns.index(id_col)]
    rows = docs.toDF(*plain).withColumn(plain[text], F.col(plain[text]).cast("string"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "line-texts")
    slim = rows.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(plain[text]).alias("tie"), "row",
                       F.col(plain[text]).alias("text"))
    names, kinds = ["id", "tie", "row", "start", "size", "mark", "lines", "checks"], [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32())]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, tie, row, body in zip(*(c.to_pylist() for c in batch.columns)):
                lines, at, hashes, checks = line_hashes(body)
                signed, checks = hashes.view(np.int64).tolist(), checks.view(np.int32).tolist()
                words, sizes = None, (min_lines,)
                if long_words and len(body or "") >= 2 * long_words - min_lines and may_be_long([len(lines[i]) for i in at], min_lines - 1, long_words):
                    words, sizes = np.array([len(lines[i].encode().split()) for i in at]), range(1, min_lines + 1)
                for size in sizes:
                    own = np.uint64(0 if size == min_lines else size * SIZE_MIX & (1 << 64) - 1)  # sizes don't count as partners
                    place, first, many = winnow(hashes, size) if size == min_lines else winnow(hashes, size, words, long_words)
                    for values, got in zip(out, ([doc] * len(place), [tie] * len(place), [row] * len(place), first.tolist(), [size] * len(place),
                                                 (hashes[place] ^ own).view(np.int64).tolist(),
                                                 *([x[a:a + n + size - 1] for a, n in zip(first.tolist(), many.tolist())] for x in (signed, checks)))):
                        values += got
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    with scratch(docs.sparkSession) as keep:  # what is written on the way goes before the rows are shuffled
        places = slim.mapInArrow(fingerprints, "id long, tie long, row long, start long, size long, mark long, lines array<bigint>, checks array<int>")
        places = materialize(places, "line-places")
        marks = places.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
        near = join_split(places, marks, ["mark"], ["row", "start"])
        part = lambda c, k: F.slice(c, k + 1, F.col("size").cast("int"))
        windows = F.transform(F.sequence(F.lit(0), F.size("lines") - F.col("size").cast("int")), lambda k: F.struct(
            (F.col("start") + k).alias("start"), F.xxhash64("mark", part("lines", k)).alias("stretch"), F.xxhash64(part("checks", k), part("lines", k)).alias("check")))
        grown = near.select("id", "tie", "row", "size", F.explode(windows).alias("w")).select("id", "tie", "row", "w.start", "size", "w.stretch", "w.check")
        grown = materialize(grown, "line-stretches")
        place = F.struct("id", "tie", "row", "start")
        firsts = grown.groupBy("stretch", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("stretch", "check", "first")
        later = join_split(grown, firsts, ["stretch", "check"], ["row", "start"]).filter(place != F.col("first"))
        cut = keep(materialize(later.groupBy("row").agg(F.collect_list(F.struct("start", "size")).alias("cut")), "line-cut"))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, gone = [], []
            for body, runs in zip(batch.column(text).to_pylist(), batch.column(len(plain)).to_pylist()):
                if not runs:
                    bodies.append(body)
                    gone.append(0)
                    continue
                lines, at, *_ = line_hashes(body)
                hit = np.zeros(len(at) + 1, np.int64)
                np.add.at(hit, [r["start"] for r in runs], 1)
                np.add.at(hit, [r["start"] + r["size"] for r in runs], -1)
                drop = set(at[np.cumsum(hit[:-1]) > 0].tolist())
                left = [x for i, x in enumerate(lines) if i not in drop]
                bodies.append("\n".join(left))
                gone.append(len(drop))
            columns = [*batch.columns[: len(plain)]]
            columns[text] = pa.array(bodies, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], [*plain, "gone"])

    joined = rows.join(cut, "row", "left").select(*plain, "cut")
    schema = T.StructType([f for f in joined.schema.fields if f.name != "cut"] + [T.StructField("gone", T.LongType())])
    out = joined.mapInArrow(delete, schema)
    if drop_emptied:
        out = out.filter((F.col("gone") == 0) | F.col(plain[text]).rlike(WORD))
    return out.toDF(*docs.columns, "line_dedup_removed")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, long_words=LONG_WORDS).select(
        "doc_id", F.col("line_dedup_removed").alias("lines_removed"), F.length("text").cast("long").alias("chars_kept"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS k FROM documents),
split AS (
  SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
filled AS (
  SELECT k, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM split
  WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM filled),
windows AS (
  SELECT k, r, 3 AS size, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS body
  FROM placed WINDOW d AS (PARTITION BY k ORDER BY r)
  UNION ALL
  SELECT k, r, 1, line FROM placed WHERE words >= 50
  UNION ALL
  SELECT k, r, 2, CASE WHEN words + lead(words) OVER d >= 50 THEN line || chr(10) || lead(line) OVER d END
  FROM placed WINDOW d AS (PARTITION BY k ORDER BY r)),
later AS (
  SELECT k, r, size FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY k, r) AS copy FROM windows WHERE body IS NOT NULL)
  WHERE copy > 1),
cut AS (SELECT DISTINCT k, r + t.j AS r FROM later, (VALUES (0), (1), (2)) t(j) WHERE t.j < size),
gone AS (SELECT p.k, p.i FROM placed p JOIN cut USING (k, r)),
kept AS (
  SELECT s.k, string_agg(s.line, chr(10) ORDER BY s.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS lines_removed
  FROM split s LEFT JOIN gone g ON s.k = g.k AND s.i = g.i GROUP BY s.k)
SELECT d.doc_id, coalesce(lines_removed, 0)::BIGINT AS lines_removed,
       CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.text, ''))::BIGINT END AS chars_kept,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM docs d LEFT JOIN kept k USING (k)
"""
