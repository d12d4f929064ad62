"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, materialize, running, table

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKET_ROWS = 50_000
BROADCAST_ROWS = 100_000


def _fraction(text: Column) -> Column:
    """The first 24 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """sources (key, size, n) with target: all sizes shared by weight; what exceeds cap times a size goes to the others by
    weight, until none is above.

    Weights repeat along the keys in order, "null" last. Up to some source, in order of cap over weight, all are full;
    beyond it they share what is left. Running sums over the sources, which may be many, find where.
    """
    placed = running(sources, [(F.col("key") == "null").asc(), F.col("key").asc()], {"i": F.lit(1).cast("long")}, "mix-sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", F.col("size").cast("double") * cap)
    placed = running(placed, [(F.col("cap") / F.col("weight")).asc(), F.col("i").asc()], {"caps": "cap", "weights": "weight", "pos": F.lit(1).cast("long")}, "mix-caps")
    whole = placed.agg(F.sum("size").cast("double").alias("total"), F.sum("weight").alias("all"))
    share = (F.col("total") - F.col("caps")) / (F.col("all") - F.col("weights"))
    level = placed.crossJoin(F.broadcast(whole)).filter(F.col("cap") / F.col("weight") >= share).agg(F.min_by(share, "pos").alias("level"))
    return placed.crossJoin(F.broadcast(level)).select("key", "size", "n", F.least(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def split_buckets(dealt: DataFrame, bucket: Sequence[str], part: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """dealt with the part of its bucket, and the rows of each part as __mix_rows, a table.

    A bucket of up to twice bucket_rows is one part. One that is larger holds rows of one id and text, which no hash takes
    apart; its rows are dealt over parts in turn and written with their part, so that both readings of them agree. Which of
    equal rows falls into which part doesn't matter.
    """
    counts = materialize(dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__mix_rows")), "mix-buckets")
    whole = F.lit(0).cast("long")
    large = counts.filter(F.col("__mix_rows") > 2 * bucket_rows).select(*bucket, F.ceil(F.col("__mix_rows") / bucket_rows).alias("__mix_parts"))
    n = large.count()
    if not n:
        return dealt.withColumn(part, whole), counts.withColumn(part, whole)
    near = F.broadcast(large) if n <= BROADCAST_ROWS else large
    turn = F.monotonically_increasing_id() % F.col("__mix_parts")
    taken = materialize(dealt.join(near, [*bucket]).withColumn(part, turn).drop("__mix_parts"), "mix-large")
    rest = lambda df: df.join(near, [*bucket], "left_anti").withColumn(part, whole)
    parts = taken.groupBy(*bucket, part).agg(F.count(F.lit(1)).alias("__mix_rows"))
    return rest(dealt).unionByName(taken), rest(counts).unionByName(parts)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, bucket_rows: int = BUCKET_ROWS, seed: str = "",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Return docs with mix_size, mix_source_size, mix_target and mix_copies.

    Every document of a source has the same expected copies, target over source size. Their prefix sums run in a fixed
    order, and a document is taken once for each whole number that its step crosses after one offset per source, drawn
    by the seed and the source's name, is added. A source is cut into buckets of about bucket_rows by a hash of id and
    text, so a source that holds a third of all rows is many window groups; bucket totals carry the prefix sum on. Rows of one
    id and text that overfill a bucket are dealt over parts of it. Within a bucket or part the order is by size, downwards, with every second stretch of one step's length turned round (balanced
    systematic sampling), so that long documents are taken in proportion whatever the offset.

    Null text: size 0. Null source: a source of its own, sorted last. Null ids come first among equal sizes. Repeated
    rows count one by one; ties of size and id are in order of a hash of the text, so reruns agree. Columns of docs by
    the new names are replaced. An empty table gives no rows. Sources, however many, are handled as a table.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    key, bucket, part = "__mix_source", "__mix_bucket", "__mix_part"
    name = F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.withColumns({  # all that needs the text, so that it isn't shuffled where the result doesn't have it
        "__mix_tie": F.xxhash64(text), "__mix_deal": _fraction(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)),
        "mix_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long")),
        key: name,
    })
    found = sized.groupBy(F.col(key).alias("key")).agg(F.sum("mix_size").alias("size"), F.count(F.lit(1)).alias("n"))
    plan = water_fill(found, weights, cap).select(
        F.col("key").alias(key), F.col("size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("__mix_rate"), F.ceil(F.col("n") / bucket_rows).alias("__mix_buckets"),
        (_fraction(F.concat(F.lit(seed), F.col("key"))) / F.lit(16777216.0)).alias("__mix_offset"))
    plan = materialize(plan, "mix-plan")
    dealt = sized.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, key).withColumn(
        bucket, F.col("__mix_deal") % F.col("__mix_buckets"))
    dealt, counts = split_buckets(dealt, [key, bucket], part, bucket_rows)
    before = counts.withColumn(
        "__mix_before", F.sum("__mix_rows").over(Window.partitionBy(key).orderBy(bucket, part)) - F.col("__mix_rows"))
    at = F.row_number().over(Window.partitionBy(key, bucket, part).orderBy(F.desc("mix_size"), F.col(id_col).asc_nulls_first(), "__mix_tie"))
    rate = F.col("__mix_rate")
    fraction = rate - F.floor(rate)
    step = F.greatest(F.lit(1), F.when(fraction > 0, F.floor(1.0 / F.greatest(fraction, F.lit(1e-9)) + 0.5)).otherwise(1)).cast("long")
    ranked = dealt.join(before, [key, bucket, part]).withColumn("__mix_rank", at - 1).withColumn("__mix_step", step)
    rank, step, stretch = F.col("__mix_rank"), F.col("__mix_step"), F.floor(F.col("__mix_rank") / F.col("__mix_step"))
    turned = (stretch % 2 == 1) & ((stretch + 1) * step <= F.col("__mix_rows"))
    place = F.when(turned, (2 * stretch + 1) * step - 1 - rank).otherwise(rank)
    placed = ranked.withColumn("__mix_at", (F.col("__mix_before") + place + 1).cast("double"))
    upto = lambda n: F.floor(n * rate + F.col("__mix_offset"))
    placed = placed.withColumn("mix_copies", upto(F.col("__mix_at")) - upto(F.col("__mix_at") - 1.0))
    return placed.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 6))::BIGINT AS dealt,
         coalesce('s:' || source, 'null') AS k
  FROM documents),
src AS (
  SELECT k, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY k = 'null', k) - 1 AS i
  FROM sized GROUP BY k),
weighted AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS cap FROM src),
ranked AS (
  SELECT *, coalesce(sum(cap) OVER p, 0)::DOUBLE AS caps, coalesce(sum(w) OVER p, 0)::DOUBLE AS ws,
         row_number() OVER (ORDER BY cap / w, i) AS pos
  FROM weighted WINDOW p AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
whole AS (SELECT sum(source_size)::DOUBLE AS total, sum(w) AS weight FROM weighted),
level AS (
  SELECT min_by((total - caps) / (weight - ws), pos) AS level
  FROM ranked, whole WHERE cap / w >= (total - caps) / (weight - ws)),
plan AS (
  SELECT k, source_size, least(level * w, cap::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN least(level * w, cap::DOUBLE) / source_size ELSE 0.0 END AS rate,
         ((n + 49999) // 50000)::BIGINT AS buckets,
         ('0x' || substr(md5(k), 1, 6))::BIGINT / 16777216.0::DOUBLE AS shift
  FROM ranked, level),
dealt AS (
  SELECT s.doc_id, s.size, p.*, s.dealt % p.buckets AS bucket
  FROM sized s JOIN plan p USING (k)),
ranked_docs AS (
  SELECT *, row_number() OVER (PARTITION BY k, bucket ORDER BY size DESC, doc_id NULLS FIRST) - 1 AS r,
         count(*) OVER (PARTITION BY k, bucket) AS n_rows,
         (count(*) OVER (PARTITION BY k ORDER BY bucket)) - (count(*) OVER (PARTITION BY k, bucket)) AS before,
         CASE WHEN rate - floor(rate) > 0
              THEN greatest(1, floor(1.0 / greatest(rate - floor(rate), 1e-9) + 0.5))::BIGINT ELSE 1 END AS step
  FROM dealt),
placed AS (
  SELECT *, (before + 1 + CASE WHEN (r // step) % 2 = 1 AND (r // step + 1) * step <= n_rows
                               THEN (2 * (r // step) + 1) * step - 1 - r ELSE r END)::DOUBLE AS pos
  FROM ranked_docs)
SELECT doc_id, size, source_size, target,
       (size * (floor(pos * rate + shift) - floor((pos - 1.0) * rate + shift)))::BIGINT AS taken
FROM placed
"""
