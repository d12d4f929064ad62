"""State transitions: the old table and a change give the new table, each one shuffle on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.ranking import numbered_all


def merge_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new replace rows of old with their key; of rows of one side that share a key, one stays."""
    both = old.withColumn("__prio", F.lit(0)).unionByName(new.withColumn("__prio", F.lit(1)), allowMissingColumns=True)
    top = Window.partitionBy(*keys).orderBy(F.desc("__prio"), *[F.col(c).desc() for c in old.columns if c not in keys])
    return both.withColumn("__rn", F.row_number().over(top)).filter("__rn = 1").drop("__rn", "__prio")


def fill_nulls(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values that old lacks are taken from new; rows of new with other keys are added."""
    values = [c for c in old.columns if c not in keys]
    right = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in values))
    return old.join(right, list(keys), "full_outer").select(*keys, *(F.coalesce(c, f"__{c}").alias(c) for c in values))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """All rows of a parent that new mentions are replaced by its rows in new."""
    return delete_keys(old, new.select(*parent).distinct(), parent).unionByName(new)


def update_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values of rows that new mentions are set, to null too; other rows and values stay."""
    right = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in values), F.lit(True).alias("__said"))
    pick = lambda c: F.when(F.col("__said"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return old.join(right, list(keys), "left").select(*(pick(c) if c in values else c for c in old.columns))


def content_hash(*cols: str) -> Column:
    """SHA-256 of the values as canonical JSON: names in order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def versioned_upsert(current: DataFrame, versions: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The new current table and its versions: unchanged content is skipped, a version is kept once."""
    arrived = new.withColumn("content_hash", content_hash(*values))
    changed = arrived.join(current.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")
    added = changed.select(*versions.columns).join(versions.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")
    return merge_upsert(current, changed.select(*current.columns), keys), versions.unionByName(added.dropDuplicates([*keys, "content_hash"]))


def with_new_ids(existing: DataFrame, new: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """new with ids that go on from the greatest one in use, in order, by ranges."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    placed = numbered_all(new, [F.col(c).asc() for c in order], "__place")
    return placed.crossJoin(F.broadcast(top)).withColumn(id_col, F.col("__top") + F.col("__place")).drop("__top", "__place")


def fallback(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the first source, and of the second for keys that the first lacks."""
    return primary.unionByName(delete_keys(secondary, primary, keys))
