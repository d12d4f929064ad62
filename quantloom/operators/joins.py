"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are never split.
FEW = 1000


def spread_join(many: DataFrame, one: DataFrame, keys: Sequence[str], deal: Sequence[str], how: str = "inner") -> DataFrame:
    """many.join(one, keys, how), with the rows of a key that has more than half an average partition dealt over several tasks.

    Rows are dealt by a hash of the columns deal, and one's rows of such a key, few as there should be, go to each of its
    tasks. There are at most twice as many such keys as shuffle partitions; their list, which is broadcast, has that bound.
    many is read twice, so it should be a table or cheap. Null keys match nothing.
    """
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__key{i}" for i in range(len(keys))]
    counts = many.select(*(F.col(k).alias(n) for k, n in zip(keys, names))).groupBy(*names).agg(F.count(F.lit(1)).alias("__rows"))
    most = F.greatest(F.lit(FEW), F.ceil(F.col("__all") / (2 * parts)))
    hot = counts.crossJoin(F.broadcast(many.agg(F.count(F.lit(1)).alias("__all")))).filter(F.col("__rows") > most)
    hot = hot.select(*names, F.ceil(F.col("__rows") / most).cast("int").alias("__tasks"))

    def marked(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(hot), [side[k] == hot[n] for k, n in zip(keys, names)], "left").drop(*names)

    tasks = F.coalesce(F.col("__tasks"), F.lit(1))
    left = marked(many).withColumn("__task", F.pmod(F.xxhash64(*deal), tasks).cast("int")).drop("__tasks")
    right = marked(one).withColumn("__task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("__tasks")
    return left.join(right, [*keys, "__task"], how).drop("__task")
