"""Approximate nearest neighbours: a permutation index of ordered nearest pivots, footrule ranking, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, table

PIVOTS = 256
NEAREST = 64
ASKED = 32
BLOCK_ROWS = 16_384
QUERY_ROWS = 8192
SHARE = 0.2
TOP = 5
EVERY = 50


def scaled(vectors: list[list[float]]) -> np.ndarray:
    """Rows times the power of two that brings the greatest component near one: exact, and squares stay in range."""
    rows = np.array(vectors, np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """For each row the pivots (unit vectors) of greatest cosine, nearest first; of equals the one with the smaller number."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :nearest]


class PivotFile:
    """The inverted file of one block of rows: each pivot's posting list holds the rows that list it, and how early."""

    def __init__(self, lists: np.ndarray, pivots: int) -> None:
        self.rows, self.nearest = lists.shape
        order = np.argsort(lists, axis=None, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(lists.ravel(), minlength=pivots))])
        self.row = order // self.nearest
        self.early = (self.nearest - order % self.nearest).astype(np.int32)  # nearest minus place in the row's list

    def shared(self, wanted: np.ndarray) -> np.ndarray:
        """Of each row, how much a query's pivots lower the footrule distance from that of lists without a common pivot.

        A pivot at places i and j of the two lists lowers it by twice the lesser of nearest - i and nearest - j, so a
        greater sum is a smaller distance. Only the posting lists of the query's own pivots are read.
        """
        total = np.zeros(self.rows, np.int32)
        for place, pivot in enumerate(wanted):
            at = slice(self.ends[pivot], self.ends[pivot + 1])
            total[self.row[at]] += np.minimum(self.early[at], self.nearest - place)
        return total


def usable(col: str) -> F.Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    v = F.col(col)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, ok) & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """Rows v, members of rows (id, v): each vector once, with the top + 1 least ids that have it and how many rows each.

    That is all a search can need, as it leaves out one id; a vector that very many rows share is one row.
    """
    each = rows.groupBy("v", "id").agg(F.count(F.lit(1)).alias("n"))
    least = each.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= top + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(top)).alias("n")))).alias("members"))


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY, pivots: int = PIVOTS, nearest: int = NEAREST,
           asked: int = ASKED, share: float = SHARE, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows query_id, rank, vec_id, score: of each vector whose id divides by `every`, the `top` nearest by cosine.

    `pivots` vectors, the distinct ones of least hashes, are the pivots; this bounded sample is all that passes through
    the driver. Every vector is indexed: it is known by its `nearest` pivots in order, and each block of BLOCK_ROWS
    distinct vectors has an inverted file of posting lists by pivot, so the list of a pivot that very many rows are near
    to is split over all blocks. The stated set of queries meets every block in blocks of QUERY_ROWS. A query reads the
    posting lists of its first `asked` pivots, ranks the rows by the footrule distance that they add up to, and reranks the
    first `share` of a block, top + 1 at least, by exact cosine; the best `top` rows of a block go on to the final ranking.
    Scores are cosines of the original vectors in double precision, ties go to the smaller id.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components, take no part; vectors of
    another length than most pivots take none either. An id is queried once, with the first of its vectors in order; all
    rows with the query's id are left out before any ranking. Rows that share another id are separate candidates, also
    where their vectors are equal. With fewer candidates than `top`, all come. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable("v"))
    nodes = materialize(distinct_vectors(rows, top), "permutation-vectors")
    sample = nodes.select(F.xxhash64("v", F.lit(seed)).alias("h"), "v").orderBy("h", "v").limit(pivots).collect()
    widths = [len(r["v"]) for r in sample]
    width = max(set(widths), key=lambda w: (widths.count(w), w), default=0)
    centres = scaled([r["v"] for r in sample if len(r["v"]) == width] or [[1.0]])
    centres /= norms(centres)[:, None]
    nearest = min(nearest, len(centres))
    asked = min(asked, nearest)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = nearest_pivots(scaled(batch.column("v").to_pylist()), centres, nearest).astype(np.int16)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists), pa.list_(pa.int16()))], [*batch.schema.names, "pivots"])

    kind = "v array<double>, members array<struct<id:bigint,n:bigint>>, pivots array<smallint>"
    index = materialize(nodes.filter(F.size("v") == width).mapInArrow(listed, kind), "permutation-index")
    queries = rows.filter((F.col("id") % every == 0) & (F.size("v") == width)).groupBy("id").agg(F.min("v").alias("v"))
    queries = materialize(queries.mapInArrow(listed, "id long, v array<double>, pivots array<smallint>"), "permutation-queries")
    n_blocks, n_parts = max(1, -(-index.count() // BLOCK_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(n)).cast("int")
    posted = index.select(dealt("v", n_blocks).alias("block"), spread(n_parts).alias("part"), F.lit(None).cast("long").alias("query"), "v", "members", "pivots")
    wanted = queries.select(spread(n_blocks).alias("block"), dealt("id", n_parts).alias("part"), F.col("id").alias("query"), "v",
                            F.lit(None).cast("array<struct<id:bigint,n:bigint>>").alias("members"), "pivots")
    names = ["query_id", "vec_id", "score"]

    def meet(group: pa.Table) -> pa.Table:
        ask, rows = group.filter(pc.field("query").is_valid()), group.filter(pc.field("query").is_null())
        out: list[tuple] = []
        if ask.num_rows and rows.num_rows:
            vectors, members = scaled(rows.column("v").to_pylist()), rows.column("members").to_pylist()
            sizes, sole = norms(vectors), {}
            for k, ms in enumerate(members):
                if len(ms) == 1:  # no other id has this vector
                    sole.setdefault(ms[0]["id"], []).append(k)
            file = PivotFile(np.array(rows.column("pivots").to_pylist(), np.int64), len(centres))
            take = min(len(vectors), max(top + 1, int(np.ceil(share * len(vectors)))))
            for q, vector, own in zip(ask.column("query").to_pylist(), scaled(ask.column("v").to_pylist()), ask.column("pivots").to_pylist()):
                near = file.shared(own[:asked])
                near[sole.get(q, [])] = -1
                found = np.argpartition(-near, take - 1)[:take]
                found = found[near[found] >= 0]
                size = float(np.sqrt(vector @ vector))
                rough = vectors[found] @ vector / (sizes[found] * size)
                least = np.partition(rough, -top)[-top] if len(rough) > top else -2.0
                found = found[rough >= least - 1e-12]  # ties, and what the last digits may still change
                best = [(-float(np.dot(vectors[k], vector)) / (float(sizes[k]) * size), m["id"])
                        for k in found.tolist() for m in members[k] if m["id"] != q for _ in range(m["n"])]
                out += [(q, i, -s) for s, i in sorted(best)[:top]]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(names, cols, (pa.int64(), pa.int64(), pa.float64()))})

    near = posted.unionByName(wanted).groupBy("block", "part").applyInArrow(meet, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7_permutation_index(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
