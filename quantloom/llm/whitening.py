"""Whitening of embeddings: principal components by Chebyshev-filtered subspace iteration over distributed passes.

The covariance is never formed. A pass multiplies it with a block of vectors, task by task: each adds up Xᵀ(XQ) over its
own centred rows. A Chebyshev polynomial of the covariance, made by its recurrence from such passes, damps what lies between
zero and the least Ritz value of the block and lets the rest grow; QR and Rayleigh-Ritz turn the block into components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, table

COMPONENTS = 32
#: Vectors that the block has beside the components, so that the last of these stand apart from what is damped.
GUARD = 16
DEGREE = 8
#: Residual, in parts of the greatest eigenvalue, below which a component counts as found.
TOLERANCE = 1e-13
ROUNDS = 60
#: Eigenvalues under this part of the greatest one are zero: no scale makes such a direction white.
NO_VARIANCE = 1e-12
SCALE, SHIFT = 64, 1_000_000
BLOCK_VALUES = 1 << 18
#: Partial sums that the driver adds up itself; beyond it, tasks add them up in groups first.
DIRECT = 64
LIMIT = 1 << 62


def steps(v: np.ndarray) -> np.ndarray:
    """Whole steps of 1/64, moved up by a million; what no 64-bit integer holds ends at the limit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(v * SCALE)
    return np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT


def finite(col: str) -> F.Column:
    v = F.col(col)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def blocks_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows width, ids, x: some thousands of vectors of one length, their whole numbers row by row as 64-bit integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(finite("v") & (F.size("v") > 0))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                for at in range(0, len(own), max(1, BLOCK_VALUES // int(width))):
                    take = pa.array(own[at:at + max(1, BLOCK_VALUES // int(width))])
                    flat = vectors.take(take).flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(width)], pa.int32()), pa.array([ids.take(take).to_pylist()], pa.list_(pa.int64())), pa.array([steps(flat).tobytes()], pa.binary())],
                        ["width", "ids", "x"])

    return materialize(rows.mapInArrow(task, "width int, ids array<long>, x binary"), "whitening-blocks")


class Pass:
    """Passes over the blocks of one length; a pass sums an array over all rows."""

    def __init__(self, blocks: DataFrame, width: int) -> None:
        self.width, self.blocks = width, blocks.filter(F.col("width") == width).select("x")
        self.parts = self.blocks.rdd.getNumPartitions()
        fits = self.sum(counted, exact=True)
        self.n, self.sums = int(fits[0]), [int(s) for s in fits[1:]]

    def sum(self, of: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
        """The sum of `of` over blocks of rows: whole numbers of any size where exact, else doubles."""
        width, kind = self.width, object if exact else np.float64
        pack = (lambda a: pa.array([",".join(map(str, a))], pa.string())) if exact else (lambda a: pa.array([a.tobytes()], pa.binary()))
        load = (lambda s: np.array([int(i) for i in s.split(",")], object)) if exact else (lambda b: np.frombuffer(b, np.float64))
        out = "string" if exact else "binary"

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column(0):
                    own = np.asarray(of(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, width)), kind).ravel()
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pack(total)], ["part", "total"])

        def add(group: pa.Table) -> pa.Table:
            return pa.table({"part": pa.array([0], pa.int32()), "total": pack(sum(map(load, group.column("total").to_pylist())))})

        sums = self.blocks.mapInArrow(task, f"part int, total {out}")
        if self.parts > DIRECT:
            sums = sums.groupBy(F.col("part") % isqrt(self.parts)).applyInArrow(add, f"part int, total {out}")
        return sum(load(row["total"]) for row in sums.orderBy("part").collect())

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows less the mean, from whole numbers: (n x - S) / n."""
        n, sums = self.n, self.sums
        return lambda x: spread(x, n, sums).astype(np.float64) / n

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q."""
        centre, n = self.centred(), self.n

        def of(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return y.T @ (y @ q)

        return self.sum(of).reshape(q.shape) / n

    def trace(self) -> float:
        centre = self.centred()
        return float(self.sum(lambda x: np.array([np.square(centre(x)).sum()]))[0]) / self.n


def counted(x: np.ndarray) -> np.ndarray:
    """The number of rows, then the sum of each column, exactly."""
    narrow = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < LIMIT
    return np.array([len(x), *(int(s) for s in x.sum(axis=0, dtype=np.int64 if narrow else object))], object)


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as 64-bit integers where they fit."""
    if n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) < LIMIT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the matrix on q that stays within one on [0, cut], divided by its value at top."""
    half = cut / 2
    sigma = first = half / (top - half)
    before, now = q, (times(q) - half * q) * (sigma / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def ritz(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors, and the norms of their residuals, from one pass."""
    q, _ = np.linalg.qr(block)
    image = times(q)
    inner = q.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def components(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, degree: int = DEGREE, guard: int = GUARD, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` greatest eigenvalues of a positive semidefinite matrix that is known by its products, and their unit vectors.

    Each round filters the block and takes Ritz vectors, until the residuals of all wanted ones, and so their distance from
    eigenvalues, are under TOLERANCE of the greatest. Random vectors orthogonal to the block are then filtered against
    the last wanted value: an eigenvalue above it that the block had missed would grow in them, and they join the block
    if one does. Where rounding stops the residuals short of TOLERANCE, the best block so far counts.
    """
    wanted, size = min(wanted, width), min(wanted + guard, width)
    draw = np.random.default_rng(seed)
    values, vectors, left = ritz(times, draw.standard_normal((width, size)))
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        top = values[0]
        worst = left[:wanted].max() / top if top > 0 else 0.0
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        if size == width or worst <= TOLERANCE or (stalled > 3 and worst < 1e-11):
            if size == width or top <= 0:
                break
            fresh = draw.standard_normal((width, min(4, width - size)))
            fresh, _ = np.linalg.qr(fresh - vectors @ (vectors.T @ fresh))
            cut = values[wanted - 1]
            if cut > NO_VARIANCE * top:
                grown = filtered(times, fresh, degree, cut, top)
                fresh, _ = np.linalg.qr(grown - vectors @ (vectors.T @ grown))
            if ritz(times, fresh)[0][0] <= max(cut, 0) * (1 + 1e-9) + NO_VARIANCE * top:
                break
            vectors, best = np.concatenate([vectors[:, :size - fresh.shape[1]], fresh], axis=1), np.inf
        cut = values[-1]
        block = filtered(times, vectors, degree, cut, top) if cut > NO_VARIANCE * top else times(vectors)
        values, vectors, left = ritz(times, block)
    else:
        raise ArithmeticError(f"components not found in {ROUNDS} rounds: residual {best:.3g} of the greatest eigenvalue")
    kept = values[:wanted] > NO_VARIANCE * max(values[0], 0)
    return values[:wanted][kept], vectors[:, :wanted][:, kept]


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows vec_id, component, n, deviation, whitened, explained, identity_error: each vector on each component, a row each.

    Vectors become whole numbers, steps of 1/64, and every sum that centres them is exact. Vectors that are null, empty or hold
    null or non-finite components are dropped. Each length of vectors is whitened on its own, over all its vectors,
    repeated rows, repeated ids and null ids among them. Components of no variance are left out, so equal vectors, or a
    single one, give no rows, as does an empty table. A deviation that no 64-bit integer holds is null.

    Passes read blocks of vectors that are written once. Through the driver go sums of one number a dimension, and one
    block of `wanted` and GUARD vectors, of which tasks get a copy; partial sums of many tasks are added up in groups.
    """
    spark = vectors.sparkSession
    blocks = blocks_of(vectors, id_col, vec_col)
    out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for (width,) in sorted(blocks.select("width").distinct().collect()):
        over = Pass(blocks, width)
        trace = over.trace()
        if trace > 0:
            out = out.unionAll(_projected(blocks, over, trace, *components(over.times, width, wanted)))
    return out


def _projected(blocks: DataFrame, over: Pass, trace: float, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    width, n, sums, centre, shape = over.width, over.n, over.sums, over.centred(), vectors / np.sqrt(values)

    def inner(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ shape
        return z.T @ z

    error = float(np.abs(over.sum(inner).reshape(len(values), -1) / n - np.eye(len(values))).max())
    count, explained = len(values), values / trace

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1)):
                x, ids = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, width), ids.values
                apart = spread(x, n, sums)
                if apart.dtype == object or int(np.abs(apart).max()) ** 2 * width >= LIMIT:
                    far = [d if d < 1 << 63 else None for d in (sum(int(a) ** 2 for a in row) for row in apart)]
                else:
                    far = np.square(apart).sum(axis=1)
                each = pa.array(np.repeat(np.arange(len(x)), count))
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * count, n)),
                    pa.array(far, pa.int64()).take(each), pa.array((centre(x) @ shape).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * count, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.filter(F.col("width") == width).select("ids", "x").mapInArrow(
        task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
