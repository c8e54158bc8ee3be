"""Centroid clustering in whole numbers, with block-norm screening.

A vector is cut into segments of SEGMENT components; the norms of its segments, computed once and stored beside it, are
its compressed form. By the Cauchy-Schwarz inequality in each segment |x - c|^2 >= |x|^2 + |c|^2 - 2 <norms of x, norms of c>.
The centroid with the least bound is measured first; of the others only those whose bound does not exceed the least
distance so far get an exact distance, in 64-bit integers. Bounds are lessened by more than their rounding, so the
result is that of all distances. To tell more, bounds are taken about a common origin (the mean of the centroids at the start).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, task, written

SEGMENT = 4
#: Vectors with a component over this count as not finite: squared distances then fit 64 bits (at 64 components of a scale of 64).
LARGEST = 1 << 21
#: Rows that one vectorised step works on.
ROWS = 8192
#: Bounds are lessened by this share of the squared norms, which is over the rounding of norms in single precision.
MARGIN = 1e-6


def prepared(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors of just `dims` finite components, each floor(scale * component)."""
    whole = F.transform(F.col(f"`{vector}`"), lambda v: F.floor(v.cast("double") * scale))
    fit = F.forall(F.col(f"`{vector}`"), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) <= LARGEST))
    kept = vectors.filter(F.col(f"`{vector}`").isNotNull() & (F.size(F.col(f"`{vector}`")) == dims) & F.coalesce(fit, F.lit(False)))
    return kept.select(F.col(f"`{vec_id}`").alias("vec_id"), whole.cast("array<int>").alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the least SHA-256 of `seed:vec_id` (a null id: nothing; ties: the smaller vector). k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r.x for r in found], dtype=np.int64)


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The norm of each segment of each row; the last segment may be shorter."""
    squares = x.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, x.shape[1], segment), axis=1))


class Nearest:
    """The nearest of some centroids to each of some vectors, exactly; `measured` counts exact distances."""

    def __init__(self, centroids: np.ndarray, origin: np.ndarray, segment: int = SEGMENT) -> None:
        self.centroids, self.measured = centroids, 0
        self.norms = segment_norms(centroids - origin, segment)
        self.square = (self.norms**2).sum(axis=1)

    def __call__(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid; of equal ones the smaller number."""
        norms = norms.astype(np.float64)
        square = (norms**2).sum(axis=1)
        total = square[:, None] + self.square
        low = total - 2 * (norms @ self.norms.T) - MARGIN * total
        best = low.argmin(axis=1)
        least = self._distance(x, best)
        self.measured += len(x)
        first = best.copy()
        for j in range(len(self.centroids)):
            at = np.flatnonzero((low[:, j] <= least) & (first != j))
            if len(at):
                d = self._distance(x[at], np.full(len(at), j))
                self.measured += len(at)
                nearer = (d < least[at]) | ((d == least[at]) & (j < best[at]))
                at, d = at[nearer], d[nearer]
                least[at], best[at] = d, j
        return best, least

    def _distance(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = x - self.centroids[j]
        return np.einsum("ij,ij->i", apart, apart)


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)


def compressed(rows: DataFrame, origin: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """(vec_id, x, norms): the vectors with the norms of their segments about the origin, in single precision."""
    small_batches(rows.sparkSession)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(__name__):
            for batch in batches:
                x = _matrix(batch.column(1), len(origin), np.int64)
                norms = segment_norms(x - origin, segment).astype(np.float32)
                own = pa.ListArray.from_arrays(np.arange(0, norms.size + 1, norms.shape[1], dtype=np.int32), pa.array(norms.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], names=["vec_id", "x", "norms"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, x array<int>, norms array<float>")


def _pass(rows: DataFrame, centroids: np.ndarray, origin: np.ndarray, segment: int, out: str, finish) -> DataFrame:
    """A pass over the vectors: finish(state, batch, x, number, distance) gives rows for each step, or for a task at its end (batch None)."""
    shared = rows.sparkSession.sparkContext.broadcast((centroids, origin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(__name__):
            c, o = shared.value
            nearest, state = Nearest(c, o, segment), {}
            for whole in batches:
                for lo in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(lo, ROWS)
                    x = _matrix(batch.column(1), c.shape[1], np.int64)
                    yield from finish(state, batch, x, *nearest(x, _matrix(batch.column(2), nearest.norms.shape[1], np.float32)))
            yield from finish(state, None, None, None, None)

    return rows.select("vec_id", "x", "norms").mapInArrow(run, out)


def sums(rows: DataFrame, centroids: np.ndarray, origin: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """(cluster, dim, total, n): the exact componentwise sums of each cluster's vectors. A task passes on one row for each cluster and component at most."""
    k, dims = centroids.shape

    def finish(state, batch, x, number, distance):
        if batch is not None:
            total, n = state.setdefault("sums", (np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)))
            for j in np.unique(number):
                own = number == j
                total[j] += x[own].sum(axis=0)
                n[j] += own.sum()
        elif "sums" in state:
            total, n = state["sums"]
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(at, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(at)), pa.int32()), pa.array(total[at].ravel(), pa.int64()), pa.array(np.repeat(n[at], dims), pa.int64())],
                names=["cluster", "dim", "total", "n"],
            )

    given = _pass(rows, centroids, origin, segment, "cluster int, dim int, total long, n long", finish)
    return given.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def assigned(rows: DataFrame, centroids: np.ndarray, origin: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def finish(state, batch, x, number, distance):
        if batch is not None:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return _pass(rows, centroids, origin, segment, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long", finish)


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, segment: int = SEGMENT) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or with a null, non-finite or too large component (LARGEST) are left out.
    Repeated rows and ids count each. Sums of distances over 64 bits fail with a message of Spark's. With fewer than k vectors there are fewer centroids, with none no rows. What
    reaches the driver are k vectors, and sums by cluster and component.
    """
    small_batches(vectors.sparkSession)
    rows = prepared(vectors, vec_id, vector, dims, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    origin = centroids.sum(axis=0) // len(centroids)
    rows = written(compressed(rows, origin, segment))
    for _ in range(rounds):
        new = centroids.copy()
        for r in sums(rows, centroids, origin, segment).collect():
            new[r.cluster, r.dim] = int(r.total) // r.n
        centroids = new
    found = written(assigned(rows, centroids, origin, segment))
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = vectors.sparkSession.createDataFrame([(j, inertia[j], sum(inertia.values()), digests[j]) for j in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
