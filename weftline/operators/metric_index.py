"""Exact nearest neighbours within a distance, by balls around pivots.

Vectors of length 1 at most lie in balls: each belongs to its nearest pivot, a ball's radius is the distance of its
furthest vector. Two vectors with 1 - <x, y> under a threshold t are at a distance of at most sqrt(2 t) from each other, so
a vector meets only the balls whose pivot is nearer than their radius and that. Balls over a block's size are dealt to blocks,
which meet two by two. A pair of vectors meets once. Where balls rule out little, as in many dimensions, rows are packed into
blocks, and all blocks meet two by two in a Cartesian product, which moves packed bytes and writes none of the meetings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import materialised

#: Vectors of a block; a task holds two blocks.
BLOCK = 2048
#: Pivots at most: a sample by hash. With more vectors, balls hold more blocks.
PIVOTS = 1024
#: With more visits than this share of all possible ones, blocks meet without balls.
MANY_VISITS = 1 / 8


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def balls(rows: DataFrame, most: int = PIVOTS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (id, vector) with their ball and distance `far` from its pivot, the pivots, and the radii. `most` vectors reach the driver at most."""
    k = max(1, min(most, -(-rows.count() // (BLOCK // 4))))
    pivots = np.array([r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(k).select("vector").collect()], dtype=float)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            far = _apart(_vectors(batch.column(1)), shared.value)
            own = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(far[np.arange(len(own)), own], pa.float64())], names=["id", "vector", "ball", "far"])

    placed = materialised(rows.select("id", "vector").mapInArrow(run, "id long, vector array<double>, ball int, far double"))
    radii = np.full(k, -np.inf)
    for r in placed.groupBy("ball").agg(F.max("far").alias("radius")).collect():
        radii[r.ball] = r.radius
    return placed, pivots, radii


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a block at most: a row has a number for each pivot."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _met(batch: pa.RecordBatch, pivots: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """For each row (id, vector, ball) and ball whether they meet."""
    own = batch.column(2).to_numpy(zero_copy_only=False)
    able = _apart(_vectors(batch.column(1)), pivots) <= radii + reach + 1e-6  # squares of near vectors cancel to some 1e-8
    able &= np.arange(len(pivots)) <= own[:, None]
    able[np.arange(len(own)), own] = True
    return able


def meetings(placed: DataFrame, pivots: np.ndarray, radii: np.ndarray, reach: float) -> DataFrame:
    """(ball, visits, id, vector): each row in its own ball, and as a visitor in the earlier balls that may hold a row within reach."""
    shared = placed.sparkSession.sparkContext.broadcast((pivots, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            own = batch.column(2).to_numpy(zero_copy_only=False)
            row, ball = np.nonzero(_met(batch, *shared.value, reach))
            # A row may meet every ball: what leaves at one time is a block at most.
            for at in range(0, len(row), BLOCK):
                r, b = row[at : at + BLOCK], ball[at : at + BLOCK]
                taken = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(b != own[r]), taken.column(0), taken.column(1)], names=["ball", "visits", "id", "vector"])

    return placed.select("id", "vector", "ball").mapInArrow(run, "ball int, visits boolean, id long, vector array<double>")


def visit_count(placed: DataFrame, pivots: np.ndarray, radii: np.ndarray, reach: float) -> int:
    """How many visitors `meetings` has."""
    shared = placed.sparkSession.sparkContext.broadcast((pivots, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(_met(batch, *shared.value, reach).sum()) - batch.num_rows for batch in _parts(batches))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return placed.select("id", "vector", "ball").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def block_pairs(met: DataFrame) -> DataFrame:
    """(grp, half, id, vector): of each ball its own blocks two by two, and each with each block of visitors. half: 0 and 1 of two blocks, 2 of one with itself."""
    met = materialised(met.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")))
    sizes = met.groupBy("ball").agg(F.ceil(F.sum((~F.col("visits")).cast("int")) / BLOCK).cast("int").alias("own"), F.ceil(F.sum(F.col("visits").cast("int")) / BLOCK).cast("int").alias("other"))
    dealt = met.join(materialised(sizes), "ball")
    at = F.col("part") % F.when(F.col("visits"), F.col("other")).otherwise(F.col("own"))
    group = lambda i, j, kind, half: F.struct(F.xxhash64("ball", i, j, F.lit(kind)).alias("grp"), half.cast("int").alias("half"))
    inside = lambda i: F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda j: group(F.least(i, j), F.greatest(i, j), "own", F.when(i == j, 2).otherwise((i > j).cast("int"))))
    none = F.array().cast("array<struct<grp: bigint, half: int>>")
    outside = F.when(F.col("other") > 0, F.transform(F.sequence(F.lit(0), F.greatest("other", F.lit(1)) - 1), lambda j: group(F.col("at"), j, "visits", F.lit(0)))).otherwise(none)
    visiting = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: group(i, F.col("at"), "visits", F.lit(1)))
    groups = F.when(F.col("visits"), visiting).otherwise(F.concat(inside(F.col("at")), outside))
    return dealt.withColumn("at", at.cast("int")).select(F.explode(groups).alias("g"), "id", "vector").select("g.grp", "g.half", "id", "vector")


def _nearest(v: np.ndarray, ids: np.ndarray, w: np.ndarray | None, others: np.ndarray, threshold: float, decimals: int) -> pd.DataFrame:
    """(id, other, d): the nearest under the threshold of each row of two blocks in the other one, or within one (w None). Blocks are sorted by id."""
    # Single precision tells which rows can have a distance under the threshold; only their distances are measured.
    v32 = v.astype(np.float32)
    close = v32 @ (v32 if w is None else w.astype(np.float32)).T > 1 - threshold - (v.shape[1] + 2) * 2.0**-21
    if w is None:
        np.fill_diagonal(close, False)
    r, c = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if w is None:
        r = c = np.union1d(r, c)
    if not len(r):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "d": np.zeros(0)})
    d = np.round(1 - v[r] @ (v if w is None else w)[c].T, decimals)
    if w is None:
        np.fill_diagonal(d, np.inf)
        # One value for both directions, so that two rows agree about their distance.
        d = np.minimum(d, d.T)
    out = []
    for m, a, b in ((d, ids[r], others[c]), (d.T, others[c], ids[r])):
        to = m.argmin(axis=1)
        least = m[np.arange(len(a)), to]
        near = least < threshold
        out.append(pd.DataFrame({"id": a[near], "other": b[to[near]], "d": least[near]}))
        if w is None:
            break
    return pd.concat(out)


def _by_balls(placed: DataFrame, pivots: np.ndarray, radii: np.ndarray, threshold: float, decimals: int) -> DataFrame:
    """(id, other, d) of rows that meet in balls."""
    dealt = block_pairs(meetings(placed, pivots, radii, _reach(threshold)))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        v, ids, half = np.array(frame["vector"].tolist(), dtype=float), frame["id"].to_numpy(), frame["half"].to_numpy()
        if half[0] == 2:
            return _nearest(v, ids, None, ids, threshold, decimals)
        one, two = half == 0, half == 1
        return _nearest(v[one], ids[one], v[two], ids[two], threshold, decimals) if one.any() and two.any() else _nearest(v[:0], ids[:0], None, ids[:0], threshold, decimals)

    return dealt.groupBy("grp").applyInPandas(best, "id long, other long, d double")


def _by_blocks(rows: DataFrame, n: int, threshold: float, decimals: int) -> DataFrame:
    """(id, other, d) of all n rows (id, vector), which meet in blocks."""

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        return pd.DataFrame({"block": frame["block"].iloc[:1], "ids": [frame["id"].to_numpy().tobytes()], "vectors": [np.array(frame["vector"].tolist(), dtype=float).tobytes()]})

    count = -(-n // BLOCK)
    dealt = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"))
    blocks = materialised(dealt.groupBy("block").applyInPandas(packed, "block int, ids binary, vectors binary"))
    # A task pairs two parts of some blocks each; with few blocks, parts are smaller, so that all cores have some.
    parts = max(-(-count // 8), min(count, int(np.ceil(np.sqrt(3 * rows.sparkSession.sparkContext.defaultParallelism)))))
    one = blocks.repartition(parts, "block")
    two = blocks.select(*[F.col(c).alias(f"{c}2") for c in blocks.columns]).repartition(parts, "block2")
    pairs = one.join(two.hint("shuffle_replicate_nl"), F.col("block") <= F.col("block2")).select("block", "ids", "vectors", "block2", "ids2", "vectors2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, vectors, block2, ids2, vectors2 = (batch.column(j)[i] for j in range(6))
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (ids, ids2))
                v, w = (np.frombuffer(x.as_buffer(), dtype=float).reshape(len(y), -1) for x, y in ((vectors, a), (vectors2, b)))
                yield pa.RecordBatch.from_pandas(_nearest(v, a, None if block == block2 else w, b, threshold, decimals), preserve_index=False)

    return pairs.mapInArrow(run, "id long, other long, d double")


def _reach(threshold: float) -> float:
    return float(np.sqrt(2 * max(threshold, 0)))


def nearest_under(rows: DataFrame, threshold: float, decimals: int = 12) -> DataFrame:
    """(id, other, d): of rows (id long, vector of length 1 at most) the nearest other row with d = 1 - <x, y> under the threshold; ties to the least id. Rows without one are left out."""
    placed, pivots, radii = balls(rows.select("id", F.col("vector").cast("array<double>").alias("vector")))
    n = placed.count()
    if visit_count(placed, pivots, radii, _reach(threshold)) > MANY_VISITS * n * (len(pivots) - 1) / 2:
        found = _by_blocks(placed, n, threshold, decimals)
    else:
        found = _by_balls(placed, pivots, radii, threshold, decimals)
    return found.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.other", "m.d")
