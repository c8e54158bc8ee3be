import hashlib
import math

import numpy as np
import pytest

from weftline.llm.block_kmeans import Nearest, clustered, segment_norms


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    """The rows of the result by measuring all distances in Python's whole numbers."""
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]
    for last in [False] * rounds + [True]:
        own = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
            own.append((min(d), d.index(min(d))))
        if not last:
            for j in range(len(centroids)):
                mine = [x for (_, x), (_, c) in zip(kept, own, strict=True) if c == j]
                if mine:
                    centroids[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    total = {j: sum(d for d, c in own if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, own, strict=True)), key=str)


def vectors(n, spread, seed=2):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(20, 64))
    x = centres[rnd.integers(0, 20, n)] + spread * rnd.normal(size=(n, 64))
    return [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(x)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_against_all_distances(spark, spread):
    rows = vectors(400, spread)
    assert result(clustered(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))) == plain(rows)


@pytest.mark.parametrize(("spread", "most"), [(0.1, 0.65), (0.5, 0.97)])
def test_screening_is_exact_and_saves_distances(spread, most):
    x = np.floor(64 * np.array([v for _, v in vectors(2000, spread)])).astype(np.int64)
    c = x[:16]
    origin = c.sum(axis=0) // 16
    nearest = Nearest(c, origin)
    j, d = nearest(x, segment_norms(x - origin).astype(np.float32))
    full = ((x[:, None, :] - c) ** 2).sum(axis=2)
    assert (d == full.min(axis=1)).all() and (j == full.argmin(axis=1)).all()
    assert nearest.measured < most * full.size


def test_large_components_and_odd_segments():
    rnd = np.random.default_rng(5)
    x = rnd.integers(-(1 << 27), 1 << 27, (300, 10))
    x[100:200] = x[:100] + rnd.integers(-2, 3, (100, 10))
    nearest = Nearest(x[:40], x[0], segment=4)
    j, d = nearest(x, segment_norms(x - x[0], 4).astype(np.float32))
    full = ((x[:, None, :] - x[:40]) ** 2).sum(axis=2)
    assert (d == full.min(axis=1)).all() and (j == full.argmin(axis=1)).all()


def test_odd_and_empty_tables(spark):
    rows = vectors(40, 0.5)
    tie = [0.25] * 64
    odd = [*rows, rows[0], (3, tie), (3, tie), (50, tie), (None, tie), (60, None), (61, []), (62, [0.5] * 63), (63, [0.5] * 65), (64, [None] + tie[1:]), (65, [float("nan")] + tie[1:]), (66, [float("inf")] + tie[1:]), (67, [-0.0] * 64)]
    frame = spark.createDataFrame([(*r, 0) for r in odd], SCHEMA).selectExpr("*", "'x' AS cluster", "'x' AS x", "'x' AS norms", "'x' AS distance", "'x' AS key")
    assert result(clustered(frame)) == plain(odd)
    assert result(clustered(frame.limit(0))) == []
    few = [(1, tie), (2, [0.5] * 64), (3, [0.25] * 64)]
    assert result(clustered(spark.createDataFrame([(*r, 0) for r in few], SCHEMA))) == plain(few)
