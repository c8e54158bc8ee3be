"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features, and fits each time one shallow tree over one
feature's bins (later: over a pair's grid) to the loss gradient; its steps are added to that feature's table.
A score is the sum of one table entry a feature and a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, Words, byte_table, map_texts, written

#: Labelled rows that a fit uses at most, on the driver (8 * features bytes each). Scores are made for every document.
FIT_ROWS = 40_000
BINS, GRID, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAVES = 120, 60, 0.15, 1.0, 4
FEATURES = (
    "log_words", "log_bytes_a_word", "symbols", "pipes", "upper", "digits", "exclaims", "stops", "commas", "quotes", "non_ascii", "lines_a_word",
    "distinct_words", "top_word", "twins", "byte_entropy", "short_words", "long_words", "repeated_lines",
)
TABLE = byte_table(SPACES, lower=False)


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; a null or empty text has zeros."""
    words = Words(texts, TABLE)
    n = np.diff(words.first)
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    length = words.ends - words.starts
    same = np.concatenate(([False], (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1]))) if len(words.hashes) else np.zeros(0, dtype=bool)
    for i, t in enumerate(texts):
        if not t:
            continue
        a, b = words.first[i], words.first[i + 1]
        w = max(1, int(n[i]))
        c = np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256)
        size = len(t)
        p = c[c > 0] / size
        times = np.unique(words.hashes[a:b], return_counts=True)[1]
        own = length[a:b]
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i] = (
            np.log1p(n[i]), np.log1p(own.sum() / w), c[[35, 36, 37, 38, 42]].sum() / w, c[124] / w, c[65:91].sum() / max(1, c[65:91].sum() + c[97:123].sum()),
            c[48:58].sum() / size, c[33] / w, c[46] / w, c[44] / w, c[34] / w, c[128:].sum() / size, len(lines) / w,
            len(times) / w, (times.max() if len(times) else 0) / w, same[a:b].sum() / w, -(p * np.log2(p)).sum(), (own <= 3).sum() / w, (own >= 12).sum() / w,
            1 - len(set(lines)) / max(1, len(lines)),
        )
    return out


class Model:
    """Bin edges, lookup tables of features and of pairs, and the intercept."""

    def __init__(self, edges: list[np.ndarray], base: float) -> None:
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.coarse = [e[np.linspace(0, len(e) - 1, min(GRID - 1, len(e))).astype(int)] if len(e) else e for e in edges]
        self.grids: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            total += g[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps by bin of a tree of LEAVES leaves over ordered bins with gradients g and curvatures h: the best split of any leaf, again and again."""
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-6, None, None)
        for a, b in leaves:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = (G[cut] - G[a]) ** 2 / (H[cut] - H[a] + RIDGE) + (G[b] - G[cut]) ** 2 / (H[b] - H[cut] + RIDGE) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps of a tree over a grid: the best cut of the rows, and in either part the best cut of the columns; its gain."""
    G, H = np.cumsum(np.cumsum(np.pad(g, ((1, 0), (1, 0))), 0), 1), np.cumsum(np.cumsum(np.pad(h, ((1, 0), (1, 0))), 0), 1)
    m, n = g.shape
    box = lambda r0, r1, c0, c1: (G[r1, c1] - G[r0, c1] - G[r1, c0] + G[r0, c0], H[r1, c1] - H[r0, c1] - H[r1, c0] + H[r0, c0])
    worth = lambda x: x[0] ** 2 / (x[1] + RIDGE)
    best = (-1.0, None)
    for r in range(1, m):
        gain, cuts = 0.0, []
        for r0, r1 in ((0, r), (r, m)):
            k = max(range(1, n), key=lambda c: worth(box(r0, r1, 0, c)) + worth(box(r0, r1, c, n)), default=n)  # noqa: B023
            cuts += [(r0, r1, 0, k), (r0, r1, k, n)]
        gain = sum(worth(box(*c)) for c in cuts if c[2] < c[3])
        if gain > best[0]:
            best = (gain, cuts)
    out = np.zeros_like(g)
    for c in best[1] or []:
        if c[2] < c[3]:
            x = box(*c)
            out[c[0] : c[1], c[2] : c[3]] = x[0] / (x[1] + RIDGE)
    return out, best[0] - worth(box(0, m, 0, n))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x with labels y in {0, 1}. Without rows, or with one label only, its score is a constant."""
    if not len(y):
        return Model([np.zeros(0)] * len(FEATURES), 0.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middles = (values[1:] + values[:-1]) / 2
        edges.append(middles if len(middles) < BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    model = Model(edges, float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    b = model.bins(x)
    f = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _tree(np.bincount(b[:, j], y - p, len(table)), np.bincount(b[:, j], p * (1 - p), len(table)))
            table += step
            f += step[b[:, j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        m, n = shape(i, j)
        return np.bincount(coarse[i] * n + coarse[j], v, m * n).reshape(m, n)

    p = 1 / (1 + np.exp(-f))
    gains = {(i, j): _grid_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)))[1] for i in range(len(edges)) for j in range(i)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.grids = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _grid_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)))[0]
            grid += step
            f += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(rows: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about `most` labelled rows that are not held out, picked by a hash of doc_id, and of repeated ids twice as many at most, picked by a hash of id and features. A doc_id with several labels has their least."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"))
    n = known.count()
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most / max(1, n)))))
    # Where rows repeat ids there may be more: then those of the least hashes, so that every run takes the same ones.
    mine = F.xxhash64("doc_id", "features")
    got = rows.select("doc_id", "features").join(picked, "doc_id").orderBy(mine, "doc_id", "features").limit(2 * most).orderBy("doc_id", "features").toPandas()
    if not len(got):
        return np.zeros((0, len(FEATURES)), dtype=np.float32), np.zeros(0)
    return np.array(got["features"].tolist(), dtype=np.float32), got["y"].to_numpy(dtype=float)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Texts are read once; their features (a few bytes a document) are written, joined with the labels to fit, and scored.
    Null and empty texts are scored from zero features, repeated rows alike; without labels each score is one half.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(map_texts(given, "text", ["doc_id"], "features array<float>", lambda: lambda texts: {"features": list(features(texts))}))
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(rows, labels, label)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = pa.array(model.value.score(x), type=pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), score], names=[b.schema.names[0], "score"])

    scored = rows.select("doc_id", "features").mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
