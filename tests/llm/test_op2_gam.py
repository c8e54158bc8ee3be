import zlib

import numpy as np

from weftline.llm.gam import FEATURES, features, fit, quality_scores


def test_pairs_are_learned():
    """A product of two signs cannot be a sum of tables; the grids find it."""
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(FEATURES)))
    x[:, :3] = rng.normal(size=(4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (1, 0) in model.pairs


def test_scores_are_table_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(FEATURES)))
    y = (x[:, 2] > 0).astype(float)
    m = fit(x, y)
    i = 7
    total = m.base + sum(t[np.searchsorted(e, x[i, j], side="right")] for j, (t, e) in enumerate(zip(m.tables, m.edges)))
    for (a, b), g in zip(m.pairs, m.grids):
        total += g[np.searchsorted(m.coarse[a], x[i, a], side="right"), np.searchsorted(m.coarse[b], x[i, b], side="right")]
    assert np.isclose(total, m.raw(x)[i])


def test_constant_without_labels():
    assert fit(np.zeros((0, len(FEATURES))), np.zeros(0)).score(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]
    assert (fit(np.zeros((5, len(FEATURES))), np.ones(5)).score(np.zeros((1, len(FEATURES)))) > 0.8).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, "good words here " * 5 if i % 2 else "### $$$ %%%") for i in range(60)], "doc_id long, text string")
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    flip = lambda f: quality_scores(docs, spark.createDataFrame([(i, (i % 2) ^ (f and i in held)) for i in range(60)], "doc_id long, quality int")).select("doc_id", "score").collect()
    assert sorted(flip(False)) == sorted(flip(True))


def test_odd_and_empty_tables(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality_scores(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(empty, labels).count() == 0
    none = quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_features_of_nothing_are_zero():
    assert not features([None, b""]).any()


def test_the_sample_is_the_same_in_every_run(spark):
    """More rows of one id than the sample takes, dealt in different ways."""
    from pyspark.sql import functions as F

    from weftline.llm.gam import training_rows

    rows = spark.range(4000).select((F.col("id") % 3 + 1).alias("doc_id"), F.array(F.lit(0).cast("float"), F.col("id").cast("float")).alias("features"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    taken = [training_rows(rows.repartition(n, F.col("features")[1]), labels, "quality", most=100) for n in (1, 5, 16)]
    assert len(taken[0][1]) == 200 and all((x == taken[0][0]).all() and (y == taken[0][1]).all() for x, y in taken)
