import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.importance import Buckets, Shift, ranked, resampled


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) by writing out every feature."""
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10_000)) / ((s[b] + 1) * (t.total() + 10_000))))
    out, able = [], []
    for i, (d, x) in enumerate(docs):
        words, own = features(x)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            able.append(i)
    for k, i in enumerate(sorted(able, key=lambda i: (-out[i][3], -1 if out[i][0] is None else out[i][0]))[: 5 * len(able) // 100]):
        out[i][4] = k + 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB9é漢 .\n", max_size=60) | st.none(), max_size=6))
def test_composed_crcs(texts):
    found = Buckets([None if t is None else t.encode() for t in texts], Shift())
    got = [[] for _ in texts]
    for own, at in found.parts:
        for b, i in zip(own.tolist(), at.tolist(), strict=True):
            got[i].append(b)
    assert [sorted(g) for g in got] == [sorted(map(bucket, features(t)[1])) for t in texts]


def test_shifts_of_any_length():
    shift = Shift()
    lengths = [0, 1, 2, 3, 255, 256, 65_537, 1_000_003]
    left, right = b"left part", bytes(range(256))
    for n in lengths:
        tail = (right * (n // 256 + 1))[:n]
        got = shift(np.array([zlib.crc32(left)], dtype=np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(tail))
        assert int(got) == zlib.crc32(left + tail)


def texts(n):
    rnd = np.random.default_rng(4)
    return [(i, " ".join(f"w{k}" for k in rnd.integers(0, 200, rnd.integers(0, 60)))) for i in range(n)]


def test_against_plain_loops(spark):
    docs, target = texts(300), [" ".join(f"w{k}" for k in range(i, i + 30)) for i in range(20)]
    docs += [(300, None), (301, "Ä" * 5000 + " x"), (302, docs[5][1]), (303, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = resampled(frame, spark.createDataFrame([(x,) for x in target], "text string")).drop("n_words").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain(docs, target)), key=lambda r: r[0])


def test_ranks_of_ties_over_many_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), F.when(F.col("id") % 11 > 0, F.col("id") % 900).alias("tie"), F.col("id").alias("row"))
    top, last = ranked(rows, 1700, "score", "tie", "row")
    want = sorted(rows.collect(), key=lambda r: (-r.score, -1 if r.tie is None else r.tie, r.row))[:1700]
    assert [(r.row, r["rank"]) for r in top.orderBy("rank").collect()] == [(r.row, k + 1) for k, r in enumerate(want)]
    assert last == (want[-1].score, want[-1].tie, want[-1].row)


def test_odd_and_empty_tables(spark, odd, empty, odd_rows):
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = resampled(odd, target).drop("n_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain([(r[0], r[1]) for r in odd_rows], ["w1 w2 w3", None])), key=str)
    assert resampled(empty, target).count() == 0
    none = resampled(spark.createDataFrame(texts(40), "doc_id long, text string"), target.limit(0)).drop("n_words").collect()
    assert sorted(map(tuple, none)) == sorted(map(tuple, plain(texts(40), [])), key=lambda r: r[0])


def test_one_id_of_many_rows_is_drawn_whole(spark):
    """A null id, and one id of a third of all rows: the ranks are still 1, 2, 3, ..."""
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(["a b c d e"] * 5)) for i in range(200)]
    got = resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 200
