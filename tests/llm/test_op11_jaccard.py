import random
import re

import numpy as np
import pytest

from weftline.llm import metric_join
from weftline.llm.metric_join import Region, jaccard_classes, prefix_length


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows, percent=85):
    """{row number: (set size, least doc_id reachable)} by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return words


def corpus(seed, n):
    """Unrelated texts, families of near copies about the similarity, texts with one common passage, short texts."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for f in range(n):
        base = [f"f{rnd.randrange(10**5)}" for _ in range(rnd.randrange(20, 120))]
        texts += [base] + [edited(rnd, base, rnd.randrange(0, 5)) for _ in range(rnd.randrange(0, 12))]
        texts.append(base[: len(base) * 9 // 10])
        texts.append([f"u{rnd.randrange(10**5)}" for _ in range(rnd.randrange(5, 50))] + passage)
        texts.append([f"s{rnd.randrange(3)}" for _ in range(rnd.randrange(0, 5))])
    rnd.shuffle(texts)
    return [(1000 - i, " ".join(t)) for i, t in enumerate(texts)]


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_prefixes_of_linked_sets_meet():
    for n in range(1, 80):
        for m in range(n, 80):
            shared = next((k for k in range(n + 1) if 100 * k >= 85 * (n + m - k)), None)  # the least that links
            if shared is not None:
                assert prefix_length(np.array(n), 85) > n - shared and prefix_length(np.array(m), 85) > m - shared


@pytest.mark.parametrize("block", [metric_join.BLOCK, 8])
def test_against_all_pairs(spark, monkeypatch, block):
    """Small blocks: rings are dealt to several parts."""
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rows = corpus(3, 40)
    got = result(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(plain(rows), key=str)
    assert len({c for *_, c in got}) < len(rows) - 100


@pytest.mark.parametrize("seed", range(6))
def test_recursion_is_exact(seed):
    """A region of many families: links that connect just what all pairs connect, with fewer comparisons."""
    rnd = random.Random(seed)
    sets = []
    for _ in range(30):
        base = rnd.sample(range(10**6), rnd.randrange(30, 90))
        for _ in range(rnd.randrange(3, 10)):
            sets.append(np.array(sorted(set(base[rnd.randrange(0, 7) :]) | set(rnd.sample(range(10**6), rnd.randrange(0, 5)))), dtype=np.int64))
    n = len(sets)
    region = Region([0] * n, [0] * n, list(range(n)), list(range(n)), [0.5] * n, sets, 85)
    links = region.solve()
    full = Region([0] * n, [0] * n, list(range(n)), list(range(n)), [0.5] * n, sets, 85)
    full._leaf(np.arange(n), np.zeros((n, 1)))

    def classes(pairs):
        root = list(range(n))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert classes(links) == classes(full.links) and all(a != b for a, b in links)
    assert region.compared < n * n / 4


def test_images_never_part_what_links():
    """Counts of buckets are not further from each other than the sets."""
    rnd = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 400)).astype(np.uint64))
        y = np.unique(np.concatenate((x[: rnd.integers(0, len(x) + 1)], rnd.integers(0, 2**63, rnd.integers(1, 100)).astype(np.uint64))))
        i, j = metric_join._images([metric_join._image(x), metric_join._image(y)])
        shared = len(np.intersect1d(x, y))
        assert np.minimum(i, j).sum() >= shared and np.maximum(i, j).sum() <= len(x) + len(y) - shared


def test_a_large_family_and_a_common_passage(spark):
    """Hundreds of copies of one text that link to it and mostly not to each other, and a passage in hundreds of others."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rnd, base, 1 + i % 2))) for i in range(300)] + [(1000, " ".join(base))]
    rows += [(2000 + i, " ".join([f"o{rnd.randrange(10**6)}" for _ in range(70)] + base[:40])) for i in range(200)]
    assert result(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(plain(rows), key=str)


def test_odd_and_empty_tables(odd, empty, odd_rows):
    assert result(jaccard_classes(odd)) == sorted(plain([(r[0], r[1]) for r in odd_rows]), key=str)
    assert jaccard_classes(empty).count() == 0
