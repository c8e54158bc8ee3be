import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.simhash import BITS, fingerprint, links, masks, simhash_classes


def plain(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(prints, radius):
    """Least reachable index of each, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbBéÉ漢 \t\n\x0b\xa0\x1c", max_size=60))
def test_fingerprints(text):
    assert fingerprint(text.encode(), 3) % (1 << 64) == plain(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [1, 2])
def test_masks_cover(radius):
    """Any `radius` bits are all left out by some mask."""
    m = [x % (1 << 64) for x in masks(radius)]
    assert len(m) == (1 << radius + 1) - 1
    for i in range(BITS):
        for j in range(i if radius == 2 else i, i + 1 if radius == 1 else BITS):
            assert any(not x & (1 << i | 1 << j) for x in m)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("crowded", [False, True])
def test_links_connect_as_all_pairs_do(spark, radius, crowded):
    """Crowded: hundreds of fingerprints around one, so that buckets are large and centres are used."""
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(3 if crowded else 60)]
    prints = set(base)
    for b in base:
        for _ in range(150 if crowded else 3):
            x = b
            for _ in range(rnd.randrange(1, 5)):
                x ^= 1 << rnd.randrange(12 if crowded else 64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius).collect()
    at = {s: i for i, s in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in got:
        assert (prints[at[a]] ^ prints[at[b]]).bit_count() <= radius
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == classes(prints, radius)


def test_query_against_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 8))) for _ in range(60)]
    texts = base + [t.upper() for t in base[:20]] + [t + "  " for t in base[:20]] + [" ".join(t.split()[:-1]) for t in base[:20]]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in simhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes([plain(t) for t in texts], 2)
    assert [got[i].component_id for i in range(len(texts))] == want and all(got[i].fingerprint == f"{plain(t):016x}" for i, t in rows)


def test_odd_and_empty_tables(odd, empty, odd_rows):
    got = simhash_classes(odd).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
    assert by["0" * 16] == {3}  # null, empty and blank texts, a null id among them
    assert simhash_classes(empty).count() == 0
