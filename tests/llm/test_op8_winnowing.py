import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import winnowing
from weftline.llm.common import Words
from weftline.llm.winnowing import TABLE, Index, Scan, contamination, kept_hashes

W = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(text, items):
    w, hit, found = W(text), set(), set()
    for i, t in items:
        x = W(t)
        n = min(8, len(x))
        wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
        for j in range(len(w) - n + 1 if n else 0):
            if tuple(w[j : j + n]) in wins:
                hit |= set(range(j, j + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def sample(seed, vocabulary=6):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice("abcdefgh"[:vocabulary]) + rnd.choice(["", ".", ",", "\n", "É"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(12)]
    docs = []
    for _ in range(40):
        t = text(rnd.randrange(60))
        if rnd.random() < 0.5:
            t = f"{t} {rnd.choice(items)[1].upper()} {text(5)}"
        docs.append(t)
    return items, docs


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 6, 8]))
def test_scan_against_all_windows(seed, vocabulary):
    items, docs = sample(seed, vocabulary)
    n, spans, found, _ = Scan(Index([(str(i), t.encode()) for i, t in items]))([d.encode() for d in docs])
    for k, d in enumerate(docs):
        hit = {p for s, m in spans[k] for p in range(s, s + m)}
        assert (n[k], len(hit), sorted(found[k])) == plain(d, items)


def test_winnowing_keeps_a_hash_of_every_window():
    rnd = random.Random(4)
    a = [f"w{rnd.randrange(50)}" for _ in range(3000)]
    at, _ = kept_hashes(Words([" ".join(a).encode()], TABLE))
    assert all(any(p <= x <= p + 3 for x in at) for p in range(0, len(a) - 8, 7))
    assert len(at) < 0.5 * len(a)


def test_query_by_broadcast_and_by_join(spark, monkeypatch):
    items, docs = sample(11)
    more, others = sample(12, 8)
    items, docs = [*items, *[(100 + i, t) for i, t in more]], [*docs, *others, None, ""]
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([*items, (None, "a b c"), (99, None), items[5]], "item_id long, text string")
    long = []
    for block, bits in ((1 << 20, 1 << 27), (30, 1 << 27), (30, 64)):
        monkeypatch.setattr(winnowing, "BLOCK_BYTES", block)
        monkeypatch.setattr(winnowing, "FILTER_BITS", bits)
        rows = contamination(d, b, ["doc_id"]).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert (r.n_words, r.n_hit, r.item_ids) == plain(docs[r.doc_id], items) and r.n_items == len(r.item_ids)
            assert r.n_hit == sum(r.hit_spans[1::2]) - sum(r.hit_spans[0::2])
        long.append(sorted((r.doc_id, r.n_long_items, str(r.hit_spans)) for r in rows))
    assert long[0] == long[1] == long[2]


def test_odd_and_empty_tables(spark, odd, empty, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[0][1].split("\n")[2])], "item_id long, text string")
    rows = contamination(odd, items, ["doc_id", "n_words"]).collect()
    assert len(rows) == len(odd_rows) and sum(r.n_hit == 12 for r in rows) == 4
    assert {r.n_hit for r in contamination(odd, items.limit(0), ["doc_id"]).collect()} == {0}
    assert contamination(empty, items, ["doc_id"]).count() == 0


def test_a_phrase_of_very_many_items(spark, monkeypatch):
    """Eight words that 3,000 items share meet a document once for each of their surroundings, not once for each item."""
    monkeypatch.setattr(winnowing, "BLOCK_BYTES", 30)
    phrase = "all of these words are in every item"
    items = [(i, f"{'one' if i % 2 else 'two'} {phrase} {'x' if i % 3 else 'y'}") for i in range(3000)]
    docs = [f"one {phrase} y", f"{phrase}", f"{phrase[4:]} alone", "nothing"] + [f"d{i} {phrase} z" for i in range(50)]
    rows = contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids) == plain(docs[r.doc_id], items)
    assert {r.n_items for r in rows} == {0, 3000}
