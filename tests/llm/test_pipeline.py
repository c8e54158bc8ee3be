"""The pipeline's stages on a small corpus with planted cases, on odd rows, and near-duplicate classes against all pairs."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.conftest import DOCUMENTS  # noqa: E402
from weftline.llm import near  # noqa: E402


def prose(rnd, n):
    return "\n".join(" ".join("".join(rnd.choice("aeioutnsrl") for _ in range(rnd.randrange(2, 9))) for _ in range(15)) for _ in range(n))


def edited(rnd, text, n):
    w = text.split(" ")
    for i in rnd.sample(range(len(w)), n):
        w[i] = "edit" + str(rnd.randrange(1000))
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(8)
    clean = [prose(rnd, 10) for _ in range(30)]
    item = prose(rnd, 2)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    add = lambda k, t: rows.append((k, t, "en", "s0", len(t)))
    for k in range(5):
        add(100 + k, clean[k])  # exact
        add(110 + k, clean[k + 5].upper() + "  ")  # equal in words
        add(120 + k, edited(rnd, clean[k + 10], 2))  # near
        add(130 + k, prose(rnd, 3) + "\n" + item.upper() + "\n" + prose(rnd, 3))  # benchmark
        add(140 + k, "junk junk junk junk junk " * 30)  # repeats
        add(150 + k, prose(rnd, 4) + f"\nwrite to a.b{k}@mail.example.com or call +1 (017) 555-771{k}")  # personal
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(rnd, 2))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), dict((r[0], r[1]) for r in rows)


def test_planted_cases(spark, corpus):
    d, texts = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        from weftline.llm.common import written

        docs = written(stage(spark, docs, d))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "personal_data":
            changed = {r.doc_id: r.text for r in docs.collect()}
    clean, copies, leaks, junk, personal = range(30), range(100, 125), range(130, 135), range(140, 145), range(150, 155)
    assert kept["quality_rules"] == set(texts) - set(junk)
    assert kept["near_dedup"] == set(clean) | set(leaks) | set(personal)
    assert kept["decontamination"] == kept["personal_data"] == kept["tokens"] == set(clean) | set(personal)
    assert not kept["near_dedup"] & set(copies)
    for k in personal:
        assert "mail.example" not in changed[k] and "555-771" not in changed[k]
        assert changed[k].rsplit("\n", 1)[0] == texts[k].rsplit("\n", 1)[0]
    assert all(changed[k] == texts[k] for k in clean)


def test_tokens_are_the_librarys(spark, corpus):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    d, texts = corpus
    rows = corpus_pipeline.run(spark, d).collect()
    assert len(rows) == 35
    assert all(r.token_ids == lib.encode(texts[r.doc_id], add_eos=True) for r in rows if r.doc_id < 30)


def jaccard_classes(texts, k, least):
    sets = [{" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := t.lower().split()) else set() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("bucket", [512, 4])
def test_near_classes_against_all_pairs(spark, monkeypatch, bucket):
    """Copies with one or with many edits; with a small BUCKET, keys are made longer and blocks compared."""
    monkeypatch.setattr(near, "BUCKET", bucket)
    rnd = random.Random(3)
    base = [prose(rnd, 10) for _ in range(25)]
    texts = base + [edited(rnd, base[k % 8], 1) for k in range(40)] + [edited(rnd, base[8 + k % 8], 40) for k in range(20)] + ["", " ", "two words", "TWO words"]
    got = near.near_classes(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), ["i"]).collect()
    by = {r.i: r.root for r in got}
    first = {}
    mine = [first.setdefault(by[i], i) for i in range(len(texts))]
    assert mine == jaccard_classes(texts, 5, 0.8)


def crowded():
    """An original, copies of it with three edits, and texts with nine, which are 0.8 to 0.85 similar to the original and to few of the copies."""
    rnd = random.Random(5)
    base = prose(rnd, 30)
    return [base] + [edited(rnd, base, 3) for _ in range(80)] + [edited(rnd, base, 9) for _ in range(30)]


def classes_of(spark, texts):
    by = {r.i: r.root for r in near.near_classes(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), ["i"]).collect()}
    first = {}
    return [first.setdefault(by[i], i) for i in range(len(texts))]


def test_pairs_near_the_similarity_in_crowded_buckets(spark, monkeypatch):
    """Longer keys part such pairs; the comparison of the classes then known finds them."""
    monkeypatch.setattr(near, "BUCKET", 8)
    texts = crowded()
    assert classes_of(spark, texts) == jaccard_classes(texts, 5, 0.8)


def test_edges_of_a_forest_that_fail_their_comparison(spark):
    """In a bucket over PAIRED the best estimate of such a text may be a copy under the similarity; the original is compared too."""
    texts = crowded()
    assert classes_of(spark, texts) == jaccard_classes(texts, 5, 0.8)


def family(rnd, n, shared=240, own=45):
    """Different texts that share most of their words: five-word shingle similarity of about 0.72; and for each tenth one a text at about 0.84."""
    common = [f"c{rnd.randrange(10**6)}" for _ in range(shared)]
    texts = [" ".join([*common, *[f"w{rnd.randrange(10**9)}" for _ in range(own)]]) for _ in range(n)]
    return texts + [" ".join([*t.split()[:-25], *[f"x{rnd.randrange(10**9)}" for _ in range(25)]]) for t in texts[::10]]


def test_alike_texts_under_the_similarity_stay_apart(spark):
    """SimHash and min-wise hashes bring thousands of such texts together; only the planted pairs are linked, each of them."""
    n = 2000
    got = classes_of(spark, family(random.Random(4), n))
    assert len(set(got)) == n and got[n:] == list(range(0, n, 10))


@pytest.mark.parametrize("sides", [1, 2])
def test_connecting_links_all_that_is_similar(sides):
    rnd = random.Random(6)
    base = [rnd.sample(range(1000), 40) for _ in range(4)]
    sets = [sorted(set(rnd.choice(base)) ^ set(rnd.sample(range(1000), rnd.randrange(8)))) for _ in range(60)]
    side = [i % sides for i in range(60)]
    found = near.connecting(side, list(range(60)), list(range(60)), sets, 0.8)
    similar = [(i, j) for j in range(60) for i in range(j) if (sides == 1 or side[i] != side[j]) and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]

    def parts(edges):
        root = list(range(60))
        for _ in range(60):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert set(found) <= set(similar) and parts(found) == parts(similar) and len(found) == 60 - len(set(parts(similar)))


def test_odd_and_empty_tables(spark, odd, empty, odd_rows, tmp_path):
    spark.createDataFrame([(None, None), (1, ""), (2, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert len(rows) <= docs.count()
            if name == "near_dedup" and docs is odd:  # lines with and without a last word are one class, those without words another
                assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "6", "7", "8", "9"]
            if name in ("decontamination", "personal_data", "tokens"):
                assert len(rows) == docs.count()
    docs = spark.createDataFrame(odd_rows, DOCUMENTS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2
