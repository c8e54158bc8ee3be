"""Base forms against the rules applied one by one."""

import random

from weftline.operators import standardize
from weftline.operators.lemmas import ENDINGS, lemmas
from weftline.sources import files


def plain(word, lexicon, exceptions):
    rules = lambda forms: [f[: len(f) - len(old)] + new for f in forms for old, new in ENDINGS if f.endswith(old)]
    if word in exceptions:
        hits = [f for f in [word, *exceptions[word]] if f in lexicon]
        return min(hits, key=len) if hits else word
    forms = rules([word])
    hits = [f for f in [word, *forms] if f in lexicon]
    while not hits and forms:
        forms = rules(forms)
        hits = [f for f in forms if f in lexicon]
    return min(hits, key=len) if hits else word


def made(rnd):
    return "".join(rnd.choice("abcefhimnsvxyz") for _ in range(rnd.randrange(1, 7)))


def test_a_large_lexicon(spark):
    rnd = random.Random(3)
    lexicon = {made(rnd) for _ in range(100_000)} - {""}
    words = {rnd.choice(["", made(rnd)]) + rnd.choice(["s", "ses", "ves", "ies", "men", "sss", "ssess", "ches", ""]) for _ in range(20_000)} | set(list(lexicon)[:3000]) | {"ssssssssss"}
    exceptions = {w: [made(rnd) for _ in range(rnd.randrange(1, 3))] for w in sorted(words)[::17]}
    flat = [(w, k, x) for w, own in exceptions.items() for k, x in enumerate(own)]
    got = lemmas(spark.createDataFrame([(w,) for w in words] + [(None,), ("a",)], "word string"), spark.createDataFrame([(w,) for w in lexicon], "word string"), spark.createDataFrame(flat, "word string, pos int, lemma string")).collect()
    assert {r.word: r.lemma for r in got} == {w: x for w in words | {"a"} if (x := plain(w, lexicon, exceptions)) != w}
    assert len(got) == len({r.word for r in got}) > 1000


def test_nodes_of_one_base_form_are_one(spark, tmp_path):
    (tmp_path / "index").write_text("  1 a note s\nheart n 1\nman n 2\nbody n 1\ngoose n 1\nbus n 1\n")
    (tmp_path / "exc").write_text("geese goose\nbodies body\n")
    lexicon = files.read_lexicon(spark, f"{tmp_path}/index", f"{tmp_path}/exc")
    rows = [(0, "s", "Hearts", "p", "heart"), (1, "s", "Men bodies", "p", "man-body"), (2, "s", "geese", "p", "Goose"), (3, "s", "buses", "p", "bus"), (4, "s", "unknowns", "p", " ")]
    g = spark.createDataFrame(rows, "pos long, sentence string, subject string, predicate string, object string")
    norm = {r.variant: r.norm for r in standardize.node_variants(g, lexicon).collect()}
    assert norm == {"Hearts": "heart", "heart": "heart", "Men bodies": "man body", "man-body": "man body", "geese": "goose", "Goose": "goose", "buses": "bus", "bus": "bus", "unknowns": "unknowns"}
    out = {r.pos: (r.subject, r.object) for r in standardize.canonical_nodes(g, spark.createDataFrame([(0, "HEARTS")], "pos long, term string"), lexicon).collect()}
    assert out[0] == ("HEARTS", "HEARTS") and out[1][0] == out[1][1] and out[4] == ("unknowns", " ")
