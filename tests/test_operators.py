import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import clusters, merging, metric_index, ontology, retrieval, standardize, unmapped
from weftline.operators.models import FunctionCompleter, LetterCounts, called, completed, embedded, for_distinct
from weftline.sources import json_parts

KG = "pos long, sentence string, subject string, predicate string, object string"


def test_first_definition_wins(spark):
    rows = [(0, "STY", "x", "no", None), (1, "RL", "a ", " one ", "b"), (2, "RL", "b", "two", "a"), (3, "RL", "", "three", "c"), (4, "RL", "c", "four", None)]
    df = spark.createDataFrame(rows, "pos long, kind string, name string, def string, inverse string")
    assert dict(map(tuple, ontology.relation_definitions(df).collect())) == {"a": "one", "b": "one", "c": "three"}


def test_ontology_keeps_order_and_lone_predicates(spark, tmp_path):
    rows = [(2, "s2", "p", "o2"), (1, "s1", "p", "o1"), (3, "s", "a", "o"), (4, "s", None, "o")]
    table = ontology.ontology(spark.createDataFrame(rows, "pos long, subject string, predicate string, object string"), spark.createDataFrame([("p", "d")], "relation string, def string"))
    got = [(r.relation, r.rel_idx, r["def"], [t.s for t in r.triplets]) for r in table.orderBy("rel_idx").collect()]
    assert got == [("a", 0, "", ["s"]), ("p", 1, "d", ["s1", "s2"])]
    import json

    assert json.loads(ontology.keyed_json(table).first()[0]) == {"a": {"triplets": [["s", "a", "o"]], "def": ""}, "p": {"triplets": [["s1", "p", "o1"], ["s2", "p", "o2"]], "def": "d"}}
    ontology.write_keyed_json(table, f"{tmp_path}/keyed")
    assert "".join(open(p).read() for p in json_parts.parts_of(f"{tmp_path}/keyed")) == json.dumps(json.loads(ontology.keyed_json(table).first()[0]), indent=2)


@pytest.mark.parametrize("block", [10**6, 40])
def test_top_k_against_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", block)
    rng = np.random.default_rng(1)
    rel, q = rng.integers(-2, 3, (13, 6)).astype(float), rng.integers(-2, 3, (40, 6)).astype(float)
    rel[4], rel[9], q[0] = rel[2], rel[2], 0
    relations = spark.createDataFrame([(i, f"r{i}", v.tolist()) for i, v in enumerate(rel)], "rel_idx long, relation string, vector array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "id long, v array<double>")
    got = {r.id: [(f.relation, f.score) for f in r.found] for r in retrieval.top_k(rows, relations, "v", "vector", 4).collect()}
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = unit(q) @ unit(rel).T
    for i in range(40):
        assert [s for _, s in got[i]] == pytest.approx(sorted(sims[i], reverse=True)[:4])
        assert all(sims[i][int(r[1:])] == pytest.approx(s) for r, s in got[i])
    assert [s for _, s in got[99]] == [0.0] * 4 and [r for r, _ in got[0]] == ["r12", "r11", "r10", "r9"]
    assert retrieval.top_k(rows, relations.limit(0), "v", "vector", 4).filter("found is not null").count() == 0


def test_weighted_top_k_breaks_ties_by_order(spark):
    relations = spark.createDataFrame([(i, f"r{i}", [1.0, 0.0], [0.0, 1.0]) for i in range(3)] + [(3, "r3", [0.0, 1.0], [0.0, 1.0])], "rel_idx long, relation string, a array<double>, b array<double>")
    rows = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    found = retrieval.weighted_top_k(rows, relations, [("q", "a", 0.25), ("q", "b", 0.5)], 3).select(retrieval.top_candidates_column().alias("t")).first().t
    assert [(c.relation, c.similarity) for c in found] == [("r0", 0.25), ("r1", 0.25), ("r2", 0.25)]


def plain_root(term, mapping):
    seen, at = set(), term
    while at in mapping and mapping[at] != at and at not in seen:
        seen.add(at)
        at = mapping[at]
    return at


def test_alias_roots(spark):
    rnd = random.Random(2)
    given_ = {"t": "a", "a": "b", "b": "a", "x": "y", "y": "z", "q": "q"} | {f"n{i}": f"n{rnd.randrange(60)}" for i in range(50)} | {f"c{i}": f"c{i + 1}" for i in range(200)}
    got = dict(map(tuple, standardize.alias_roots(spark.createDataFrame(list(given_.items()), "term string, target string")).collect()))
    assert got == {t: plain_root(t, given_) for t in set(given_) | set(given_.values())}
    assert standardize.alias_roots(spark.createDataFrame([], "term string, target string")).count() == 0


def test_alias_joins_send_no_rows_to_the_driver(spark, monkeypatch):
    """A cycle that all terms lead into ends the doubling, and no table is broadcast."""
    plans = []

    def kept(df, written=standardize.materialised):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(standardize, "materialised", kept)
    given_ = {str(k): str({1: 2, 2: 3, 3: 1}.get(k, k // 2)) for k in range(1, 3000)}
    rows = spark.createDataFrame(list(given_.items()), "term string, target string")
    roots = standardize.alias_roots(rows)
    rounds = len(plans)
    got = dict(map(tuple, roots.collect()))
    mapped = standardize.corrected_mapping(rows, spark.createDataFrame([(0, "40"), (1, "4")], "pos long, term string"))
    plans += [d._jdf.queryExecution().executedPlan().toString() for d in (roots, mapped)]
    assert got == {t: plain_root(t, given_) for t in given_} and rounds < 16
    chosen = {"2": "40"}
    assert dict(map(tuple, mapped.collect())) == {t: chosen.get(r, r) for t, r in got.items()} | {"40": "40", "4": "4"}
    assert not any("Broadcast" in p for p in plans)


def test_corrected_mapping_prefers_list_order(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "term string, target string")
    preferred = spark.createDataFrame([(0, "b "), (1, "a"), (2, None), (3, "new")], "pos long, term string")
    assert dict(map(tuple, standardize.corrected_mapping(aliases, preferred).collect())) == {"a": "a", "b": "b", "c": "b", "x": "y", "y": "y", "new": "new"}


def fold(sentences):
    out = ""
    for s in sentences:
        if s and s not in out:
            out = f"{out} | {s}" if out else s
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["ab c", "b", "zz", "", "ab", None, "c | z"]), min_size=1, max_size=8))
def test_sentence_fold(spark, sentences):
    rows = [(i, s, "s", "p", "o") for i, s in enumerate(sentences)]
    (r,) = standardize.merged_duplicates(spark.createDataFrame(rows[::-1], KG)).collect()
    assert r.sentence == fold(s or "" for s in sentences) and r.pos == 0


def test_sentence_fold_example(spark):
    rows = [(i, s, "s", "p", "o") for i, s in enumerate(["ab c", "b", "zz", "", "ab c"])]
    assert standardize.merged_duplicates(spark.createDataFrame(rows, KG)).first().sentence == "ab c | zz"


def test_canonical_nodes(spark):
    rows = [(0, "", "heart-attack", "isa", "disease"), (1, "", "Heart Attack", "isa", "Disease"), (2, "", "heart attack ", "isa", None), (3, "", "  ", "isa", "!!")]
    g = spark.createDataFrame(rows, KG)
    mapping = dict(map(tuple, standardize.canonical_mapping(g).collect()))
    assert mapping == {"heart-attack": "Heart Attack", "Heart Attack": "Heart Attack", "heart attack": "Heart Attack", "disease": "Disease", "Disease": "Disease"}
    out = {r.pos: (r.subject, r.object) for r in standardize.canonical_nodes(g).collect()}
    assert out == {0: ("Heart Attack", "Disease"), 1: ("Heart Attack", "Disease"), 2: ("heart attack ", None), 3: ("  ", "!!")}  # padded nodes are looked up as they are
    preferred = spark.createDataFrame([(0, "HEART attack"), (1, "Heart_Attack!")], "pos long, term string")
    assert {r.subject for r in standardize.canonical_nodes(g, preferred).collect()} >= {"Heart_Attack!"}


def test_standardizing_twice_changes_nothing(spark):
    rows = [(i, f"s{i % 3}", random.Random(i).choice(["a b", "A B", "a-b", "c"]), "p", "o") for i in range(30)]
    none, terms = spark.createDataFrame([], "term string, target string"), spark.createDataFrame([], "pos long, term string")
    once = standardize.standardized(spark.createDataFrame(rows, KG), none, terms)
    assert sorted(standardize.standardized(once, none, terms).collect()) == sorted(once.collect())


CANDIDATES = "array<struct<relation: string, similarity: double>>"


def test_threshold_revert(spark):
    top = [("degree_of", 0.5441), ("measures", 0.4998), ("measurement_of", 0.4916), ("evaluation_of", 0.4046), ("assesses_effect_of", 0.3938)]
    df = spark.createDataFrame([(0, "evaluation_of", "be-solve-at", "evaluation_of", True, top), (1, "p", "q", "lost", True, top), (2, "p", "q", None, False, []), (3, "p", "q", "x", None, None)], f"pos long, predicate string, original_predicate string, canonical_predicate string, canonicalized boolean, top_candidates {CANDIDATES}")
    at = lambda t: [(r.predicate, r.canonicalized, r.canonical_similarity) for r in merging.reverted_below(df, t).orderBy("pos").collect()]
    assert at(0.4) == [("evaluation_of", True, 0.4046), ("q", False, None), ("p", False, None), ("p", None, None)]
    assert at(0.41)[0] == ("be-solve-at", False, 0.4046)


def test_merging_and_counters(spark):
    a = spark.createDataFrame([(0, "a", True, "x"), (1, "b", False, "y"), (2, "c", False, "z")], "pos long, triplet_id string, canonicalized boolean, extra string")
    own = spark.createDataFrame([(0, "b", True, 1), (1, "b", False, 2), (2, "c", True, 3), (3, "other", True, 4)], "pos long, triplet_id string, canonicalized boolean, mine long")
    m = merging.self_mapped_merged(a, own)
    assert [(r.triplet_id, r.canonicalized, r.extra, r.mine, r.from_self) for r in m.orderBy("pos").collect()] == [("a", True, "x", None, False), ("b", False, None, 2, True), ("c", True, None, 3, True)]
    assert tuple(merging.merge_counters(m).first()) == (1, 2, 1, 1)


def test_set_operations(spark):
    g = spark.createDataFrame([(0, "", "A ", "p", "b"), (1, "", "C", None, None)], KG)
    assert {r[0] for r in merging.entities(g).collect()} == {"a", "b", "c"}
    assert {r[0] for r in merging.vocabulary_overlap(g, spark.createDataFrame([("B",), ("x",), (None,)], "term string")).collect()} == {"b"}
    assert merging.unique_predicates(g).first()[0] == 2
    u = merging.union_normalized(g, g.select("pos", F.lit(" IS ").alias("predicate"), F.lit(1).alias("new")))
    assert u.count() == 4 and [r.predicate for r in u.filter("part = 2").collect()] == ["isa", "isa"] and u.filter("normalized").count() == 2
    assert tuple(merging.report(spark.createDataFrame([(True,), (False,), (None,)], "canonicalized boolean")).first()) == (3, 1, 33.3, 2)
    assert tuple(merging.report(spark.createDataFrame([], "canonicalized boolean")).first()) == (0, 0, 0.0, 0)
    assert merging.missing_columns(g, ("pos", "none")) == ["none"]


def test_replaced_predicates(spark):
    df = spark.createDataFrame([("p", "c"), ("p", " "), ("p", None)], "predicate string, canonical_predicate string")
    assert [(r.predicate, r.original_predicate) for r in merging.predicate_replaced(df).collect()] == [("c", "p"), ("p", None), ("p", None)]


def test_filters(spark):
    rows = [(0, "a", True, "d"), (1, "b", False, "d"), (2, "c", False, "(Already canonical — x)"), (3, "d", None, None)]
    df = spark.createDataFrame(rows, "pos long, predicate string, canonicalized boolean, predicate_definition string")
    assert [r.pos for r in unmapped.unmapped_for_self(df).collect()] == [1, 3]
    assert [r.pos for r in unmapped.unmapped_for_clusters(df).collect()] == [1, 2]
    assert [r.pos for r in unmapped.unmapped_for_clusters(df.drop("canonicalized")).collect()] == []
    assert [r.pos for r in unmapped.unmapped_for_self(df.drop("canonicalized")).collect()] == [0, 1, 3]
    assert [r.pos for r in unmapped.beyond_prefix(df, 2).collect()] == [2, 3]


def test_checkpoints(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos long, triplet_id string")
    done = spark.createDataFrame([(0, "a", "old"), (5, "a", "new"), (1, "z", "x")], "pos long, triplet_id string, v string")
    assert [r.triplet_id for r in unmapped.remaining(rows, done).collect()] == ["b"]
    assert sorted((r.pos, r.v) for r in unmapped.resumed(rows, done).collect()) == [(0, "new"), (2, "new")]
    cache = spark.createDataFrame([(2, "P", "later"), (0, " p", ""), (1, "p ", "first"), (3, "q", None)], "pos long, predicate string, response string")
    assert [tuple(r) for r in unmapped.definition_cache(cache).collect()] == [("p", "first")]


def plain_linkage(v, t):
    """Average linkage over all rows by definition."""
    groups = [[i] for i in range(len(v))]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    while len(groups) > 1:
        best, i, j = min((np.mean([d[a, b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if not best < t:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize(("seed", "few"), [(0, 2), (1, 2), (2, 12), (3, 4096)])
def test_clusters_against_plain_linkage(spark, monkeypatch, seed, few):
    """few: from how many clusters on one task ends the rounds."""
    monkeypatch.setattr(clusters, "FEW", few)
    monkeypatch.setattr(metric_index, "BLOCK", 8)
    v = np.random.default_rng(seed).normal(size=(40, 3))
    v[20], v[21] = 2 * v[3], v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate([*v, 0 * v[0], 0 * v[0]])], "id long, vector array<double>")
    got = {}
    for r in clusters.clustered(rows, 0.35).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == plain_linkage(v, 0.35) | {frozenset([40]), frozenset([41])} and all(k == min(g) for k, g in got.items())


def test_nearest_under_a_distance_meets_few_balls(spark, monkeypatch):
    """Equal to all pairs, without most rows in most balls."""
    monkeypatch.setattr(metric_index, "BLOCK", 16)
    rnd = np.random.default_rng(7)
    v = np.repeat(rnd.normal(size=(40, 8)), 15, axis=0) + 0.1 * rnd.normal(size=(600, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    d = np.round(1 - v @ v.T, 12)
    np.fill_diagonal(d, np.inf)
    want = {i: (int(d[i].argmin()), d[i].min()) for i in range(600) if d[i].min() < 0.1}
    assert {r.id: (r.other, pytest.approx(r.d, abs=1e-9)) for r in metric_index.nearest_under(rows, 0.1).collect()} == want
    placed, pivots, radii = metric_index.balls(rows)
    met = metric_index.meetings(placed, pivots, radii, np.sqrt(0.2))
    assert placed.count() == 600 and met.count() < 600 * len(pivots) / 3
    groups = metric_index.block_pairs(met).groupBy("grp").count().collect()
    assert max(g["count"] for g in groups) < 8 * 16


def test_blocks_meet_packed_where_balls_rule_out_little(spark, monkeypatch):
    """Equal to all pairs, ties included, without a row for each vector and ball."""
    monkeypatch.setattr(metric_index, "BLOCK", 16)
    monkeypatch.setattr(metric_index, "meetings", None)
    v = np.random.default_rng(3).normal(size=(150, 12))
    v[100:120] = np.round(v[:20], 1)
    v[120:] = v[:30] * 0.5
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    rows = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    d = np.round(1 - v @ v.T, 12)
    np.fill_diagonal(d, np.inf)
    for t in (0.35, 0.9, 0.0):
        want = {i * 3: (int(d[i].argmin()) * 3, pytest.approx(d[i].min(), abs=1e-9)) for i in range(150) if d[i].min() < t}
        assert {r.id: (r.other, r.d) for r in metric_index.nearest_under(rows, t).collect()} == want
        monkeypatch.setattr(metric_index, "MANY_VISITS", -1)


def test_few_rows_are_their_own_clusters(spark):
    one = spark.createDataFrame([(5, [1.0])], "id long, vector array<double>")
    assert [tuple(r) for r in clusters.clustered(one).collect()] == [(5, 5)] and clusters.clustered(one.limit(0)).count() == 0


def test_labels(spark):
    rows = spark.createDataFrame([(1, "Has Part", "d"), (2, "part-of", "e"), (3, "in", "f")], "id long, predicate string, definition string")
    members = clusters.cluster_members(rows, spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, cluster long"))
    labels = clusters.labelled(members, spark.createDataFrame([(1, " 'containing'. ok")], "cluster long, answer string"))
    assert {r.cluster: r.label for r in labels.collect()} == {1: "containing", 3: "in"}
    records = spark.createDataFrame([(0, "HAS part", False, "x"), (1, "has part", True, "y"), (2, "other", False, "z"), (3, "has part", None, "w")], "pos long, original_predicate string, canonicalized boolean, canonical_predicate string").withColumn("predicate", F.lit("q"))
    out = clusters.mapping_applied(records, clusters.predicate_labels(labels)).orderBy("pos").collect()
    assert [(r.canonical_predicate, r.canonicalized, r.canonicalization_method) for r in out] == [("containing", True, "cluster_llm"), ("y", True, None), ("z", False, None), ("w", None, None)]


class Flaky:
    def __init__(self, failures):
        self.left = failures

    def complete(self, prompts, max_tokens):
        if self.left:
            self.left -= 1
            raise RuntimeError("busy")
        return [(p.upper(), {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}) for p in prompts]


def test_retries():
    waits = []
    (r,) = called(Flaky(2), ["a"], 5, sleep=waits.append)
    assert r["text"] == "A" and r["attempts"] == 3 and waits == [1, 2]
    waits.clear()
    (r,) = called(Flaky(9), ["a"], 5, sleep=waits.append)
    assert r == {"text": "", "attempts": 4, "error": "busy", "usage": None} and waits == [1, 2, 4, 8]
    assert [x["text"] for x in called(Flaky(1), ["a", "b"], 5, sleep=waits.append)] == ["A", "B"]


def test_model_steps(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i % 2}") for i in range(7)], "i long, p string")
    got = {r.i: r.answer for r in completed(df, "p", lambda: FunctionCompleter(str.upper), 5, batch=2).collect()}
    assert got[3] is None and all(got[i].text == f"T{i % 2}" for i in got if i != 3)
    v = {r.i: r.v for r in embedded(df, "p", LetterCounts, "v", batch=3).collect()}
    assert v[0][19] == 1.0 and not any(v[3])
    assert for_distinct(df, "p", lambda d: embedded(d, "p", LetterCounts, "v")).count() == 7
