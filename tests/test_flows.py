import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import runtime
from weftline.functions.text import ALREADY_CANONICAL
from weftline.operators import merging, retrieval
from weftline.operators.models import FunctionCompleter, LetterCounts
from weftline.plans import align, mapping, self_canonical
from weftline.runtime import materialised
from weftline.sources import files
from weftline.sources.json_parts import joined_file

KG = "pos long, sentence string, subject string, predicate string, object string"
DEFINE = lambda: FunctionCompleter(lambda p: "def " + re.search(r"Triplet: \['(.*?)', '(.*?)'", p)[2])


def ontology(spark):
    return spark.createDataFrame([("part_of", 0, "def part of something"), ("causes", 1, "def leads to"), ("is", 2, "zzz")], "relation string, rel_idx long, def string")


def test_final_alignment_passes_canonical_rows_by(spark):
    rows = [(0, "s", "a", "part_of", "b"), (1, "s", "a", "part", "b"), (2, None, "a", "zzz", "b")]
    asked = FunctionCompleter(lambda p: "C" if "zzz" in p.split("Choices")[0] else "**A**")
    out = {r.pos: r for r in align.aligned(spark.createDataFrame(rows, KG), ontology(spark), DEFINE, lambda: asked, LetterCounts, top=2).collect()}
    assert (out[0].predicate_definition, out[0].canonical_predicate, out[0].canonicalized, out[0].top_candidates) == (ALREADY_CANONICAL, "part_of", False, [])
    assert out[1].canonicalized and out[1].canonical_predicate == out[1].top_candidates[0].relation == "part_of" and out[1].original_predicate == "part"
    assert not out[2].canonicalized and out[2].canonical_predicate == "zzz" and len(out[2].top_candidates) == 2
    assert out[1].choice_call.attempts == 1 and out[0].choice_call is None


def test_cached_alignment_defines_a_predicate_once(spark):
    rows = [(i, f"sentence {i}", "a", ["Part", "part ", "other"][i % 3], "b") for i in range(9)]
    define = FunctionCompleter(lambda p: re.search(r"Text: (.*)", p)[1])
    out = {r.pos: r for r in align.aligned(spark.createDataFrame(rows, KG), ontology(spark), lambda: define, lambda: FunctionCompleter(lambda p: "no fit"), LetterCounts, mode="cached").collect()}
    assert {r.predicate_definition for r in out.values()} == {"sentence 0", "sentence 2"} and out[7].predicate_definition == "sentence 0"


@pytest.mark.parametrize("few", [0, 10_000])
def test_candidates_are_sought_once_a_definition(spark, monkeypatch, few):
    """few: rows that are broadcast."""
    sought = []

    def counted(queries, *rest):
        sought.append(queries.count())
        return retrieval.top_k(queries, *rest)

    monkeypatch.setattr(align, "top_k", counted)
    monkeypatch.setattr(runtime, "FEW_ROWS", few)
    rows = [(i, f"s{i}", "a", ["part", "lead", "zz"][i % 3], "b") for i in range(30)]
    word = FunctionCompleter(lambda p: re.search(r"Triplet: \['.*?', '(.*?)'", p)[1] + " of it")
    choose = FunctionCompleter(lambda p: "A" if "'lead'" in p else "none")
    for mode in ("final", "cached"):
        out = align.aligned(spark.createDataFrame(rows, KG), ontology(spark), lambda: word, lambda: choose, LetterCounts, mode=mode).collect()
        assert sought.pop() == 3 and len(out) == 30 and all(len(r.top_candidates) == 3 for r in out)
        assert {r.predicate: r.predicate_definition for r in out} == {"part": "part of it", "lead": "lead of it", "zz": "zz of it"}
        assert all(r.canonical_predicate == r.top_candidates[0].relation for r in out if r.predicate == "lead")


@pytest.mark.parametrize("few", [0, 10_000])
def test_a_definition_is_that_of_a_predicates_first_row(spark, monkeypatch, few):
    """All spellings of a predicate share one definition; null, empty and blank names are one predicate."""
    monkeypatch.setattr(runtime, "FEW_ROWS", few)
    names = ["Part", "", None, "part ", " ", "PART", "lead", "Lead", None, "zz"]
    rows = [((i * 7) % 20, f"s{(i * 7) % 20}", "a", names[(i * 7) % 20 % 10], "b") for i in range(20)]
    define = FunctionCompleter(lambda p: re.search(r"Text: (.*)", p)[1])
    run = align.aligned(spark.createDataFrame(rows, KG), ontology(spark), lambda: define, lambda: FunctionCompleter(lambda p: re.search(r"Text: (.*)", p)[1]), LetterCounts, mode="cached")
    first = {}
    for r in sorted(rows):
        first.setdefault((r[3] or "").strip().lower(), r[1])
    out = run.collect()
    assert sorted((r.pos, r.predicate or "", r.predicate_definition) for r in out) == sorted((r[0], r[3] or "", first[(r[3] or "").strip().lower()]) for r in rows)
    assert all(r.choice_call.text == r.sentence == f"s{r.pos}" and r.definition_call.text == r.predicate_definition for r in out)
    assert {r.pos: r.triplet_id for r in out} == {r.pos: r.triplet_id for r in align.identified(spark.createDataFrame(rows, KG)).collect()}


@pytest.mark.parametrize("mode", ["final", "cached"])
def test_rows_of_one_row_group_go_to_several_tasks(spark, tmp_path, mode):
    """A file of one row group is one task's; the calls, which are what costs, are dealt to all cores, and prompts are not handed back."""
    from pyspark import TaskContext

    spark.createDataFrame([(i, f"s{i}", "a", "part", "b") for i in range(400)], KG).coalesce(1).write.parquet(f"{tmp_path}/g")
    task = FunctionCompleter(lambda p: f"task {TaskContext.get().partitionId()}")
    out = align.aligned(spark.read.parquet(f"{tmp_path}/g"), ontology(spark), lambda: task, lambda: task, LetterCounts, mode=mode)
    rows = out.collect()
    assert len(rows) == 400 and len({r.choice_call.text for r in rows}) >= 4
    defined = len({r.definition_call.text for r in rows})
    assert defined == 1 if mode == "cached" else defined >= 4


def test_resuming_skips_finished_rows(spark):
    g = spark.createDataFrame([(i, "s", f"a{i}", "p", "b") for i in range(4)], KG)
    full = align.aligned(g, ontology(spark), DEFINE, lambda: FunctionCompleter(lambda p: "A"), LetterCounts)
    done = full.filter("pos < 2").withColumn("canonical_predicate", F.lit("from before"))
    again = align.aligned(g, ontology(spark), DEFINE, lambda: FunctionCompleter(lambda p: "A"), LetterCounts, finished=done)
    assert [r.canonical_predicate for r in again.orderBy("pos").collect()][:2] == ["from before"] * 2 and again.count() == 4


def plain_self(rows, choose, top):
    names, defs, vectors, out = [], [], [], []
    count = lambda t: np.array([t.lower().count(chr(97 + i)) for i in range(26)], dtype=float)
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    for _, _, s, p, o in rows:
        d = f"def {p}"
        v = count(d)
        near = sorted(range(len(names)), key=lambda i: (-round(cos(v, vectors[i]), 12), -i))[:top]  # noqa: B023
        at = choose(s, p, [names[i] for i in near]) if near else None
        if at is None:
            names.append(p)
            defs.append(d)
            vectors.append(v)
            out.append((p, False))
        else:
            out.append((names[near[at]], True))
    return out


def test_self_canonicalisation_against_a_plain_loop(spark):
    rows = [(i, "", f"s{i}", p, "o") for i, p in enumerate("part piece part piece of cause causing part leads cause effect piece".split())]

    def choose(s, p, near):
        return 0 if int(s[1:]) % 3 == 2 else 1 if int(s[1:]) % 4 == 3 and len(near) > 1 else None

    def answer(prompt):
        s = re.search(r"Triplet: \['(.*?)'", prompt)[1]
        near = re.findall(r"^[A-Z]\. '", prompt, re.M)
        at = choose(s, None, near)
        return "none" if at is None else "AB"[at]

    g = spark.createDataFrame(rows, KG)
    out = self_canonical.self_canonicalized(g, DEFINE, lambda: FunctionCompleter(answer), LetterCounts, top=3).orderBy("pos").collect()
    want = plain_self(rows, choose, 3)
    assert [(r.canonical_predicate, r.canonicalized) for r in out] == want
    schema = dict(map(tuple, self_canonical.dynamic_schema(spark.createDataFrame(out)).collect()))
    assert set(schema) == {n for n, fused in want if not fused}
    # A resumed run sees the same schema as one that went through.
    first = spark.createDataFrame(out[:7])
    rest = self_canonical.self_canonicalized(g, DEFINE, lambda: FunctionCompleter(answer), LetterCounts, top=3, finished=first).orderBy("pos").collect()
    assert len(rest) == 5


def test_reused_definitions(spark):
    rows = [(0, "", "s", "p", "o", "kept"), (1, "", "s", "p", "o", " (Already canonical — LLM not called) "), (2, "", "s", "p", "o", None)]
    out = self_canonical.prepared(spark.createDataFrame(rows, KG + ", predicate_definition string"), DEFINE, LetterCounts).orderBy("pos").collect()
    assert [r.predicate_definition for r in out] == ["kept", "def p", "def p"]


def test_mapping_errors_and_resume(spark):
    rows = [(i, "s", "a", "p", "b", [("r", 0.5), ("lost", 0.4)]) for i in range(3)]
    g = spark.createDataFrame(rows, KG + ", candidates_rel array<struct<relation: string, score: double>>")
    o = spark.createDataFrame([("r", "d", [("x", "r", "y")])], "relation string, def string, triplets array<struct<s: string, p: string, o: string>>")
    seen = mapping.mapped(g, o, lambda: FunctionCompleter(lambda p: "r\nwhy" if "2. Relation: lost\nDefinition: \nPossible type pairs: \n" in p else "?"), done=1).collect()
    assert [(r.pos, r.predicted_relation, r.is_valid) for r in sorted(seen)] == [(1, "r", True), (2, "r", True)]


def test_cluster_flow(spark):
    rows = [(0, "part of", "part of", "x", False), (1, "part off", "part off", "x", False), (2, "qqq", "qqq", "zz", False), (3, "ok", "ok", "x", True)]
    g = spark.createDataFrame(rows, "pos long, predicate string, original_predicate string, predicate_definition string, canonicalized boolean").withColumn("canonical_predicate", F.col("predicate"))
    out, labels = mapping.relabelled(g, LetterCounts, lambda: FunctionCompleter(lambda p: "within"), 0.35)
    assert [(r.canonical_predicate, r.canonicalized) for r in out.orderBy("pos").collect()] == [("within", True), ("within", True), ("qqq", True), ("ok", True)]
    assert sorted(len(r.members) for r in labels.collect()) == [1, 2]
    same, none = mapping.relabelled(g.filter("canonicalized"), LetterCounts, lambda: FunctionCompleter(lambda p: "x"))
    assert same.count() == 1 and none.count() == 0


def test_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"file://{tmp_path}/{name}"

    srdef = put("srdef", "STY|1|Thing|A|a def|||||x||\nRL|2| part_of |R|is in|||||has_part||\nRL|3|short\n")
    assert [(r.kind, r.name, r.inverse) for r in files.read_srdef(spark, srdef).orderBy("pos").collect()] == [("STY", "Thing", "x"), ("RL", " part_of ", "has_part")]
    csv = put("t.csv", 'subject,predicate,object\n"Amino Acid, Peptide",isa,"a ""b"""\n')
    assert [(r.subject, r.object) for r in files.read_triples_csv(spark, csv).collect()] == [("Amino Acid, Peptide", 'a "b"')]
    row = {"subject": "s", "predicate": "p", "object": "o"}
    mixed = put("g.json", json.dumps({"a": [row, row | {"def": 1}, 3], "b": row, "c": {"def": "x"}}))
    assert {m: files.read_graph(spark, mixed, m).count() for m in ("list_items", "strict", "values")} == {"list_items": 3, "strict": 2, "values": 2}
    listed = put("l.json", json.dumps([row | {"sentence": "é", "validation": "True"}, row]))
    got = files.read_graph(spark, listed, extra="validation string").orderBy("pos").collect()
    assert [(r.pos, r.sentence, r.validation) for r in got] == [(0, "é", "True"), (1, "", None)]
    log = put("log.jsonl", '{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert [r.a for r in files.read_jsonl(spark, log, "a long").orderBy("a").collect()] == [1, 2]
    assert files.read_jsonl(spark, f"file://{tmp_path}/none", "a long").count() == 0
    files.append_jsonl(spark.range(2).withColumnRenamed("id", "a"), f"file://{tmp_path}/out")
    files.append_jsonl(spark.range(1).withColumnRenamed("id", "a"), f"file://{tmp_path}/out")
    assert files.read_jsonl(spark, f"file://{tmp_path}/out", "a long").count() == 3
    files.write_json_array(files.read_graph(spark, listed), f"{tmp_path}/array", ["pos"], columns=("subject", "sentence"))
    joined_file(f"{tmp_path}/array", f"{tmp_path}/array.json")
    assert json.load(open(f"{tmp_path}/array.json", encoding="utf-8")) == [{"subject": "s", "sentence": "é"}, {"subject": "s", "sentence": ""}]
    files.write_triples_json(files.read_triples_csv(spark, csv), f"{tmp_path}/triples")
    joined_file(f"{tmp_path}/triples", f"file://{tmp_path}/triples.json")
    assert json.load(open(f"{tmp_path}/triples.json", encoding="utf-8")) == [{"subject": "Amino Acid, Peptide", "predicate": "isa", "object": 'a "b"'}]
    assert dict(map(tuple, files.read_aliases(spark, put("a.json", '{"x": "y"}')).collect())) == {"x": "y"}
    terms = files.read_terms(spark, put("terms.csv", "term\n Heart \n\nLung\nHeart\n"), lowercase=True)
    assert [r.term for r in terms.orderBy("pos").collect()] == ["heart", "lung", "heart"] and files.distinct_terms(terms).count() == 2
    assert files.layout("out/kg.json")["checkpoint"] == "out/kg.checkpoint.jsonl"


def test_counters_of_a_run(spark):
    rows = [(i, f"s{i}", "a", f"pred{i % 3}", "b") for i in range(9)] + [(9, "s", "a", "r", "b")]
    g, o = spark.createDataFrame(rows, KG), spark.createDataFrame([("r", 0, "d")], "relation string, rel_idx int, def string")
    counters = lambda out, **k: merging.run_counters(out, **k).first().asDict()
    run = lambda g, **k: align.aligned(g, o, lambda: FunctionCompleter(lambda p: "d"), lambda: FunctionCompleter(lambda p: "A"), LetterCounts, **k)
    first = run(g.filter("pos < 4"))
    assert counters(first) == {"total": 4, "n_skipped": 0, "n_definition_calls": 4, "n_choice_calls": 4, "n_failed_calls": 0}
    finished = materialised(first)
    assert counters(run(g, finished=finished), finished=finished) == {"total": 10, "n_skipped": 4, "n_definition_calls": 5, "n_choice_calls": 5, "n_failed_calls": 0}
    assert counters(run(g, mode="cached"), cached=True) == {"total": 10, "n_skipped": 0, "n_definition_calls": 4, "n_choice_calls": 10, "n_failed_calls": 0}
    bad = first.withColumn("choice_call", F.when(F.col("pos") == 1, F.struct(F.lit("").alias("text"), F.lit(4).alias("attempts"), F.lit("busy").alias("error"), F.col("choice_call.usage"))).otherwise(F.col("choice_call")))
    assert counters(bad) == {"total": 4, "n_skipped": 0, "n_definition_calls": 4, "n_choice_calls": 7, "n_failed_calls": 1}
    assert counters(first.limit(0)) == {"total": 0, "n_skipped": 0, "n_definition_calls": 0, "n_choice_calls": 0, "n_failed_calls": 0}


ARRIVING = ([(0, "s", "a", "p", "b"), (1, "s", "a", "p", "b"), (2, "s", "x", "p", "b"), (5, "s", "done", "p", "b")], [(3, "s", "a", "p", "b"), (4, "s", "new", "p", "b")])


def test_incremental_runs_add_only_new_rows(spark, tmp_path):
    """The stream is started again, and knows what is finished without its output, which is away."""
    from weftline.streaming.incremental import run

    source = f"{tmp_path}/in"
    step = lambda rows: rows.select("triplet_id", "subject", F.upper("predicate").alias("p"))
    finished = align.identified(spark.createDataFrame([(9, "s", "done", "p", "b")], KG)).select("triplet_id")
    for k, batch in enumerate(ARRIVING):
        spark.createDataFrame(batch, KG).coalesce(1).write.mode("append").parquet(source)
        run(spark.readStream.schema(KG).parquet(source), step, f"{tmp_path}/out{k}", f"{tmp_path}/state", finished=finished).awaitTermination(120)
    assert [sorted(r.subject for r in spark.read.parquet(f"{tmp_path}/out{k}").collect()) for k in (0, 1)] == [["a", "x"], ["new"]]


def test_a_failed_batch_is_repeated_whole(spark, tmp_path):
    """A batch that fails after it was written leaves neither rows twice nor rows that count as finished."""
    from weftline.streaming.incremental import run

    source, fails = f"{tmp_path}/in", [True]

    def step(rows):
        if fails:
            rows.write.parquet(f"{tmp_path}/out/batch=0")
            fails.pop()
            raise RuntimeError("lost")
        return rows.select("triplet_id", "subject")

    spark.createDataFrame(ARRIVING[0], KG).coalesce(1).write.parquet(source)
    start = lambda: run(spark.readStream.schema(KG).parquet(source), step, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    with pytest.raises(Exception, match="lost"):
        start()
    start()
    assert sorted(r.subject for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "done", "x"]


def counting(folder, answer):
    """A model that leaves a file for each prompt that it is asked."""
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)

    def one(prompt):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return answer(prompt)

    return lambda: FunctionCompleter(one)


def test_models_are_asked_once(spark, tmp_path):
    import os

    asked = lambda name: len(os.listdir(tmp_path / name))
    word = lambda p: "def " + re.search(r"Triplet: \['(.*?)', '(.*?)'", p)[2]
    rows = [(i, f"s{i}", "a", f"pred{i % 4}", "b") for i in range(12)]
    g = spark.createDataFrame(rows, KG)
    align.aligned(g, ontology(spark), counting(tmp_path / "cached", lambda p: "def"), counting(tmp_path / "choose", lambda p: "A"), LetterCounts, mode="cached").collect()
    assert asked("cached") == 4 and asked("choose") == 12
    align.aligned(g, ontology(spark), counting(tmp_path / "final", word), lambda: FunctionCompleter(lambda p: "A"), LetterCounts).collect()
    assert asked("final") == 12
    out = self_canonical.self_canonicalized(g, counting(tmp_path / "self", word), counting(tmp_path / "fold", lambda p: "A"), LetterCounts)
    assert len(out.collect()) == 12 == out.count()
    assert asked("self") == 12 and asked("fold") == 11
    records = spark.createDataFrame([(i, f"pred{'abcdef'[i]}", f"pred{'abcdef'[i]}", "some words of it", False) for i in range(6)], "pos long, predicate string, original_predicate string, predicate_definition string, canonicalized boolean").withColumn("canonical_predicate", F.col("predicate"))
    applied, labels = mapping.relabelled(records, LetterCounts, counting(tmp_path / "labels", lambda p: "label"))
    several = [r for r in labels.collect() if len(r.members) > 1]
    applied.collect()
    labels.collect()
    assert several and asked("labels") == len(several)


def test_positions_over_many_files(spark, tmp_path):
    """Seventy graph files, and term lists of which a later one is larger: positions are unique, and go by path and place."""
    for i in range(70):
        (tmp_path / f"g{i:02}.json").write_text(json.dumps([{"sentence": f"{i}-{k}", "subject": "a", "predicate": "p", "object": "b"} for k in range(3)]))
    got = files.read_graph(spark, f"{tmp_path}/g*.json").orderBy("pos").collect()
    assert [r.sentence for r in got] == [f"{i}-{k}" for i in range(70) for k in range(3)] and len({r.pos for r in got}) == 210
    for i in range(4):
        (tmp_path / f"t{i} x.csv").write_text("term\n" + "".join(f"t{i}n{k}\n" for k in range(1 + 40 * i)))
    assert [r.term for r in files.read_terms(spark, f"{tmp_path}/t*.csv").orderBy("pos").collect()] == [f"t{i}n{k}" for i in range(4) for k in range(1 + 40 * i)]


def test_a_runs_files(spark, tmp_path):
    g = spark.createDataFrame([(i, "s", f"a{i}", "p", "b") for i in range(3)], KG)
    out = align.aligned(g, ontology(spark), DEFINE, lambda: FunctionCompleter(lambda p: "A"), LetterCounts)
    log = files.call_log(out, "choice_call", 3, "stand-in", 10)
    places = files.write_run(f"{tmp_path}/run.json", result=out.drop("definition_call", "choice_call"), phase3=log)
    assert set(places) == {"result", "phase3"} and spark.read.json(places["result"]).count() == 3
    again = spark.read.json(places["phase3"]).collect()
    assert len(again) == 3 and {(r.phase, r.model, r.response, r.attempts) for r in again} == {(3, "stand-in", "A", 1)}


def test_one_rule_reads_letters(spark):
    from weftline.functions.answers import strict_letter, strict_place

    answers = ["A", "b", "Answer: C", "The answer is D.", "Neither A nor B", "F", "", "**B**", "I think B", "this is E", "E)", "Answer:\nB", " c ", "Z"]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string").orderBy("i").select(strict_letter(F.col("a"), 5)).collect()
    assert [r[0] for r in rows] == [None if (p := strict_place(a, 5)) is None else "ABCDE"[p] for a in answers]
