import math
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import answers, text
from weftline.functions.ids import triplet_id


def evaluated(spark, values, *expressions, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} string").select("i", *[e.alias(f"e{k}") for k, e in enumerate(expressions)])
    return [tuple(r)[1:] if len(expressions) > 1 else r[1] for r in sorted(rows.collect())]


PARSED = [
    ("A", "A", "A"), ("b", "B", "B"), ("Answer: C", "C", "A"), ("The answer is D.", "D", "A"), ("Neither A nor B", None, "A"), ("F", None, None), ("", None, None), ("**B**", "B", "B"),
    ("I think B", None, "B"), ("A cat", "A", "A"), ("none of the above", None, "A"), ("F. None of the above", None, "A"), ("this is E", "E", "E"), ("answer A", "A", "A"), ("E)", "E", "E"), ("Answer:\nB", "B", "A"),
]


def test_answers_with_five_candidates(spark):
    got = evaluated(spark, [a for a, _, _ in PARSED], answers.strict_letter(F.col("v"), 5), answers.loose_letter(F.col("v"), 5))
    assert got == [(s, loose) for _, s, loose in PARSED]
    assert evaluated(spark, [None], answers.strict_letter(F.col("v"), 5), answers.loose_letter(F.col("v"), 0)) == [(None, None)]


def test_letters_to_relations(spark):
    relations = F.array(F.lit("r0"), F.lit("r1"))
    assert evaluated(spark, ["A", "B", "C", None], answers.letter_choice(F.col("v"), relations)) == ["r0", "r1", None, None]
    assert evaluated(spark, ["x", "", None], answers.canonical_predicate(F.col("v"), F.lit("p"))) == ["x", "p", "p"]


def test_triplet_ids(spark):
    import hashlib
    import json

    values = ["plain", 'quo"te \\ back', "é漢😀", "line\nfeed\ttab", "\x1f\x0b\x01\x7f", "", "</script>"]
    want = [hashlib.sha1(json.dumps({"sentence": v, "subject": "s", "predicate": v, "object": "o"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16] for v in values]
    assert evaluated(spark, values, triplet_id(F.col("v"), F.lit("s"), F.col("v"), F.lit("o"))) == want


def test_normal_forms(spark):
    cases = {"  Amino-Acid,  Peptide ": "amino acid peptide", "dog ' s": "dog's", "a - b/c_d": "a b c d", "Été_x": "été x", "": "", "!!": "", "\t x\n": "x"}
    assert evaluated(spark, list(cases), text.normalized(F.col("v"))) == list(cases.values())
    assert evaluated(spark, ["Dogs and Cats", None], text.normalized(F.col("v"), {"dogs": "dog", "cats": "cat"})) == ["dog and cat", ""]


def plain_score(node):
    if not node:
        return -math.inf
    t = node.strip()
    score = 2 * (t == node) + 3 * any(c.isupper() for c in t) - 2 * t.islower() + 0.5 * sum(w[0].isupper() for w in t.split())
    score -= 3 * bool(re.search(r"\s'|'\s", t)) + 3 * bool(re.search(r"\s-|-\s", t)) + 2 * bool(re.search(r"\s{2,}", t))
    return score - 0.5 * len(re.findall(r"[^\w\s']", t)) + 0.02 * min(len(t), 50)


def test_cleanliness(spark):
    values = ["", "abc", "Abc Def", " abc", "a  b", "a - b", "a -b", "o ' clock", "ABC", "été", "Éte!", "x" * 80, "1 2", "a's", "A, b; c."]
    assert evaluated(spark, values, text.cleanliness(F.col("v"))) == pytest.approx([plain_score(v) for v in values])


def test_blocks_and_choices(spark):
    pair = F.struct(F.lit("x").alias("s"), F.lit("p").alias("p"), F.lit("y").alias("o"))
    c = F.array(*[F.struct(F.lit(f"r{i}").alias("relation"), F.lit("d" * 200).alias("def"), F.array_repeat(pair, 20).alias("triplets"), F.lit(0.5).alias("score")) for i in range(2)])
    long, short, choices, none = evaluated(spark, ["x"], text.candidate_block(c), text.candidate_block(c, 5, 150), text.choices_text(c), text.none_letter(c))[0]
    block = lambda i, d, n: f"{i + 1}. Relation: r{i}\nDefinition: {'d' * d}\nPossible type pairs: {', '.join(['(x, y)'] * n)}\nRetrieval score: 0.5\n"
    assert long == "\n".join(block(i, 200, 15) for i in range(2)) and short == "\n".join(block(i, 150, 5) for i in range(2))
    assert choices == f"A. 'r0': {'d' * 200}\nB. 'r1': {'d' * 200}\nC. None of the above" and none == "C"
    empty = F.array().cast("array<struct<relation: string, def: string>>")
    assert evaluated(spark, ["x"], text.choices_text(empty), text.none_letter(empty))[0] == ("A. None of the above", "A")


def test_enriched_definition(spark):
    pair = F.struct(F.lit("x").alias("s"), F.lit("p").alias("p"), F.lit("y").alias("o"))
    got = evaluated(spark, ["part_of"], text.enriched_definition(F.col("v"), F.lit("d"), F.array_repeat(pair, 40)), text.display_name(F.col("v")))[0]
    assert got == (f"Relation name: part_of. Definition: d. Possible type pairs: {', '.join(['(x, y)'] * 30)}.", "part of")


def test_prompts_hold_their_parts(spark):
    parts = [F.lit(x) for x in ("SENTENCE", "SUBJECT", "PREDICATE", "OBJECT")]
    one, two, three = evaluated(spark, ["x"], text.definition_prompt(*parts), text.definition_prompt(*parts, in_context=False), text.mapping_prompt(*parts, F.lit("BLOCK"), framed=True))[0]
    assert "Triplet: ['SUBJECT', 'PREDICATE', 'OBJECT']" in one and "in THIS specific context" in one and "THIS" not in two
    assert three.startswith("\nYou are") and three.endswith("Answer:\n") and "\nBLOCK\n" in three
    assert evaluated(spark, [None], text.triple_text(F.col("v"), F.lit("p"), F.lit("o"))) == ["None p o"]


def test_labels_lines_and_keys(spark):
    v = F.col("v")
    assert evaluated(spark, ["'has_part'. It is", "  ", None, '"x";'], text.cleaned_label(v, F.lit("first"))) == ["has_part", "first", "first", "x"]
    assert evaluated(spark, ["Be-Part Of"], text.singleton_label(v), text.cache_key(F.lit("\t Is A "))) == [("be_part_of", "is a")]
    assert evaluated(spark, ["a\nb", "\n c \nd", " x "], text.first_line(v), text.first_line(v, True)) == [("a", "a"), ("", "c"), ("x", "x")]
    assert evaluated(spark, ["IS ", "is-a", "isa", "was", None], text.isa_normalized(v)) == ["isa", "isa", "isa", "was", None]
    assert evaluated(spark, ["p"], text.cluster_text(v, F.lit("")), text.cluster_text(v, F.lit("d"))) == [("p", "p: d")]
