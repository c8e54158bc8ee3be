import math
import re

from weftline.llm.licences import ANCHORS, LEAST_AGREEMENT, LEAST_PROBABILITY, OTHERS, TEMPLATES, UNKNOWN, classified, features, grams, model, samples, scanned, tokens

DDL = "doc_id long, text string"


def plain(paragraph):
    """The class of a paragraph by Python's own sums."""
    names, weights, base = model()
    g = grams(tokens(paragraph))
    z = [b + sum(weights[x][k] for x in features(tokens(paragraph)) if x in weights) for k, b in enumerate(base)]
    best = z.index(max(z))
    p = 1 / sum(math.exp(v - z[best]) for v in z)
    near = max((max(len(g & t) / len(t), len(g & t) / len(g) if len(g) >= 6 else 0) for t in (grams(tokens(x)) for x in TEMPLATES.get(names[best], []))), default=0.0)
    family = names[best] if names[best] != UNKNOWN and p >= LEAST_PROBABILITY else UNKNOWN
    return family, p, near, family != UNKNOWN and near >= LEAST_AGREEMENT


def test_paragraphs_without_an_anchor_are_unknown_by_the_model():
    names, weights, base = model()
    assert names[base.index(max(base))] == UNKNOWN and not features(tokens("any words at all of no licences or mit"))
    assert all(x.startswith("~") or ANCHORS & set(x.split()) for x in weights)
    assert all(ANCHORS & set(tokens(t)) for texts in TEMPLATES.values() for t in texts)


def test_wording_that_was_held_out():
    """Notices and sentences of which no wording is in the training texts."""
    texts, families = samples(True)
    train = {" ".join(t) for t in samples(False)[0]}
    assert not train & {" ".join(t) for t in texts}
    got = [plain(" ".join(t))[0] for t in texts]
    assert sum(a == b for a, b in zip(got, families, strict=True)) > 0.9 * len(texts)
    wrong = [a for a, b in zip(got, families, strict=True) if b == UNKNOWN != a]
    assert len(wrong) < 0.03 * len(texts)


GPL3 = """Some program, a tool

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Enough."""
EPL = """This program and the accompanying materials are made available under
the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""


def test_probes(spark):
    want = {"Text available under CC BY-SA 4.0": "CC-BY-SA", "Creative Commons Attribution 3.0 Unported": "CC-BY", GPL3: "GPL-3.0", GPL3.replace("\n", "\r\n"): "GPL-3.0", EPL: "",
            "the old module was licensed under the GPL v3 and we could not use it": "", "one two.\nReleased under the MIT License.\nAll rights reserved.\nthree": "MIT,proprietary"}
    rows = scanned(spark.createDataFrame(list(enumerate(want)), DDL), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.families for r in rows] == list(want.values())
    assert rows[4].n_unknown == rows[4].n_paragraphs == 1


def test_classes_against_plain_sums(spark):
    texts = [t for x in TEMPLATES.values() for t in x] + OTHERS + ["license", "licensed " * 30, "the MIT license of GPL v2 and Apache License", GPL3, EPL, "license", "a b c license d"]
    rows = spark.createDataFrame([(" ".join(tokens(t)),) for t in texts], "words string")
    got = {r.words: r for r in classified(rows).collect()}
    for t in texts:
        r, (family, p, near, sure) = got[" ".join(tokens(t))], plain(t)
        assert r.family == family and math.isclose(r.probability, p, rel_tol=1e-6) and r.confirmed == sure
        if sure:
            assert math.isclose(r.agreement, near, rel_tol=1e-9)


def test_known_and_unknown_paragraphs(spark):
    """Templates, with words around them and in capitals, are found; sentences that only mention licences are not."""
    rows, want = [], {}
    for f, texts in TEMPLATES.items():
        for t in texts:
            for form in (t, t.upper(), f"zork plim {t} frell".replace("\n", " ")):
                want[len(rows)] = f
                rows.append((len(rows), f"first line.\n{form}\n\nlast line"))
    for t in OTHERS:
        want[len(rows)] = ""
        rows.append((len(rows), t))
    got = {r.doc_id: r.families for r in scanned(spark.createDataFrame(rows, DDL), ["doc_id"]).collect()}
    assert sum(got[i] == w for i, w in want.items()) >= 0.97 * len(want)
    assert all(got[i] == "" for i, w in want.items() if not w)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC", "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "All rights reserved": "proprietary"}
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = scanned(docs, ["doc_id"]).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.families == ",".join(sorted(f for x, f in lines.items() if x in text[r.doc_id]))


def test_plan_is_native(spark):
    plan = scanned(spark.createDataFrame([(1, "MIT License")], DDL).repartition(2), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_and_empty_tables(spark, odd, empty, odd_rows):
    rows = scanned(odd, ["doc_id", "words", "families"]).collect()
    assert len(rows) == len(odd_rows) and {r.n_paragraphs for r in rows} == {0}
    two = spark.createDataFrame([(None, "Released under the MIT License.\nReleased under the MIT License."), (1, "publicdomain\nmit")] * 2, DDL)
    assert sorted((r.doc_id or 0, r.n_paragraphs, r.families) for r in scanned(two, ["doc_id"]).collect()) == [(0, 2, "MIT"), (0, 2, "MIT"), (1, 0, ""), (1, 0, "")]
    assert scanned(empty, ["doc_id"]).count() == 0


def test_several_families_and_none_granted(spark):
    """Each family that a paragraph grants, and none where it says that it grants none."""
    want = {
        "Dual licensed under the MIT License and the Apache License 2.0.": "Apache-2.0,MIT",
        "Licensed under either of the Apache License, Version 2.0 or the MIT license, at your option.": "Apache-2.0,MIT",
        "You may use this software under the terms of the GPL v2, the LGPLv3 or the Mozilla Public License 2.0.": "GPL-2.0,LGPL,MPL-2.0",
        "This code may be used as described in the BSD licence.": "BSD",
        "This is distributed without the MIT License.": "",
        "This package comes without the BSD license.": "",
        "The files are not under the GPL v3.": "",
        "It is not licensed under the MIT License or the GPL v2.": "",
    }
    rows = scanned(spark.createDataFrame(list(enumerate(want)), DDL), ["doc_id"]).orderBy("doc_id").collect()
    assert {t: r.families for t, r in zip(want, rows, strict=True)} == want
    assert all(r.n_paragraphs == 1 and r.n_confirmed == bool(r.families) and r.n_unknown == (not r.families) for r in rows)
    both = scanned(spark.createDataFrame([(1, "Under the MIT License or the GPL v2.\nReleased under the MIT License.\nunder a license")], DDL), ["doc_id"]).first()
    assert (both.n_paragraphs, both.n_confirmed, both.n_unknown, both.families) == (3, 2, 1, "GPL-2.0,MIT")


def test_readings_leave_out_the_names_of_others(spark):
    from pyspark.sql import functions as F

    from weftline.llm.licences import readings

    given = ["the mit license", "mit license or gpl v2 or isc license at will", "cc by-sa 4.0 and cc by 4.0", "gnu general public license v2.0 gnu general public license v2.0"]
    want = [["the mit license"], ["mit license or or at will", "or gpl v2 or at will", "or or isc license at will"], ["cc by-sa 4.0 and", "and cc by 4.0"], given[3:]]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(given)], "i int, words string").select("i", readings(F.col("words")).alias("r")).orderBy("i").collect()
    assert [sorted(r.r) for r in got] == [sorted(w) for w in want]
