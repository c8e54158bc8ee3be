"""Licence scan: a trained paragraph classifier, in DataFrame and SQL functions alone.

A paragraph ends at a blank line, or at a line's end after a full stop; wrapped notices are one. A multinomial logistic
regression over the paragraph's word 1- to 4-grams gives the probabilities of the licence families and of the class
"unknown". Its only features are grams with an anchor word, so a paragraph without one is unknown by the model itself, and is not
looked at further. Probabilities are calibrated by a temperature, on notices and sentences whose wording is in no
training text. A prediction counts if the paragraph also agrees with one of the family's templates.
A paragraph that names licences of several families is classified once for each of them, without the names of the others.
Weights are trained on the driver from the fixed texts below, never from the corpus.
"""

from __future__ import annotations

import functools
import itertools
import json
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import written

UNKNOWN = "unknown"
#: A prediction counts from this probability, and from this part of a template's grams found in the paragraph or the other way round.
LEAST_PROBABILITY, LEAST_AGREEMENT = 0.5, 0.5
STEPS, RATE, SEED, DECAY = 300, 0.8, 7, 3e-4
#: Words of a feature with an anchor, of one near an anchor, and of a template's gram at most; words on either side of an anchor that are near.
FEATURE, NEAR, GRAM, CONTEXT = 4, 2, 3, 8

# Names of the licences of each family, as short notices give them.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT license (MIT)", "X11/MIT License", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache-2.0 license", "Apache Software License, Version 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3", "GPLv3", "GNU GPL version 3", "GPL-3.0 license", "GNU GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2", "GPLv2", "GNU GPL version 2", "GPL-2.0 license", "GNU GPLv2"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "LGPL v2.1", "LGPLv3", "GNU LGPL", "GNU Library General Public License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL v3", "AGPLv3", "GNU AGPL version 3"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD licence", "New BSD License", "Simplified BSD License", "BSD-3-Clause license"],
    "ISC": ["ISC License", "ISC licence"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0 license"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "CC-BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0 Unported", "Creative Commons Attribution License"],
    "CC0": ["CC0 1.0 Universal", "CC0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Public Domain Dedication", "Unlicense"],
}
# SPDX identifiers.
SPDX = {"MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-3.0": ["GPL-3.0-or-later", "GPL-3.0-only"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "LGPL": ["LGPL-3.0-or-later", "LGPL-2.1-only"], "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD": ["BSD-3-Clause", "BSD-2-Clause"], "ISC": ["ISC"], "MPL-2.0": ["MPL-2.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY": ["CC-BY-4.0"], "CC0": ["CC0-1.0"]}
# How short notices grant; the second group is held out for the temperature.
GRANTS = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "Licensed under {}.", "Distributed under the terms of the {}.", "This project is licensed under the {}, see the LICENSE file for details.", "Text is available under the {}.", "Text available under {}", "{}", "License: {}", "Permission to copy is granted under the {}.", "This file is part of a library that may be used under the {}, either version or later.", "This code may be used as described in the {}.", "You can copy and change it as the {} allows.", "Dual licensed under the {}.", "It comes with the {}.", "Use is governed by the {}.", "Our code is offered under the {} only."]
GRANTS_HELD = ["Published under the {}.", "Content on this site is made available under {} unless otherwise noted.", "You may use this software under the terms of the {}.", "The code is covered by the {}.", "This article is shared under a {}."]
# What longer notices of each family say.
NOTICES = {
    "MIT": [
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This is free software: you can redistribute it under the GNU General Public License, version 3 of the License or later.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This file is free software: you can redistribute it under the terms of the GNU Lesser General Public License, either version 3 of the License, or any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "This is an open access article distributed under the Creative Commons Attribution License, which permits unrestricted use, provided the original work is properly cited."],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Inc. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced or transmitted without the prior written permission of the publisher.",
        "This material may not be published, broadcast, rewritten or redistributed without permission. All rights reserved.",
    ],
}
# Names of licences that are in no family. The second group is held out.
STRANGE = ["European Union Public Licence, version 1.2", "Common Development and Distribution License", "Artistic License 2.0", "Microsoft Public License", "Open Software License 3.0", "zlib license", "Academic Free License, version 3.0", "CeCILL license, version 2", "IBM Public License Version 1.0", "SIL Open Font License, Version 1.1", "Common Public License, version 1.0", "Q Public License"]
STRANGE_HELD = ["Eclipse Public License 2.0", "Boost Software License 1.0", "Sun Public License", "Open Data Commons License", "Lucent Public License, version 1.02"]
STRANGE_GRANTS = ["This program and the accompanying materials are made available under the terms of the {}, which is available at the address below.", "This program is made available under the {} as published by its steward."]
# Sentences about licences that grant nothing; {} is a name of one. The second group is held out.
ABOUT = ["The old module was licensed under the {} and we could not use it.", "It is not licensed under the {}.", "We cannot accept code under the {}.", "The {} requires that changes are published.", "He asked whether the {} allows that.", "Unlike the {}, ours has no such clause.", "In 2007 they moved away from the {}.", "A lawyer explained the {} to the team.", "Code under the {} is incompatible with our terms.", "They had released an earlier version under the {} but withdrew it.", "Many projects use the {} today.", "Do not use anything that is under the {}.", "An article compared the {} with older licenses.", "Nobody in the room had read the {}.", "She wrote a book on the {}.", "The judge did not say whether the {} applied.", "Some of them prefer the {} to all others.", "Was the first version under the {}?", "They discussed the {} for hours.", "The company knew nothing of the {}.", "There was a debate about the {} last year.", "It had been under the {} until they changed it.", "This is distributed without the {}.", "This file is not under the {}.", "It may not be used under the {}.", "None of this is covered by the {}.", "The code is no longer under the {}.", "This was never released under the {}.", "Nothing here is licensed under the {}.", "We refuse to publish under the {}.", "It comes without the {}."]
ABOUT_HELD = ["Her first library had been under the {} before it was rewritten.", "The talk compared the {} with other licenses.", "Nobody knew that the {} was involved.", "The court did not decide whether the {} was binding.", "The program is shipped without the {}.", "It is not published under the {}.", "This is not covered by the {}."]
# Sentences with licence words that grant nothing.
OTHERS = [
    "He lost his driver's license on the way to the office.", "The city council voted to change the liquor license rules.", "Copyright law is a difficult subject for students.",
    "A license is required to fish in the lake.", "The warranty covers parts and labor for two years.", "Apache helicopters flew over the valley.", "The university MIT is in Cambridge.",
    "You need a marriage license first.", "Her poetic license made the story better.", "The court discussed whether copyright applies.", "The gnu is a large African antelope.",
    "Public domain information was used by the press.", "License plates are made of metal.", "Redistribution of wealth was debated.", "Please read the license agreement before you install.",
    "The version 2.0 release adds new features.", "Pilots must renew their license every year.", "The general public may visit on Sundays.", "Hunting without a license is illegal.",
    "Her permission was granted on Monday.", "The House of Commons met again.", "A table was reserved for them.", "She has a creative mind.", "His attribution of the painting was wrong.", "They asked for permission to enter.",
    "The attribution of the letter is unclear.", "All seats are reserved.", "The committee granted permission for a new bridge.", "Please send a cc to the editor.", "The gene is in a conserved domain of the protein.",
]
#: Words one of which each feature has. Every text of a family has one; TOKEN says what a word is.
ANCHORS = frozenset(
    """license licensed licenses licensing licence licenced sublicense unlicense copyright copyleft spdx-license-identifier cc cc0 cc0-1.0 cc-by cc-by-4.0 cc-by-sa cc-by-sa-4.0 cc-by-nc
    cc-by-nc-4.0 by-sa by-nc by-nc-sa by-nc-nd by-nd commons gpl gplv2 gplv3 gpl-2.0 gpl-3.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl lgplv2 lgplv3 lgpl-2.1-only lgpl-3.0-or-later agpl agplv3
    agpl-3.0-only agpl-3.0-or-later gnu apache apache-2.0 bsd bsd-style bsd-2-clause bsd-3-clause isc mpl mpl-2.0 mozilla domain unencumbered redistribution redistributions redistributed redistribute permission granted proprietary
    confidential unauthorized reserved""".split()
)
TOKEN = r"[a-z0-9]+(?:[.+\-][a-z0-9]+)*"
#: A paragraph's end.
BREAK = r"\r?\n[ \t\r]*(?=\n)|(?<=[.!?:])[\"')\]]{0,3}[ \t]{0,8}\r?\n"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    """What templates and paragraphs are compared by."""
    return {" ".join(words[i : i + n]) for n in range(1, GRAM + 1) for i in range(len(words) - n + 1)}


def features(words: list[str]) -> set[str]:
    """Grams of up to FEATURE words with an anchor, and (marked) of up to NEAR words that begin within CONTEXT words of one."""
    anchors = [i for i, w in enumerate(words) if w in ANCHORS]
    near = {i for p in anchors for i in range(max(0, p - CONTEXT), min(len(words), p + CONTEXT + 1))}
    found = {" ".join(words[i : i + n]) for p in anchors for n in range(1, FEATURE + 1) for i in range(max(0, p - n + 1), min(p, len(words) - n) + 1)}
    return found | {"~" + " ".join(words[i : i + n]) for i in near for n in range(1, NEAR + 1) if i + n <= len(words)}


#: What predictions are confirmed by: longer notices, and short ones of each name.
TEMPLATES = {f: [*NOTICES.get(f, []), *[f"Licensed under the {n}." for n in NAMES.get(f, [])], *NAMES.get(f, []), *[f"SPDX-License-Identifier: {x}" for x in SPDX.get(f, [])]] for f in dict.fromkeys([*NAMES, *NOTICES])}


def samples(held: bool) -> tuple[list[list[str]], list[str]]:
    """Training paragraphs, or those of the temperature, and their classes. No text is in both."""
    rnd = random.Random(SEED + held)
    filler = sorted({w for o in OTHERS for w in tokens(o)} - {w for t in TEMPLATES.values() for x in t for w in tokens(x)} - ANCHORS)
    found: list[tuple[list[str], str]] = []

    def add(family: str, text: str, copies: int, most: int = 6) -> None:
        words = tokens(text)
        for copy in range(copies):
            before, after = (rnd.choices(filler, k=rnd.randrange(most)) if copy else [] for _ in range(2))
            found.append(([*before, *[w for w in words if not copy or w in ANCHORS or rnd.random() > 0.03], *after], family))

    for family, names in NAMES.items():
        for name, grant in itertools.product(names, GRANTS_HELD if held else GRANTS):
            add(family, grant.format(name), 1 if held else 2)
        for name, about in itertools.product(names, ABOUT_HELD if held else ABOUT):
            add(UNKNOWN, about.format(name), 1 if held else 2)
    if not held:
        for family, texts in NOTICES.items():
            for text in texts:
                add(family, text, 12)
                words = text.split()
                for cut in range(2, 4):  # wrapped otherwise, or broken off
                    add(family, " ".join(words[: len(words) - len(words) // (2 * cut)]), 4)
        for family, names in SPDX.items():
            for name in names:
                add(family, f"SPDX-License-Identifier: {name}", 8)
        for text in OTHERS:
            add(UNKNOWN, text, 8)
    for name, grant in itertools.product(STRANGE_HELD if held else STRANGE, [*(GRANTS_HELD if held else GRANTS), *STRANGE_GRANTS]):
        add(UNKNOWN, grant.format(name), 1 if held else 2)
    anchors = sorted(ANCHORS)
    for _ in range(100 if held else 600):  # loose licence words among others
        found.append(([*rnd.choices(filler, k=rnd.randrange(3, 12)), *rnd.choices(anchors, k=1), *rnd.choices(filler, k=rnd.randrange(3, 12))], UNKNOWN))
    return [w for w, _ in found], [f for _, f in found]


@functools.cache
def model() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Class names, weights by feature (scaled by the temperature), and the intercepts, of which that of "unknown" is the largest."""
    names = [*TEMPLATES, UNKNOWN]
    place = {n: i for i, n in enumerate(names)}
    x, y = samples(False)
    sets = [features(w) for w in x]
    times: dict[str, int] = {}
    for s in sets:
        for g in s:
            times[g] = times.get(g, 0) + 1
    known = sorted(g for g, n in times.items() if n >= 4)
    at = {g: i for i, g in enumerate(known)}

    def matrix(sets: list[set[str]]) -> np.ndarray:
        m = np.zeros((len(sets), len(known)), dtype=np.float32)
        for i, s in enumerate(sets):
            m[i, [at[g] for g in s if g in at]] = 1
        return m

    def chances(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    train, goal = matrix(sets), np.eye(len(names), dtype=np.float32)[[place[f] for f in y]]
    w, b = np.zeros((len(known), len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    b[place[UNKNOWN]] = 2  # a paragraph without features is unknown: intercepts are fixed
    v = np.zeros_like(w)
    for _ in range(STEPS):
        d = (chances(train @ w + b) - goal) / len(train)
        v = 0.9 * v - RATE * (train.T @ d + DECAY * w)
        w = w + v
    x, y = samples(True)
    z, own = matrix([features(t) for t in x]) @ w + b, np.array([place[f] for f in y])
    loss = {t: -np.log(chances(z / t)[np.arange(len(own)), own] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    t = min(loss, key=loss.get)
    return names, {g: [round(float(a), 5) for a in row / t] for g, row in zip(known, w, strict=True)}, [round(float(a), 5) for a in b / t]


def _local(spark: SparkSession, rows: list[list], schema: str) -> DataFrame:
    """A small fixed table as a literal."""
    names = [c.split()[0] for c in schema.split(";")]
    struct = ", ".join(f"{n}: {c.split()[1]}" for n, c in zip(names, schema.split(";"), strict=True))
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows], ensure_ascii=True)
    return spark.range(1).select(F.explode(F.from_json(F.lit(data), f"array<struct<{struct}>>")).alias("x")).select("x.*")


def _all_grams(words: F.Column, most: int) -> F.Column:
    """Distinct grams of an array of words."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.flatten(F.array(*[F.when(F.size(words) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)])))


def _once(value: F.Column, of) -> F.Column:
    """of(value) with the value computed once for a row, and not again for each element that a function in it looks at."""
    return F.transform(F.array(value), of)[0]


def _features(words: F.Column) -> F.Column:
    """`features` of an array of words."""
    anchors = F.array(*[F.lit(a) for a in sorted(ANCHORS)])
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(anchors, w), i + 1)), lambda i: i.isNotNull())
    none = F.array().cast("array<string>")

    def one(p: F.Column, n: int) -> F.Column:
        first, last = F.greatest(p - n + 1, F.lit(1)), F.least(p, F.size(words) - n + 1)
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    with_anchor = F.flatten(F.transform(places, lambda p: F.flatten(F.array(*[one(p, n) for n in range(1, FEATURE + 1)]))))
    near = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - CONTEXT, F.lit(1)), F.least(p + CONTEXT, F.size(words))))))

    def beside(n: int) -> F.Column:
        return F.transform(F.filter(near, lambda i: i + n - 1 <= F.size(words)), lambda i: F.concat(F.lit("~"), F.array_join(F.slice(words, i, n), " ")))

    return F.array_distinct(F.concat(with_anchor, *[beside(n) for n in range(1, NEAR + 1)]))


def classified(paragraphs: DataFrame) -> DataFrame:
    """(words, family, probability, agreement, confirmed) for each distinct text of space-joined words: its class, or unknown."""
    spark = paragraphs.sparkSession
    names, weights, base = model()
    k = len(names)
    table = _local(spark, [[g, w] for g, w in weights.items()], "gram string;w array<double>")
    parts = [(f, i, grams(tokens(t))) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    templates = _local(spark, [[g, [{"family": f, "nth": i, "size": len(s)} for f, i, s in parts if g in s]] for g in sorted(set().union(*[s for _, _, s in parts]))], "gram string;of array<struct<family:string,nth:int,size:int>>")
    distinct = paragraphs.select("words").distinct()
    # Both tables are fixed, a few MB: safe to broadcast. A paragraph without known features has the intercepts alone.
    each = distinct.select("words", F.explode_outer(_once(F.split("words", " "), _features)).alias("gram"))
    sums = each.join(F.broadcast(table), "gram", "left").groupBy("words").agg(F.array(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) + F.lit(base[i]) for i in range(k)]).alias("z"))
    top = F.array_max("z")
    mass = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("z")))
    best = sums.select("words", F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("z", top).cast("int")).alias("best"), (F.lit(1.0) / mass).alias("probability"))
    sure = (F.col("best") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY)
    compared = best.filter(sure).withColumn("grams", _once(F.split("words", " "), lambda w: _all_grams(w, GRAM))).select("words", "best", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    met = compared.join(F.broadcast(templates), "gram").select("words", "n", "best", F.explode("of").alias("t")).filter("best = t.family").groupBy("words", "n", "t.nth", "t.size").agg(F.count("*").alias("shared"))
    near = met.groupBy("words").agg(F.max(F.greatest(F.col("shared") / F.col("size"), F.when(F.col("n") >= 6, F.col("shared") / F.col("n")).otherwise(0.0))).alias("agreement"))
    out = best.join(near, "words", "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    return out.select("words", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), "probability", "agreement", (sure & (F.col("agreement") >= LEAST_AGREEMENT)).alias("confirmed"))


def has_anchor(text: F.Column) -> F.Column:
    """Whether a text has an anchor as a word."""
    inner = "|".join(sorted((re.escape(a) for a in ANCHORS), key=len, reverse=True))
    starts = "".join(sorted({a[0] for a in ANCHORS}))
    return F.lower(text).rlike(rf"(?=[{starts}])(?<![a-z0-9])(?<![a-z0-9][.+\-])(?:{inner})(?![a-z0-9]|[.+\-][a-z0-9])")


def _named(families: list[str]) -> str:
    """A pattern of the names of families in space-joined words, longer ones first."""
    names = {" ".join(tokens(n)) for f in families for n in NAMES[f]}
    return rf"(?<![^ ])(?:{'|'.join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))})(?![^ ])"


def readings(words: F.Column) -> F.Column:
    """Space-joined words as what is to be classified: themselves, or, if they name several families, for each of these without the names of the others."""
    several = F.array(*[F.struct(words.rlike(_named([f])).alias("named"), F.lit(f).alias("family")) for f in NAMES])
    of = F.transform(F.filter(several, lambda x: x["named"]), lambda x: x["family"])

    def alone(f: F.Column) -> F.Column:
        cut = F.coalesce(*[F.when(f == x, F.regexp_replace(words, _named([y for y in NAMES if y != x]), " ")) for x in NAMES])
        return F.trim(F.regexp_replace(cut, " +", " "))

    return _once(of, lambda of: F.when(F.size(of) > 1, F.transform(of, alone)).otherwise(F.array(words)))


def scanned(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """For each row: carried columns, n_paragraphs (with an anchor word), n_unknown, n_confirmed, families (confirmed, sorted, comma-joined), probability (least of the confirmed; null if none).

    A paragraph counts as confirmed if one of its readings is, and as unknown if all are. Null and empty texts have no paragraphs. Only paragraphs with an anchor are shuffled, by their words, and each
    distinct one is classified once; repeated rows get equal results.
    """
    own = ["n_paragraphs", "n_unknown", "n_confirmed", "families", "probability"]
    carry = [c for c in carry if c not in own and c not in ("__row", "__text")]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.col(f"`{text}`").alias("__text"))
    hit = F.coalesce(has_anchor(F.col("__text")), F.lit(False))
    some = given.filter(hit).withColumn("__row", F.monotonically_increasing_id())
    paragraphs = some.select("carried", "__row", F.posexplode(F.split("__text", BREAK)).alias("at", "p")).filter(has_anchor(F.col("p")))
    # Written, as it is read for several steps: the texts are searched once.
    joined = paragraphs.select("carried", "__row", "at", F.array_join(F.regexp_extract_all(F.lower("p"), F.lit(TOKEN), F.lit(0)), " ").alias("words"))
    paragraphs = written(joined.select("carried", "__row", "at", F.explode(readings(F.col("words"))).alias("words")))
    # Written, so that the join with it is of two plain exchanges: Spark then splits a notice that very many documents have.
    found = paragraphs.join(written(classified(paragraphs)), "words")
    of = lambda which=F.lit(True): F.size(F.collect_set(F.when(which, F.col("at")))).cast("long")
    rows = found.groupBy("__row").agg(
        F.first("carried").alias("carried"), of().alias("n_paragraphs"), (of() - of(F.col("family") != UNKNOWN)).alias("n_unknown"), of(F.col("confirmed")).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"), F.round(F.min(F.when(F.col("confirmed"), F.col("probability"))), 6).alias("probability"),
    )
    none = given.filter(~hit).select("carried", *[F.lit(0).cast("long").alias(c) for c in own[:3]], F.lit("").alias("families"), F.lit(None).cast("double").alias("probability"))
    return none.union(rows.select("carried", *own)).select("carried.*", *own)
