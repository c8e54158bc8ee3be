"""Base forms of nouns: suffix rules and exceptions make candidates, a lexicon table says which are words.

A word with exceptions has itself and those as candidates; any other itself and what the rules make of it. Of the candidates
in the lexicon the shortest counts, of equally long ones the first. Where there is none, the rules are applied to what
they made, until something is found or nothing is left; then the word stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import materialised

#: Endings of plural nouns and what stands for them, in the order in which they are tried.
ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def _made(form: Column) -> Column:
    """What the rules make of a form, in their order."""
    each = [F.when(form.endswith(old), F.concat(F.substr(form, F.lit(1), F.length(form) - len(old)), F.lit(new))) for old, new in ENDINGS]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _found(tried: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, lemma) of rows (word, nth, form) with a form in the lexicon (form)."""
    return tried.join(lexicon, "form", "left_semi").groupBy("word").agg(F.min_by("form", F.struct(F.length("form"), "nth")).alias("lemma"))


def lemmas(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(word, lemma) of the distinct words (word) that have another base form. lexicon: word; exceptions: word, lemma, pos (the order of a word's lemmas)."""
    known = materialised(lexicon.select(F.col("word").alias("form")).filter("form is not null").distinct())
    given = words.select("word").filter("word is not null").distinct()
    irregular = exceptions.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lemma"))), lambda x: x["lemma"]).alias("own"))
    first = given.join(irregular, "word", "left").withColumn("forms", F.concat(F.array("word"), F.coalesce("own", _made(F.col("word")))))
    tried = materialised(first.select("word", F.col("own").isNotNull().alias("last"), F.posexplode("forms").alias("nth", "form")))
    out = materialised(_found(tried.drop("last"), known))
    # Only words that the rules may still change go on; each round shortens them.
    open_ = tried.filter("not last and nth > 0").join(out, "word", "left_anti").select("word", "nth", "form")
    while True:
        more = open_.select("word", "nth", F.posexplode(_made(F.col("form"))).alias("k", "form"))
        open_ = materialised(more.select("word", (F.col("nth") * len(ENDINGS) + F.col("k")).cast("long").alias("nth"), "form"))
        if open_.isEmpty():
            break
        now = materialised(_found(open_, known))
        out = out.unionByName(now)
        open_ = open_.join(now, "word", "left_anti")
    return out.filter("word != lemma")


def based(norms: DataFrame, lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(norm, base) of the distinct texts (norm) of words between spaces: each word replaced by its base form."""
    given = materialised(norms.select("norm").distinct())
    each = given.select("norm", F.posexplode(F.split("norm", " ")).alias("at", "word"))
    table = materialised(lemmas(each.select("word"), lexicon, exceptions))
    met = each.join(table, "word", "left").select("norm", "at", F.coalesce("lemma", "word").alias("w"))
    return met.groupBy("norm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), " ").alias("base"))
