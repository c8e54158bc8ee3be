"""Entity standardisation: variants of a node share a spelling, alias chains end in one term, equal triples merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import cleanliness, normalized, stripped
from weftline.operators.lemmas import based
from weftline.runtime import materialised


#: Base forms of words: a small map, or the tables (lexicon, exceptions) of `lemmas.lemmas`.
Lemmas = dict[str, str] | tuple[DataFrame, DataFrame] | None


def _normed(rows: DataFrame, column: str, lemma: Lemmas) -> DataFrame:
    """rows with `norm`, the normal form of a column."""
    if not isinstance(lemma, tuple):
        return rows.withColumn("norm", normalized(F.col(column), lemma))
    plain = rows.withColumn("norm", normalized(F.col(column)))
    return plain.join(based(plain, *lemma), "norm").withColumn("norm", F.col("base")).drop("base")


def node_variants(graph: DataFrame, lemma: Lemmas = None) -> DataFrame:
    """Distinct (norm, variant) over subjects and objects, blank ones left out."""
    nodes = graph.select(F.explode(F.array("subject", "object")).alias("v")).select(stripped(F.col("v")).alias("variant")).filter("variant != ''").distinct()
    return _normed(nodes, "variant", lemma).filter("norm != ''").select("variant", "norm")


def preferred_by_norm(terms: DataFrame, lemma: Lemmas = None) -> DataFrame:
    """(norm, preferred): of terms (pos, term) with the same normal form the last."""
    some = terms.select("pos", "term").filter(stripped(F.col("term")) != "")
    return _normed(some, "term", lemma).groupBy("norm").agg(F.max_by("term", "pos").alias("preferred"))


def canonical_mapping(graph: DataFrame, preferred: DataFrame | None = None, lemma: Lemmas = None) -> DataFrame:
    """(variant, canonical): the preferred term of a normal form, or its cleanest, longest, last variant."""
    variants = node_variants(graph, lemma)
    best = variants.groupBy("norm").agg(F.max_by("variant", F.struct(cleanliness(F.col("variant")), F.length("variant"), F.col("variant"))).alias("canonical"))
    if preferred is not None:
        best = best.join(preferred_by_norm(preferred, lemma), "norm", "left").select("norm", F.coalesce("preferred", "canonical").alias("canonical"))
    return variants.join(best, "norm").select("variant", "canonical")


def replaced(graph: DataFrame, mapping: DataFrame, source: str = "variant", target: str = "canonical") -> DataFrame:
    """graph with subject and object looked up, as they are, in the mapping; those it lacks stay."""
    out = graph
    for field in ("subject", "object"):
        side = mapping.select(F.col(source).alias("__from"), F.col(target).alias("__to"))
        out = out.join(side, out[field] == side["__from"], "left").withColumn(field, F.coalesce("__to", field)).drop("__from", "__to")
    return out.select(*graph.columns)


def canonical_nodes(graph: DataFrame, preferred: DataFrame | None = None, lemma: Lemmas = None) -> DataFrame:
    return replaced(graph, canonical_mapping(graph, preferred, lemma))


def _sorted(df: DataFrame) -> DataFrame:
    """df for a join by sorting. A written table's size is that of its files, many times less than its rows take when a join broadcasts them by way of the driver."""
    return df.hint("merge")


def _hop(steps: DataFrame, cycles: bool) -> DataFrame:
    """steps (term, target), doubled until all are at an end or, with `cycles`, in one: each round joins the table with itself.

    Without cycles that is so once nothing moves. With them the terms that are some term's target get fewer until just ends
    and cycle members are left, which a doubling only exchanges.
    """
    targets = None
    while True:
        to = steps.select(F.col("term").alias("target"), F.col("target").alias("next"))
        moved = materialised(steps.join(_sorted(to), "target", "left").select("term", F.coalesce("next", "target").alias("after"), F.col("target").alias("before")))
        steps = moved.select("term", F.col("after").alias("target"))
        if moved.filter("after != before").isEmpty():
            return steps
        if cycles:
            before, targets = targets, steps.select("target").distinct().count()
            if targets == before:
                return steps


def alias_roots(aliases: DataFrame) -> DataFrame:
    """(term, root) of all terms of the pointers (term, target); of repeated terms the last by target counts.

    A chain ends at the term that points nowhere or at itself. In a cycle each term is its own root, and what leads into
    a cycle has the term where it enters. Pointers are doubled, so a chain of n terms takes log2(n) joins: then
    all are at an end or in a cycle, cycle members are cut loose, and a second doubling finds the entries.
    """
    given = aliases.filter(F.col("term").isNotNull() & F.col("target").isNotNull()).groupBy("term").agg(F.max("target").alias("target")).filter("term != target")
    given = materialised(given)
    terms = materialised(given.select("term").union(given.select("target")).union(aliases.select("term").filter("term is not null")).distinct())
    if given.isEmpty():
        return terms.select("term", F.col("term").alias("root"))
    far = _hop(given, True)
    looped = materialised(far.select("target").distinct().join(_sorted(given.select(F.col("term").alias("target"))), "target", "left_semi"))
    cut = given.join(_sorted(looped.select(F.col("target").alias("term"))), "term", "left_anti")
    ends = _hop(materialised(cut), False)
    return terms.join(_sorted(ends), "term", "left").select("term", F.coalesce("target", "term").alias("root"))


def corrected_mapping(aliases: DataFrame, preferred: DataFrame) -> DataFrame:
    """(term, target): each alias cluster's earliest preferred term (pos, term), or its root; preferred terms map to themselves."""
    wanted = preferred.select("pos", stripped(F.col("term")).alias("term")).filter("term != ''").groupBy("term").agg(F.min("pos").alias("pos"))
    wanted = materialised(wanted)
    roots = materialised(alias_roots(aliases))
    chosen = roots.join(_sorted(wanted), "term").groupBy("root").agg(F.min_by("term", "pos").alias("chosen"))
    mapped = roots.join(_sorted(chosen), "root", "left").select("term", F.coalesce("chosen", "root").alias("target"))
    return mapped.join(_sorted(wanted.select("term")), "term", "left_anti").union(wanted.select("term", F.col("term").alias("target")))


def merged_duplicates(graph: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """One row for each mapped (subject, predicate, object): the first row's fields, the sentences joined by ` | `.

    A sentence is added, in order of pos, unless it is part of what was gathered before. That fold depends on the
    order, so a triple's distinct sentences meet in one sorted array; repeated ones, which the fold would drop, are
    summed up before.
    """
    rows = replaced(graph, mapping, "term", "target") if mapping is not None else graph
    key = ["subject", "predicate", "object"]
    rest = [c for c in rows.columns if c not in (*key, "sentence", "pos")]
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in (*key, "sentence")})
    other = F.struct(*rest) if rest else F.lit(0)
    once = rows.groupBy(*key, "sentence").agg(F.min("pos").alias("pos"), F.min_by(other, "pos").alias("__r"))
    groups = once.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("__s"), F.min("pos").alias("pos"), F.min_by("__r", "pos").alias("__r"))
    add = lambda acc, x: F.when((x["sentence"] == "") | F.contains(acc, x["sentence"]), acc).when(acc == "", x["sentence"]).otherwise(F.concat(acc, F.lit(" | "), x["sentence"]))
    folded = groups.withColumn("sentence", F.aggregate("__s", F.lit(""), add))
    return folded.withColumns({c: F.col(f"__r.{c}") for c in rest}).select(*graph.columns)


def standardized(graph: DataFrame, aliases: DataFrame, preferred: DataFrame, lemma: Lemmas = None) -> DataFrame:
    """The whole flow: canonical nodes, corrected aliases, merged duplicates."""
    return merged_duplicates(canonical_nodes(graph, preferred, lemma), corrected_mapping(aliases, preferred))
