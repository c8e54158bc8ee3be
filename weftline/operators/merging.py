"""Post-processing of aligned graphs: reverting, replacing, merging, set operations and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import cache_key, is_isa, isa_normalized, stripped


def predicate_replaced(graph: DataFrame) -> DataFrame:
    """Where canonical_predicate is not blank: it becomes the predicate, and the old one original_predicate."""
    has = stripped(F.coalesce("canonical_predicate", F.lit(""))) != ""
    old = F.col("original_predicate") if "original_predicate" in graph.columns else F.lit(None).cast("string")
    return graph.withColumns({"original_predicate": F.when(has, F.col("predicate")).otherwise(old), "predicate": F.when(has, F.col("canonical_predicate")).otherwise(F.col("predicate"))})


def reverted_below(graph: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Canonicalised rows whose canonical relation is under the threshold, or no candidate, get their own predicate back.

    The first candidate of that name counts; its similarity becomes canonical_similarity. Other rows stay.
    """
    mine = F.try_element_at(F.filter("top_candidates", lambda c: c["relation"] == F.col("canonical_predicate")), F.lit(1))["similarity"]
    on = F.coalesce("canonicalized", F.lit(False))
    weak = on & (mine.isNull() | (mine < threshold))
    return graph.withColumns({
        "predicate": F.when(weak, F.col("original_predicate")).when(on, F.col("canonical_predicate")).otherwise(F.col("predicate")),
        "canonicalized": F.when(weak, F.lit(False)).otherwise(F.col("canonicalized")),
        "canonical_similarity": F.when(on, mine),
    })


def self_mapped_merged(aligned: DataFrame, own: DataFrame) -> DataFrame:
    """aligned with whole rows replaced by those of `own` with the same triplet_id, of several the last by pos; from_self tells which.

    Columns that only one side has are null in the other's rows.
    """
    columns = list(dict.fromkeys([*aligned.columns, *own.columns]))
    last = own.groupBy("triplet_id").agg(F.max_by(F.struct(*own.columns), "pos").alias("__own"))
    kinds = dict(own.dtypes) | dict(aligned.dtypes)
    value = lambda c: F.when(F.col("__own").isNotNull(), F.col(f"__own.{c}") if c in own.columns else F.lit(None).cast(kinds[c])).otherwise(F.col(c) if c in aligned.columns else F.lit(None).cast(kinds[c]))
    joined = aligned.join(last, "triplet_id", "left")
    return joined.select(*[(F.col(c) if c in ("pos", "triplet_id") else value(c)).alias(c) for c in columns], F.col("__own").isNotNull().alias("from_self"))


def merge_counters(merged: DataFrame) -> DataFrame:
    on = F.coalesce("canonicalized", F.lit(False))
    return merged.agg(F.count_if(~F.col("from_self")).alias("n_onto"), F.count_if("from_self").alias("n_self"), F.count_if(F.col("from_self") & on).alias("n_fused"), F.count_if(F.col("from_self") & ~on).alias("n_added"))


def union_normalized(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, duplicates kept, columns by name; predicates that mean `isa` normalised. `part` keeps their order."""
    both = first.withColumn("part", F.lit(1)).unionByName(second.withColumn("part", F.lit(2)), allowMissingColumns=True)
    return both.withColumns({"normalized": is_isa(F.col("predicate")), "predicate": isa_normalized(F.col("predicate"))})


def entities(graph: DataFrame) -> DataFrame:
    """Distinct stripped, lower-cased subjects and objects."""
    return graph.select(F.explode(F.array("subject", "object")).alias("e")).select(F.lower(stripped(F.col("e"))).alias("entity")).filter("entity is not null").distinct()


def vocabulary_overlap(graph: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms (column term) that are entities of the graph, lower-cased."""
    own = terms.select(F.lower(stripped(F.col("term"))).alias("entity")).filter("entity is not null").distinct()
    return own.intersect(entities(graph))


def unique_predicates(graph: DataFrame) -> DataFrame:
    """The number of distinct predicates, null counted as one."""
    return graph.agg((F.count_distinct("predicate") + F.max(F.col("predicate").isNull().cast("int"))).alias("n_predicates"))


def report(aligned: DataFrame) -> DataFrame:
    """Totals, and how many rows are canonicalised, as a number and in percent of at least one row."""
    n = F.count("*")
    on = F.count_if(F.coalesce("canonicalized", F.lit(False)))
    return aligned.agg(n.alias("total"), on.alias("n_canonicalized"), F.round(100 * on / F.greatest(n, F.lit(1)), 1).alias("pct_canonicalized"), (n - on).alias("n_unmapped"))


def run_counters(rows: DataFrame, finished: DataFrame | None = None, cached: bool = False, key: str = "triplet_id") -> DataFrame:
    """One row about a run's result (with the call columns of `plans.align`): total, n_skipped (rows of the checkpoint `finished`), n_definition_calls and n_choice_calls (attempts in this run), n_failed_calls.

    cached: rows of one predicate share a definition call, which counts once. Rows of the checkpoint and rows that passed by unasked have no calls.
    """
    done = finished.select(key).distinct().withColumn("__done", F.lit(True)) if finished is not None else None
    marked = rows.join(done, key, "left") if done is not None else rows.withColumn("__done", F.lit(None).cast("boolean"))
    own = F.col("__done").isNull()
    call = lambda c: F.when(own & F.col(c).isNotNull(), F.struct(F.col(f"{c}.attempts").alias("n"), F.col(f"{c}.error").isNotNull().cast("long").alias("bad")))
    each = marked.select(own.alias("own"), cache_key(F.coalesce("original_predicate", F.lit(""))).alias("k"), call("definition_call").alias("d"), call("choice_call").alias("c"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    defined = each.groupBy("k").agg(F.max("d").alias("d")) if cached else each
    one = defined.agg(zero("d.n").alias("n_definition_calls"), zero("d.bad").alias("bad"))
    all_ = each.agg(F.count("*").alias("total"), zero((~F.col("own")).cast("long")).alias("n_skipped"), zero("c.n").alias("n_choice_calls"), zero("c.bad").alias("worse"))
    # Two tables of one row each.
    both = all_.withColumn("one", F.lit(1)).join(one.withColumn("one", F.lit(1)), "one")
    return both.select("total", "n_skipped", "n_definition_calls", "n_choice_calls", (F.col("bad") + F.col("worse")).alias("n_failed_calls"))


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]
