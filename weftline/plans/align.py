"""Target alignment: define the predicate, retrieve candidates, let a model choose, take the chosen relation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import runtime
from weftline.functions.answers import canonical_predicate, letter_choice, loose_letter, strict_letter
from weftline.functions.ids import triplet_id
from weftline.functions.text import ALREADY_CANONICAL, cache_key, choice_prompt_of, choices_text, definition_prompt, none_letter
from weftline.operators.cache import added, look_up
from weftline.operators.models import Completer, Embedder, completed, embedded, for_distinct
from weftline.operators.retrieval import top_candidates_column, top_k
from weftline.operators.unmapped import definition_cache, remaining, resumed
from weftline.runtime import beside, materialised, spread

EMPTY = "array<struct<relation: string, similarity: double>>"


def identified(graph: DataFrame) -> DataFrame:
    """graph with triplet_id, computed from its four fields (a missing one as an empty text)."""
    return graph.withColumn("triplet_id", triplet_id(*[F.coalesce(c, F.lit("")) for c in ("sentence", "subject", "predicate", "object")]))


def _definitions(rows: DataFrame, define: Callable[[], Completer], cache: str | None = None) -> DataFrame:
    """(predicate, definition_call, predicate_definition) of each spelling of a predicate: one call for each predicate, in its first row's context, but for those that the table `cache` holds; it gets the new ones."""
    # Least positions are found in hash tables, over two columns; with the texts beside them all rows would be sorted. The texts are then those of the rows found.
    spelt = materialised(rows.groupBy("predicate").agg(F.min("pos").alias("pos")).withColumn("__key", cache_key(F.coalesce("predicate", F.lit("")))))
    at = beside(spelt.groupBy("__key").agg(F.min(F.struct(F.col("pos").isNull().alias("unknown"), "pos", "predicate")).alias("f")).select("__key", F.col("f.pos").alias("__pos"), F.col("f.predicate").alias("__predicate")))
    there = rows.join(at, rows["predicate"].eqNullSafe(at["__predicate"]) & rows["pos"].eqNullSafe(at["__pos"]))
    first = there.groupBy("__key").agg(F.min(F.struct("sentence", "subject", "predicate", "object")).alias("r"), F.min("pos").alias("pos")).select("__key", "pos", "r.*")
    prompt = definition_prompt(F.col("sentence"), F.col("subject"), F.col("predicate"), F.col("object"), in_context=False)
    held = None
    if cache is not None:
        first = materialised(first)
        held = materialised(look_up(first.select(F.col("__key").alias("key")), cache))
        first = first.join(held.select(F.col("key").alias("__key")), "__key", "left_anti")
    # Materialised, as the cache and the calls both read it: a predicate is asked for once.
    asked = materialised(completed(first.select("__key", "pos", "predicate", prompt.alias("__prompt")), "__prompt", define, 150, "definition_call", kept=False))
    known = definition_cache(asked.select("pos", "predicate", F.col("definition_call.text").alias("response")))
    side = asked.select("__key", "definition_call").join(known.select(F.col("key").alias("__key"), "definition"), "__key", "left")
    if held is not None:
        added(known.select("key", "definition"), cache)
        side = side.unionByName(held.select(F.col("key").alias("__key"), F.lit(None).cast(dict(asked.dtypes)["definition_call"]).alias("definition_call"), "definition"))
    return spelt.join(side, "__key").select("predicate", "definition_call", F.coalesce("definition", F.lit("")).alias("predicate_definition"))


def aligned(
    graph: DataFrame, ontology: DataFrame, define: Callable[[], Completer], choose: Callable[[], Completer], embedder: Callable[[], Embedder],
    top: int = 5, mode: str = "final", finished: DataFrame | None = None, cache: str | None = None,
) -> DataFrame:
    """graph with triplet_id, original_predicate, predicate_definition, canonical_predicate, canonicalized, top_candidates, the two calls, processed_at.

    mode "final": predicates that are relations already pass by unasked, definitions are made for each row, answers
    are read strictly. mode "cached": one definition a predicate, loose reading, no passing by; `cache` is a folder of definitions
    that is kept between runs (see `operators.cache`). Rows of `finished` (a
    checkpoint with these columns) are not computed again. ontology: relation, rel_idx, def (small: broadcast by blocks).
    """
    if mode not in ("final", "cached") or not 1 <= top <= 25 or (cache is not None and mode == "final"):
        raise ValueError("mode is final or cached, top from 1 to 25; only cached takes a cache")
    rows = identified(graph) if finished is not None else graph
    todo = remaining(rows, finished) if finished is not None else rows
    relations = embedded(ontology.select("relation", "rel_idx", "def"), "def", embedder, "vector")
    names = ontology.select(F.col("relation").alias("__name")).distinct()
    same = todo["predicate"] == names["__name"]
    passed = todo.join(names, same, "left_semi") if mode == "final" else None
    asked = todo.join(names, same, "left_anti") if mode == "final" else todo

    def candidates(texts: DataFrame) -> DataFrame:
        found = top_k(embedded(texts, "predicate_definition", embedder, "__vector"), relations, "__vector", "vector", top)
        choices = F.transform(F.coalesce("found", F.array()), lambda c: F.struct(c["relation"].alias("relation"), F.coalesce(c["def"], F.lit("")).alias("def")))
        found = found.select("predicate_definition", choices.alias("__choices"), F.coalesce(top_candidates_column(), F.array().cast(EMPTY)).alias("top_candidates"))
        return found.select("predicate_definition", choices_text(F.col("__choices")).alias("__lines"), none_letter(F.col("__choices")).alias("__none"), "top_candidates")

    fields = [F.col(c) for c in ("sentence", "subject", "predicate", "object")]
    if mode == "final":
        defined = completed(spread(asked).withColumn("__prompt", definition_prompt(*fields)), "__prompt", define, 150, "definition_call", kept=False).withColumn("predicate_definition", F.col("definition_call.text"))
        found = for_distinct(materialised(defined), "predicate_definition", candidates)
    else:
        # What belongs to a predicate is made beside the rows, which are then read and dealt once.
        side = beside(for_distinct(_definitions(asked, define, cache), "predicate_definition", candidates).withColumnRenamed("predicate", "__predicate"))
        found = spread(asked).join(side, asked["predicate"].eqNullSafe(side["__predicate"])).drop("__predicate")
        if side.count() <= runtime.FEW_ROWS:  # a broadcast table is joined again after the calls, which then hand little back; with a sorted one that would cost more than it saves
            found = found.drop("definition_call", "top_candidates")
    prompted = found.withColumn("__prompt", choice_prompt_of(*fields, F.col("predicate_definition"), F.col("__lines"), F.col("__none"))).drop("__lines", "__none")
    answered = completed(prompted, "__prompt", choose, 10, "choice_call", kept=False)
    if "top_candidates" not in answered.columns:
        later = side.select(F.col("__predicate"), "definition_call", "top_candidates")
        answered = answered.join(later, answered["predicate"].eqNullSafe(later["__predicate"])).drop("__predicate")
    answered = answered.withColumn("__names", F.col("top_candidates")["relation"])
    letter = (strict_letter if mode == "final" else loose_letter)(F.col("choice_call.text"), F.size("__names"))
    done = answered.withColumn("__letter", letter).withColumn("__chosen", letter_choice(F.col("__letter"), F.col("__names")))
    if finished is None:  # the ids are nothing that a step needs: last, so that who does not read them does not pay for them
        done, passed = identified(done), identified(passed) if passed is not None else None
    columns = [c for c in graph.columns if c != "triplet_id"]
    calls = ("definition_call", "choice_call")
    out = done.select(
        *columns, "triplet_id", F.col("predicate").alias("original_predicate"), "predicate_definition", canonical_predicate(F.col("__chosen"), F.col("predicate")).alias("canonical_predicate"),
        F.col("__chosen").isNotNull().alias("canonicalized"), "top_candidates", *calls, F.current_timestamp().alias("processed_at"),
    )
    if passed is not None:
        none = [F.lit(None).cast(dict(out.dtypes)[c]).alias(c) for c in calls]
        out = out.unionByName(passed.select(
            *columns, "triplet_id", F.col("predicate").alias("original_predicate"), F.lit(ALREADY_CANONICAL).alias("predicate_definition"), F.col("predicate").alias("canonical_predicate"),
            F.lit(False).alias("canonicalized"), F.array().cast(EMPTY).alias("top_candidates"), *none, F.current_timestamp().alias("processed_at"),
        ))
    return out.unionByName(resumed(rows, finished).select(*out.columns), allowMissingColumns=True) if finished is not None else out
