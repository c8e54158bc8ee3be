"""Mapping each triple to one of its retrieved candidates, and labelling what stays unmapped by clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import candidate_block, cluster_text, first_line, label_prompt, mapping_prompt
from weftline.operators.clusters import cluster_members, clustered, labelled, mapping_applied, predicate_labels, split_single
from weftline.operators.models import Completer, Embedder, completed, embedded
from weftline.operators.unmapped import first_unmapped
from weftline.runtime import materialised


def with_definitions(graph: DataFrame, ontology: DataFrame) -> DataFrame:
    """graph with `candidates`: candidates_rel with each relation's def and triplets (empty if the ontology lacks it), order kept."""
    each = graph.select("pos", F.posexplode_outer("candidates_rel").alias("nth", "c")).join(ontology.select("relation", "def", "triplets"), F.col("c.relation") == F.col("relation"), "left")
    entry = F.struct("nth", F.col("c.relation").alias("relation"), F.coalesce("def", F.lit("")).alias("def"), F.coalesce("triplets", F.array().cast(dict(ontology.dtypes)["triplets"])).alias("triplets"), F.col("c.score").alias("score"))
    lists = each.filter("nth is not null").groupBy("pos").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    return graph.join(lists, "pos", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(dict(lists.dtypes)["candidates"])))


def mapped(graph: DataFrame, ontology: DataFrame, factory: Callable[[], Completer], short: bool = False, max_tokens: int = 64, done: int = 0) -> DataFrame:
    """graph (with candidates_rel) with predicted_relation and is_valid, whether that is a candidate or not_mapped.

    short: brief candidate blocks and first lines only. A call that keeps failing predicts `error`. Rows before position
    `done` are left out, as finished before.
    """
    rows = with_definitions(graph.filter(F.col("pos") >= done) if done else graph, ontology)
    block = candidate_block(F.col("candidates"), *((5, 150) if short else (15, None)))
    asked = rows.withColumn("__prompt", mapping_prompt(F.col("sentence"), F.col("subject"), F.col("predicate"), F.col("object"), block, framed=not short))
    out = completed(asked, "__prompt", factory, max_tokens, "__call").withColumn("predicted_relation", F.when(F.col("__call.error").isNotNull(), "error").otherwise(first_line(F.col("__call.text"), short)))
    valid = (F.col("predicted_relation") == "not_mapped") | F.array_contains(F.transform("candidates", lambda c: c["relation"]), F.col("predicted_relation"))
    return out.withColumn("is_valid", valid).drop("__prompt", "__call", "candidates")


def relabelled(records: DataFrame, embedder: Callable[[], Embedder], factory: Callable[[], Completer], threshold: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(records with cluster labels applied, the clusters with members and labels). Without unmapped rows the records come back as they are."""
    found = materialised(first_unmapped(records).orderBy("key").withColumn("id", F.monotonically_increasing_id()))
    vectors = embedded(found.withColumn("__text", cluster_text(F.col("predicate"), F.col("definition"))), "__text", embedder, "vector")
    members = materialised(cluster_members(found, clustered(vectors.select("id", "vector"), threshold)))
    several = split_single(members)[1].withColumn("__prompt", label_prompt(F.col("members")))
    # Materialised, as the labels are returned and applied: a cluster is asked for once.
    answers = materialised(completed(several, "__prompt", factory, 20, "__call").select("cluster", F.col("__call.text").alias("answer")))
    labels = labelled(members, answers)
    return mapping_applied(records, predicate_labels(labels)), labels
