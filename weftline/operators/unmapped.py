"""Filters: what is finished, canonical already, or unmapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import ALREADY_CANONICAL, stripped


def remaining(rows: DataFrame, finished: DataFrame, key: str = "triplet_id") -> DataFrame:
    """Rows that the checkpoint lacks."""
    return rows.join(finished.select(key).distinct(), key, "left_anti")


def resumed(rows: DataFrame, finished: DataFrame, key: str = "triplet_id") -> DataFrame:
    """The checkpoint's last record for each row that it has, once for each such row, with the row's pos."""
    return rows.select("pos", key).join(last_records(finished, key).drop("pos"), key)


def last_records(finished: DataFrame, key: str = "triplet_id") -> DataFrame:
    """Of the records of a key the one with the largest pos."""
    return finished.groupBy(key).agg(F.max_by(F.struct(*[c for c in finished.columns if c != key]), "pos").alias("__r")).select(key, "__r.*")


def beyond_prefix(rows: DataFrame, done: int) -> DataFrame:
    """Rows after the first `done` positions."""
    return rows.filter(F.col("pos") >= done)


def split_canonical(rows: DataFrame, ontology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose predicate is an ontology relation, the others)."""
    names = ontology.select(F.col("relation").alias("__name")).distinct()
    on = rows["predicate"] == names["__name"]
    return rows.join(names, on, "left_semi"), rows.join(names, on, "left_anti")


def _flag(rows: DataFrame, default: bool) -> Column:
    return F.coalesce(F.col("canonicalized"), F.lit(default)) if "canonicalized" in rows.columns else F.lit(default)


def unmapped_for_self(rows: DataFrame, prefix: str = "(already canonical") -> DataFrame:
    """Not canonicalised, and not because the predicate was canonical from the start. A missing flag counts as not canonicalised."""
    return rows.filter(~_flag(rows, False) & ~F.lower(F.coalesce("predicate_definition", F.lit(""))).startswith(prefix))


def unmapped_for_clusters(rows: DataFrame) -> DataFrame:
    """Not canonicalised; a missing flag counts as canonicalised."""
    return rows.filter(~_flag(rows, True))


def needs_definition(definition: Column) -> Column:
    """Whether a definition is missing or only says that none was made."""
    return F.lower(stripped(F.coalesce(definition, F.lit("")))).isin("", ALREADY_CANONICAL.lower())


def first_unmapped(rows: DataFrame) -> DataFrame:
    """(key, predicate, definition) of the first unmapped row of each predicate, by its stripped lower-cased name."""
    name = F.coalesce(F.nullif(F.col("original_predicate"), F.lit("")), F.col("predicate"), F.lit(""))
    keyed = unmapped_for_clusters(rows).withColumn("__name", name).withColumn("key", F.lower(stripped(F.col("__name")))).filter("key != ''")
    first = keyed.groupBy("key").agg(F.min_by(F.struct("__name", F.coalesce("predicate_definition", F.lit("")).alias("d")), "pos").alias("f"))
    return first.select("key", F.col("f.__name").alias("predicate"), F.col("f.d").alias("definition"))


def definition_cache(records: DataFrame) -> DataFrame:
    """(key, definition): the first non-empty response (pos, predicate, response) of each stripped lower-cased predicate."""
    key = stripped(F.lower("predicate"))
    return records.filter(F.coalesce(F.col("response"), F.lit("")) != "").groupBy(key.alias("key")).agg(F.min_by("response", "pos").alias("definition"))
