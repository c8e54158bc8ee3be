"""Building the ontology table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.json_parts import write_array


def relation_definitions(srdef: DataFrame) -> DataFrame:
    """(relation, def) of the relations and their inverses in SRDEF rows (pos, kind, name, def, inverse).

    A row names its relation first and its inverse second; the first definition of a name stays.
    """
    rows = srdef.filter(F.col("kind") == "RL")
    names = rows.select("pos", "def", F.posexplode(F.array(F.trim("name"), F.trim("inverse"))).alias("nth", "relation"))
    return names.filter(F.coalesce(F.col("relation"), F.lit("")) != "").groupBy("relation").agg(F.min_by(F.trim("def"), F.struct("pos", "nth")).alias("def"))


def relation_triples(triples: DataFrame) -> DataFrame:
    """(relation, triplets) with each predicate's triples in input order; null predicates are left out.

    A relation's triples are one array, as an ontology is small; for open graphs use aggregates instead.
    """
    t = F.struct(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    listed = triples.filter(F.col("predicate").isNotNull()).groupBy(F.col("predicate").alias("relation")).agg(F.array_sort(F.collect_list(F.struct("pos", t.alias("t")))).alias("x"))
    return listed.select("relation", F.transform("x", lambda x: x["t"]).alias("triplets"))


def ontology(triples: DataFrame, definitions: DataFrame) -> DataFrame:
    """(relation, rel_idx, def, triplets): each predicate with its definition, or an empty one. rel_idx follows the sorted names."""
    from pyspark.sql import Window

    rows = relation_triples(triples).join(definitions, "relation", "left").withColumn("def", F.coalesce("def", F.lit("")))
    return rows.withColumn("rel_idx", (F.row_number().over(Window.orderBy("relation")) - 1).cast("int")).select("relation", "rel_idx", "def", "triplets")


def _body() -> Column:
    return F.struct(F.transform("triplets", lambda t: F.array(t["s"], t["p"], t["o"])).alias("triplets"), F.col("def"))


def keyed_json(table: DataFrame) -> DataFrame:
    """One row with the ontology as a JSON object keyed by relation; for large ones see `write_keyed_json`."""
    return table.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", _body().alias("body")))))).alias("json"))


def write_keyed_json(table: DataFrame, path: str, indent: int = 2) -> list[str]:
    """The ontology as a JSON object keyed by relation, in the order of relations, written in parts (see `json_parts.write_array`); returns the parts."""
    return write_array(table.select("relation", F.to_json(_body()).alias("body")), path, ["relation"], indent, key="relation", value="body")
