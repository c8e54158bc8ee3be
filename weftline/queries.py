"""The registered queries of the engine's own operators, over graphs derived from the driver tables, and their SQL.

Each query runs its operator over whole tables. The SQL is written for DuckDB and states the same rule independently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import answers as A
from weftline.functions import text as X
from weftline.functions.ids import triplet_id
from weftline.operators import clusters, merging, ontology, retrieval, standardize, unmapped
from weftline.operators.models import FunctionCompleter, LetterCounts
from weftline.plans import align, mapping, self_canonical

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph: nations in regions, suppliers and customers in nations, and what users did on which day."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = lambda pos, sentence, s, p, o: [pos.cast("bigint").alias("pos"), sentence.alias("sentence"), s.alias("subject"), p.alias("predicate"), o.alias("object")]
    c, lit = F.col, F.lit
    parts = [
        nation.join(region, c("n_regionkey") == c("r_regionkey")).select(*row(c("n_nationkey"), F.concat("n_name", lit(" lies in "), "r_name"), c("n_name"), lit("part_of"), c("r_name"))),
        table(spark, sf_dir, "supplier").join(nation, c("s_nationkey") == c("n_nationkey")).select(*row(1_000_000 + c("s_suppkey"), F.concat("n_name", lit(" hosts "), "s_name"), c("s_name"), lit("located_in"), c("n_name"))),
        table(spark, sf_dir, "customer").join(nation, c("c_nationkey") == c("n_nationkey")).select(*row(2_000_000_000 + c("c_custkey"), F.concat("c_name", lit(" is a customer in "), "n_name"), c("c_name"), lit("located_in"), c("n_name"))),
        table(spark, sf_dir, "events").select(*row(lit(4_000_000_000_000) + c("event_id"), c("props"), F.concat(lit("user "), c("user_id").cast("string")), c("event_type"), F.date_format("ts", "yyyy-MM-dd"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


KG = """kg AS (
  SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name || ' lies in ' || r_name AS sentence, n_name AS subject, 'part_of' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000 + s_suppkey, n_name || ' hosts ' || s_name, s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 2000000000 + c_custkey, c_name || ' is a customer in ' || n_name, c_name, 'located_in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 4000000000000 + event_id, props, 'user ' || CAST(user_id AS VARCHAR), event_type, strftime(ts, '%Y-%m-%d') FROM events
)"""


def aligned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as an alignment might leave it: every third row canonicalised, with two candidates."""
    name = lambda m: F.concat(F.lit("rel_"), (F.col("pos") % m).cast("string"))
    candidate = lambda m, d: F.struct(name(m).alias("relation"), ((F.col("pos") % d) / 100).alias("similarity"))
    return graph(spark, sf_dir).select(
        "*", F.substring(F.md5(F.col("pos").cast("string").cast("binary")), 1, 16).alias("triplet_id"), F.col("predicate").alias("original_predicate"), F.concat(F.lit("definition of "), "predicate").alias("predicate_definition"),
        F.when(F.col("pos") % 3 == 0, name(7)).otherwise(F.col("predicate")).alias("canonical_predicate"), (F.col("pos") % 3 == 0).alias("canonicalized"), F.array(candidate(5, 100), candidate(7, 90)).alias("top_candidates"),
    )


AL = f"""{KG}, al AS (
  SELECT *, substr(md5(CAST(pos AS VARCHAR)), 1, 16) AS triplet_id, predicate AS original_predicate, 'definition of ' || predicate AS predicate_definition,
    CASE WHEN pos % 3 = 0 THEN 'rel_' || CAST(pos % 7 AS VARCHAR) ELSE predicate END AS canonical_predicate, pos % 3 = 0 AS canonicalized,
    'rel_' || CAST(pos % 5 AS VARCHAR) AS r1, CAST(pos % 100 AS DOUBLE) / 100 AS s1, 'rel_' || CAST(pos % 7 AS VARCHAR) AS r2, CAST(pos % 90 AS DOUBLE) / 100 AS s2 FROM kg
)"""


# Similarity joins over the embeddings: the labels' mean vectors are the relations, every vector is a row.


def label_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_idx, relation, vector and its thirds) of each label's mean vector."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    v = F.transform("v", lambda x: x["x"])
    return means.select((F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("rel_idx"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("relation"), v.alias("vector"), *_thirds(v))


def _thirds(v: F.Column) -> list[F.Column]:
    return [F.slice(v, 1, 21).alias("v1"), F.slice(v, 22, 21).alias("v2"), F.slice(v, 43, 22).alias("v3")]


LABELS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT label, i, avg(v[i]) AS a FROM e, range(1, 65) t(i) GROUP BY label, i),
c AS (SELECT label AS l, 'label_' || CAST(label AS VARCHAR) AS relation, list(a ORDER BY i) AS cv, row_number() OVER (ORDER BY label) - 1 AS rel_idx FROM d GROUP BY label)"""


@registered(f"""WITH {LABELS}, s AS (SELECT vec_id, relation, rel_idx, list_cosine_similarity(v, cv) AS sim FROM e CROSS JOIN c)
SELECT vec_id, rank, relation, round(sim, 6) + 0 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, rel_idx DESC) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = retrieval.top_k(rows, label_relations(spark, sf_dir), "embedding", "vector", 5)
    return found.select("vec_id", F.posexplode("found").alias("n", "f")).select("vec_id", (F.col("n") + 1).cast("long").alias("rank"), "f.relation", F.round("f.score", 6).alias("similarity"))


def _fused(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(f"q{i}") for i, c in enumerate(_thirds(v), 1)])
    return retrieval.weighted_top_k(rows, label_relations(spark, sf_dir), [("q1", "v1", 0.25), ("q2", "v2", 0.25), ("q3", "v3", 0.5)], k)


FUSED = f"""{LABELS}, s AS (SELECT vec_id, relation, rel_idx, list_cosine_similarity(v[1:21], cv[1:21]) AS p1, list_cosine_similarity(v[22:42], cv[22:42]) AS p2, list_cosine_similarity(v[43:64], cv[43:64]) AS p3 FROM e CROSS JOIN c),
f AS (SELECT *, round(0.25 * p1 + 0.25 * p2 + 0.5 * p3, 4) + 0 AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, rel_idx) AS rank FROM f)"""


@registered(f"WITH {FUSED} SELECT vec_id, rank, relation, score, round(p1, 4) + 0 AS pred_name_score, round(p2, 4) + 0 AS pred_def_score, round(p3, 4) + 0 AS triplet_def_score FROM r WHERE rank <= 5")
def weighted_fusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fused(spark, sf_dir).select("vec_id", F.posexplode(retrieval.candidates_column()).alias("n", "c"))
    return found.select("vec_id", (F.col("n") + 1).cast("long").alias("rank"), "c.*")


_ID = """substr(sha1('{"object": ' || to_json(object) || ', "predicate": ' || to_json(predicate) || ', "sentence": ' || to_json(sentence) || ', "subject": ' || to_json(subject) || '}'), 1, 16)"""


@registered(f"WITH {KG} SELECT pos, {_ID} AS triplet_id FROM kg")
def triplet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).select("pos", triplet_id(F.col("sentence"), F.col("subject"), F.col("predicate"), F.col("object")).alias("triplet_id"))


# Ontology.


def type_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples between types: nations and regions, brands and the kinds of their parts, nations and market segments."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = F.col
    one = nation.join(region, c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").cast("bigint").alias("pos"), c("n_name").alias("subject"), F.lit("part_of").alias("predicate"), c("r_name").alias("object"))
    two = table(spark, sf_dir, "part").groupBy(c("p_brand").alias("subject"), c("p_type").alias("object")).agg(F.min("p_partkey").alias("pos")).select("pos", "subject", F.lit("made_as").alias("predicate"), "object")
    three = table(spark, sf_dir, "customer").join(nation, c("c_nationkey") == c("n_nationkey")).groupBy(c("n_name").alias("subject"), c("c_mktsegment").alias("object")).agg(F.min("c_custkey").alias("pos")).select("pos", "subject", F.lit("buys_for").alias("predicate"), "object")
    return one.unionByName(two).unionByName(three)


TYPES = """ty AS (
  SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS subject, 'part_of' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT min(p_partkey), p_brand, 'made_as', p_type FROM part GROUP BY p_brand, p_type
  UNION ALL SELECT min(c_custkey), n_name, 'buys_for', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment
)"""


def definition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a relation file has them: names and inverses repeat, so that the first definition must win."""
    n = table(spark, sf_dir, "nation")
    name = F.element_at(F.array(*[F.lit(x) for x in ("part_of", "made_as", "unused", " buys_for ", "")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    inverse = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("inv_"), (F.col("n_nationkey") % 4).cast("string")))
    return n.select(F.col("n_nationkey").cast("long").alias("pos"), F.when(F.col("n_nationkey") % 8 == 7, "STY").otherwise("RL").alias("kind"), name.alias("name"), F.concat(F.lit(" as in "), "n_name").alias("def"), inverse.alias("inverse"))


DEFS = """df AS (
  SELECT n_nationkey AS pos, trim(['part_of', 'made_as', 'unused', ' buys_for ', ''][n_nationkey % 5 + 1]) AS name, trim(' as in ' || n_name) AS def, CASE WHEN n_nationkey % 3 = 0 THEN 'inv_' || CAST(n_nationkey % 4 AS VARCHAR) END AS inverse FROM nation WHERE n_nationkey % 8 <> 7
), dn AS (SELECT pos, 0 AS nth, name AS relation, def FROM df UNION ALL SELECT pos, 1, inverse, def FROM df),
de AS (SELECT relation, arg_min(def, pos * 2 + nth) AS def FROM dn WHERE relation IS NOT NULL AND relation <> '' GROUP BY relation)"""


@registered(f"WITH {DEFS} SELECT relation, def FROM de")
def relation_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.relation_definitions(definition_rows(spark, sf_dir))


def type_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.ontology(type_triples(spark, sf_dir), ontology.relation_definitions(definition_rows(spark, sf_dir)))


PAIRS = """string_agg('(' || subject || ', ' || object || ')', ', ' ORDER BY pos)"""


@registered(f"""WITH {DEFS}, {TYPES}, n AS (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY pos) AS k FROM ty),
g AS (SELECT predicate AS relation, count(*) AS n_triplets, {PAIRS.replace(')', ')', 1)} FILTER (WHERE k <= 30) AS pairs FROM n GROUP BY predicate)
SELECT g.relation, row_number() OVER (ORDER BY g.relation) - 1 AS rel_idx, coalesce(def, '') AS def, n_triplets,
  'Relation name: ' || g.relation || '. Definition: ' || coalesce(def, '') || '. Possible type pairs: ' || pairs || '.' AS enriched, replace(g.relation, '_', ' ') AS display FROM g LEFT JOIN de ON g.relation = de.relation""")
def ontology_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = type_ontology(spark, sf_dir)
    return o.select("relation", F.col("rel_idx").cast("long").alias("rel_idx"), "def", F.size("triplets").cast("long").alias("n_triplets"), X.enriched_definition(F.col("relation"), F.col("def"), F.col("triplets")).alias("enriched"), X.display_name(F.col("relation")).alias("display"))


@registered(f"""WITH {KG}, {DEFS}, g AS (SELECT predicate, count(*) AS n_triples, count(DISTINCT subject) AS n_subjects, count(DISTINCT object) AS n_objects, arg_min(subject || ' ' || predicate || ' ' || object, pos) AS first_triple FROM kg GROUP BY predicate)
SELECT g.*, coalesce(def, '') AS def FROM g LEFT JOIN de ON g.predicate = de.relation""")
def relation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.triple_text(F.col("subject"), F.col("predicate"), F.col("object"))
    g = graph(spark, sf_dir).groupBy("predicate").agg(F.count("*").alias("n_triples"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("object").alias("n_objects"), F.min_by(text, "pos").alias("first_triple"))
    d = ontology.relation_definitions(definition_rows(spark, sf_dir)).withColumnRenamed("relation", "predicate")
    return g.join(F.broadcast(d), "predicate", "left").withColumn("def", F.coalesce("def", F.lit("")))


# Blocks, choices, prompts and answers.


def labelled_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition and some 25 pairs, of nations and market segments, for the first five label relations: the others are missing, as look-ups must allow."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = F.struct(F.col("n_name").alias("s"), F.lit("in").alias("p"), F.col("c_mktsegment").alias("o"))
    g = rows.groupBy((F.col("n_nationkey") % 5).alias("l")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "c_mktsegment", t.alias("t")))).alias("x"))
    return g.select(F.concat(F.lit("label_"), F.col("l").cast("string")).alias("relation"), F.concat(F.lit("what label "), F.col("l").cast("string"), F.repeat(F.lit(" holds"), 40)).alias("def"), F.transform("x", lambda x: x["t"]).alias("triplets"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with three retrieved candidates each, one for each vector."""
    scored = _fused(spark, sf_dir, 3).select("vec_id", retrieval.candidates_column().alias("candidates_rel"))
    return scored.select(F.col("vec_id").alias("pos"), F.concat(F.lit("sentence "), F.col("vec_id").cast("string")).alias("sentence"), F.lit("a").alias("subject"), F.lit("b").alias("predicate"), F.lit("c").alias("object"), "candidates_rel")


ONTO = """lp AS (SELECT n_nationkey % 5 AS l, '(' || n_name || ', ' || c_mktsegment || ')' AS pair, row_number() OVER (PARTITION BY n_nationkey % 5 ORDER BY n_nationkey, c_mktsegment) AS nth FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) JOIN nation ON c_nationkey = n_nationkey),
lo AS (SELECT 'label_' || CAST(l AS VARCHAR) AS rel, 'what label ' || CAST(l AS VARCHAR) || repeat(' holds', 40) AS def, string_agg(pair, ', ' ORDER BY nth) FILTER (WHERE nth <= 15) AS pairs, string_agg(pair, ', ' ORDER BY nth) FILTER (WHERE nth <= 5) AS few FROM lp GROUP BY l)"""
CANDS = f"""{FUSED}, {ONTO}, k AS (SELECT vec_id, rank, relation, score, coalesce(def, '') AS def, coalesce(pairs, '') AS pairs, coalesce(few, '') AS few FROM r LEFT JOIN lo ON relation = rel WHERE rank <= 3),
b AS (SELECT vec_id, string_agg(rank || '. Relation: ' || relation || chr(10) || 'Definition: ' || def || chr(10) || 'Possible type pairs: ' || pairs || chr(10) || 'Retrieval score: ' || CAST(score AS VARCHAR) || chr(10), chr(10) ORDER BY rank) AS block_long,
  string_agg(rank || '. Relation: ' || relation || chr(10) || 'Definition: ' || substr(def, 1, 150) || chr(10) || 'Possible type pairs: ' || few || chr(10) || 'Retrieval score: ' || CAST(score AS VARCHAR) || chr(10), chr(10) ORDER BY rank) AS block_short,
  string_agg(chr(64 + CAST(rank AS INTEGER)) || '. ''' || relation || ''': ' || def, chr(10) ORDER BY rank) || chr(10) || 'D. None of the above' AS choices FROM k GROUP BY vec_id)"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_filled(template: str, **places: str) -> str:
    """A format as a SQL concatenation."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(_sql_text(p) if i % 2 == 0 else places[p] for i, p in enumerate(parts) if i % 2 or p)


@registered(f"WITH {CANDS} SELECT vec_id AS pos, block_long, block_short, choices, 'D' AS none_letter FROM b")
def candidate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.with_definitions(candidate_rows(spark, sf_dir), labelled_ontology(spark, sf_dir))
    c = F.col("candidates")
    return rows.select("pos", X.candidate_block(c).alias("block_long"), X.candidate_block(c, 5, 150).alias("block_short"), X.choices_text(c).alias("choices"), X.none_letter(c).alias("none_letter"))


@registered(f"""WITH {CANDS}, q AS (SELECT *, 'sentence ' || CAST(vec_id AS VARCHAR) AS sentence FROM b)
SELECT vec_id AS pos, {_sql_filled(X.MAPPING_PROMPT, subject="'a'", predicate="'b'", object="'c'", sentence='sentence', block='block_short')} AS mapping_prompt,
chr(10) || {_sql_filled(X.MAPPING_PROMPT, subject="'a'", predicate="'b'", object="'c'", sentence='sentence', block='block_long')} || chr(10) AS framed_prompt,
{_sql_filled(X.CHOICE_PROMPT, subject="'a'", predicate="'b'", object="'c'", sentence='sentence', definition="'d'", choices='choices', none="'D'")} AS choice_prompt,
{_sql_filled(X.DEFINITION_PROMPT, subject="'a'", predicate="'b'", object="'c'", sentence='sentence', context=_sql_text(X.IN_CONTEXT))} AS definition_prompt FROM q""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.with_definitions(candidate_rows(spark, sf_dir), labelled_ontology(spark, sf_dir))
    c, four = F.col("candidates"), [F.col(x) for x in ("sentence", "subject", "predicate", "object")]
    return rows.select(
        "pos", X.mapping_prompt(*four, X.candidate_block(c, 5, 150)).alias("mapping_prompt"), X.mapping_prompt(*four, X.candidate_block(c), framed=True).alias("framed_prompt"),
        X.choice_prompt(*four, F.lit("d"), c).alias("choice_prompt"), X.definition_prompt(*four).alias("definition_prompt"),
    )


@registered(f"""WITH {CANDS} SELECT vec_id AS pos, CASE WHEN vec_id % 4 = 0 THEN 'not_mapped' WHEN vec_id % 4 = 1 THEN 'something else' ELSE k.relation END AS predicted_relation, vec_id % 4 <> 1 AS is_valid FROM k WHERE rank = 1""")
def map_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping with a stand-in model: it names the first candidate, nothing, or something unknown."""

    def answer(prompt: str) -> str:
        n = int(re.search(r"sentence (\d+)", prompt)[1]) % 4
        return "not_mapped" if n == 0 else "something else" if n == 1 else re.search(r"1\. Relation: (\S+)", prompt)[1] + "\nBecause."

    return mapping.mapped(candidate_rows(spark, sf_dir), labelled_ontology(spark, sf_dir), lambda: FunctionCompleter(answer), short=True).select("pos", "predicted_relation", "is_valid")


ANSWER = "CASE WHEN conv_id % 3 = 0 THEN substr(text, 1, 1) WHEN conv_id % 3 = 1 THEN 'The answer is ' || substr(text, 1, 3) ELSE text END"
ASCII_ANSWER = f"regexp_replace({ANSWER}, '[^ -~\\n]', 'x', 'g')"


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of many forms made of the conversations, in ASCII, as SQL engines differ on other letters."""
    t = F.col("text")
    text = F.when(F.col("conv_id") % 3 == 0, F.substring(t, 1, 1)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("The answer is "), F.substring(t, 1, 3))).otherwise(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(text, "[^ -~\n]", "x").alias("answer"))


@registered(f"""WITH a AS (SELECT conv_id, turn, regexp_replace({ASCII_ANSWER}, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
m AS (SELECT conv_id, turn, upper(coalesce(nullif(regexp_extract(t, '^([A-Z])\\b', 1, 'i'), ''), nullif(regexp_extract(t, '(?:answer[:\\s]+)([A-Z])\\b', 1, 'i'), ''), nullif(regexp_extract(t, '(?:is\\s+)([A-Z])\\b', 1, 'i'), ''), nullif(regexp_extract(t, '^\\s*\\**([A-Z])\\**\\s*$', 1, 'i'), ''))) AS x FROM a)
SELECT conv_id, turn, CASE WHEN x BETWEEN 'A' AND 'E' THEN x END AS letter FROM m""")
def mcq_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_rows(spark, sf_dir).select("conv_id", "turn", A.strict_letter(F.col("answer"), 5).alias("letter"))


@registered(f"""WITH a AS (SELECT conv_id, turn, upper({ASCII_ANSWER}) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, 'A') THEN 'A' WHEN contains(t, 'B') THEN 'B' WHEN contains(t, 'C') THEN 'C' WHEN contains(t, 'D') THEN 'D' WHEN contains(t, 'E') THEN 'E' END AS letter FROM a""")
def mcq_parse_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_rows(spark, sf_dir).select("conv_id", "turn", A.loose_letter(F.col("answer"), 5).alias("letter"))


@registered("""SELECT conv_id, turn, trim(split_part(text, chr(10), 1)) AS first_line, regexp_replace(regexp_extract(regexp_replace(text, '^\\s+', ''), '^(\\S+)', 1), '^[''".,;:]+|[''".,;:]+$', '', 'g') AS label, replace(replace(lower(text), ' ', '_'), '-', '_') AS singleton FROM conversations""")
def answer_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_line(t).alias("first_line"), X.cleaned_label(t, F.lit("none")).alias("label"), X.singleton_label(t).alias("singleton"))


# Entity standardisation.


def variant_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in several spellings, as subjects and objects."""
    name = F.col("p_name")
    spelled = F.when(F.col("p_partkey") % 4 == 0, name).when(F.col("p_partkey") % 4 == 1, F.initcap(name)).when(F.col("p_partkey") % 4 == 2, F.replace(F.upper(name), F.lit(" "), F.lit(" - "))).otherwise(F.concat(name, F.lit("!")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("sentence"), spelled.alias("subject"), F.lit("made_as").alias("predicate"), F.col("p_type").alias("object"))


VARIANTS = """vg AS (SELECT p_partkey AS pos, p_type AS sentence, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') WHEN 2 THEN replace(upper(p_name), ' ', ' - ') ELSE p_name || '!' END AS subject, 'made_as' AS predicate, p_type AS object FROM part)"""
NORM = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(v)), '\\s*-\\s*', '-', 'g'), '[-_/]', ' ', 'g'), '[^\\w\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"""
CLEAN = """(CASE WHEN trim(v) = v THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(v, '[A-Z]') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(v, '[a-z]') AND NOT regexp_matches(v, '[A-Z]') THEN 2 ELSE 0 END
 + 0.5 * len(list_filter(string_split(v, ' '), lambda w: regexp_matches(w, '^[A-Z]'))) - CASE WHEN regexp_matches(v, '\\s-|-\\s') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(v, '\\s{2,}') THEN 2 ELSE 0 END
 - 0.5 * len(regexp_extract_all(v, '[^\\w\\s'']')) + 0.02 * least(length(v), 50))"""
NODES = f"{VARIANTS}, vs AS (SELECT DISTINCT v FROM (SELECT trim(subject) AS v FROM vg UNION ALL SELECT trim(object) FROM vg) WHERE v <> ''), nv AS (SELECT v AS variant, {NORM} AS norm, {CLEAN} AS score FROM vs)"


@registered(f"WITH {NODES} SELECT variant, norm, round(CAST(score AS DOUBLE), 6) AS score FROM nv")
def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.node_variants(variant_graph(spark, sf_dir)).select("variant", "norm", F.round(X.cleanliness(F.col("variant")), 6).alias("score"))


def preferred_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part type in capitals with an ending mark, and some part names."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return p.filter("k % 3 = 0").select(F.col("k").alias("pos"), F.concat(F.initcap("p_name"), F.lit("?")).alias("term"))


PREF = """pt AS (SELECT min(p_partkey) AS pos, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') || '?' AS term FROM part GROUP BY p_name HAVING min(p_partkey) % 3 = 0)"""
MAPPED = f"""{NODES}, {PREF}, pn AS (SELECT {NORM.replace('(v)', '(term)')} AS norm, arg_max(term, pos) AS preferred FROM pt GROUP BY 1),
best AS (SELECT norm, variant, row_number() OVER (PARTITION BY norm ORDER BY score DESC, length(variant) DESC, variant DESC) AS k FROM nv),
cm AS (SELECT nv.variant, coalesce(preferred, best.variant) AS canonical FROM nv JOIN best ON nv.norm = best.norm AND k = 1 LEFT JOIN pn ON nv.norm = pn.norm)"""


@registered(f"WITH {MAPPED} SELECT variant, canonical FROM cm")
def canonical_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.canonical_mapping(variant_graph(spark, sf_dir), preferred_terms(spark, sf_dir))


@registered(f"WITH {MAPPED} SELECT pos, sentence, coalesce(a.canonical, subject) AS subject, predicate, coalesce(b.canonical, object) AS object FROM vg LEFT JOIN cm a ON subject = a.variant LEFT JOIN cm b ON object = b.variant")
def canonical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.canonical_nodes(variant_graph(spark, sf_dir), preferred_terms(spark, sf_dir))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers point to the one of half their number; customers 1, 2 and 3 make a cycle."""
    k = F.col("c_custkey")
    to = F.when(k.isin(1, 2), k + 1).when(k == 3, 1).otherwise(F.floor(k / 2)).cast("string")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("term"), to.alias("target"))


def alias_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of suppliers, which are also numbers of customers, the last first."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((100_000_000 - k).alias("pos"), k.cast("string").alias("term"))


ROOTS = """RECURSIVE al AS (SELECT CAST(c_custkey AS VARCHAR) AS term, CAST(CASE WHEN c_custkey IN (1, 2) THEN c_custkey + 1 WHEN c_custkey = 3 THEN 1 ELSE c_custkey // 2 END AS VARCHAR) AS target FROM customer),
p(term, cur, seen) AS (SELECT term, term, CAST([] AS VARCHAR[]) FROM al UNION ALL SELECT p.term, al.target, list_append(seen, p.cur) FROM p JOIN al ON p.cur = al.term WHERE al.target <> al.term AND NOT list_contains(seen, p.cur)),
rt AS (SELECT term, arg_max(cur, len(seen)) AS root FROM p GROUP BY term)"""


@registered(f"WITH {ROOTS} SELECT term, root FROM rt")
def alias_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.alias_roots(aliases(spark, sf_dir))


@registered(f"""WITH {ROOTS}, pf AS (SELECT 100000000 - s_suppkey AS pos, CAST(s_suppkey AS VARCHAR) AS term FROM supplier),
ch AS (SELECT root, arg_min(pf.term, pos) AS chosen FROM rt JOIN pf ON rt.term = pf.term GROUP BY root)
SELECT rt.term, coalesce(chosen, rt.root) AS target FROM rt LEFT JOIN ch ON rt.root = ch.root WHERE rt.term NOT IN (SELECT term FROM pf) UNION ALL SELECT DISTINCT term, term FROM pf""")
def corrected_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.corrected_mapping(aliases(spark, sf_dir), alias_terms(spark, sf_dir))


FOLD = "list_reduce(list_prepend('', list(sentence ORDER BY pos)), lambda acc, x: CASE WHEN contains(acc, x) THEN acc WHEN acc = '' THEN x ELSE acc || ' | ' || x END)"


@registered(f"WITH {KG} SELECT min(pos) AS pos, {FOLD} AS sentence, subject, predicate, object FROM kg GROUP BY subject, predicate, object")
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.merged_duplicates(graph(spark, sf_dir))


def node_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of part names point to their noun, by way of a second term; part types to a term of their own."""
    part = table(spark, sf_dir, "part")
    noun = F.element_at(F.split("p_name", " "), -1)
    some = [(F.initcap("p_name"), F.concat(F.lit("any "), noun)), (F.concat(F.initcap("p_name"), F.lit("?")), F.concat(F.lit("any "), noun)), (F.concat(F.lit("any "), noun), F.concat(F.lit("the "), noun)), (F.col("p_type"), F.concat(F.lit("type "), F.lower("p_type")))]
    return part.select(F.explode(F.array(*[F.struct(a.alias("term"), b.alias("target")) for a, b in some])).alias("x")).select("x.*").distinct()


_SPELLED = "array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ')"
_NOUN = "'the ' || string_split(p_name, ' ')[-1]"
NODE_ALIASES = f"""al AS (SELECT DISTINCT unnest([{{'term': {_SPELLED}, 'root': {_NOUN}}}, {{'term': {_SPELLED} || '?', 'root': {_NOUN}}}, {{'term': 'any ' || string_split(p_name, ' ')[-1], 'root': {_NOUN}}}, {{'term': {_NOUN}, 'root': {_NOUN}}},
  {{'term': p_type, 'root': 'type ' || lower(p_type)}}, {{'term': 'type ' || lower(p_type), 'root': 'type ' || lower(p_type)}}], recursive := true) FROM part),
ch AS (SELECT root, arg_min(pt.term, pos) AS chosen FROM al JOIN pt ON al.term = pt.term GROUP BY root),
mp AS (SELECT al.term, CASE WHEN al.term IN (SELECT term FROM pt) THEN al.term ELSE coalesce(chosen, al.root) END AS target FROM al LEFT JOIN ch ON al.root = ch.root)"""


@registered(f"""WITH {MAPPED}, {NODE_ALIASES}, g AS (SELECT pos, sentence, coalesce(a.canonical, subject) AS subject, predicate, coalesce(b.canonical, object) AS object FROM vg LEFT JOIN cm a ON subject = a.variant LEFT JOIN cm b ON object = b.variant),
g2 AS (SELECT pos, sentence, coalesce(x.target, subject) AS subject, predicate, coalesce(y.target, object) AS object FROM g LEFT JOIN mp x ON subject = x.term LEFT JOIN mp y ON object = y.term)
SELECT min(pos) AS pos, {FOLD} AS sentence, subject, predicate, object FROM g2 GROUP BY subject, predicate, object""")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: nodes get one spelling, aliases their cluster's term, equal triples merge."""
    return standardize.standardized(variant_graph(spark, sf_dir), node_aliases(spark, sf_dir), preferred_terms(spark, sf_dir))


# Post-processing.


@registered(f"""WITH {AL}, s AS (SELECT *, CASE WHEN r1 = canonical_predicate THEN s1 WHEN r2 = canonical_predicate THEN s2 END AS mine FROM al)
SELECT pos, CASE WHEN canonicalized AND (mine IS NULL OR mine < 0.4) THEN original_predicate WHEN canonicalized THEN canonical_predicate ELSE predicate END AS predicate,
canonicalized AND NOT (mine IS NULL OR mine < 0.4) AS canonicalized, CASE WHEN canonicalized THEN mine END AS canonical_similarity FROM s""")
def threshold_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.reverted_below(aligned_graph(spark, sf_dir), 0.4).select("pos", "predicate", "canonicalized", "canonical_similarity")


@registered(f"WITH {AL} SELECT pos, predicate AS original_predicate, canonical_predicate AS predicate FROM al")
def replace_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.predicate_replaced(aligned_graph(spark, sf_dir)).select("pos", "original_predicate", "predicate")


def own_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a self-canonical run might return for every other unmapped row, some rows twice."""
    rows = aligned_graph(spark, sf_dir).filter("pos % 3 = 1 AND pos % 2 = 0").withColumn("nth", F.explode(F.array(F.lit(0), F.lit(1)))).filter("nth = 0 OR pos % 5 = 0")
    return rows.select((F.col("pos") * 2 + F.col("nth")).alias("pos"), "triplet_id", F.concat(F.lit("own_"), F.col("nth").cast("string")).alias("canonical_predicate"), (F.col("pos") % 4 == 0).alias("canonicalized"))


OWN = f"""{AL}, own AS (SELECT triplet_id, 'own_' || CAST(CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS own_predicate, pos % 4 = 0 AS own_flag FROM al WHERE pos % 3 = 1 AND pos % 2 = 0),
mg AS (SELECT al.pos, own.triplet_id IS NOT NULL AS from_self, CASE WHEN own.triplet_id IS NULL THEN canonical_predicate ELSE own_predicate END AS canonical_predicate, CASE WHEN own.triplet_id IS NULL THEN canonicalized ELSE own_flag END AS canonicalized, CASE WHEN own.triplet_id IS NULL THEN subject END AS subject FROM al LEFT JOIN own USING (triplet_id))"""


@registered(f"WITH {OWN} SELECT * FROM mg")
def merge_self_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.self_mapped_merged(aligned_graph(spark, sf_dir), own_records(spark, sf_dir)).select("pos", "from_self", "canonical_predicate", "canonicalized", "subject")


@registered(f"WITH {OWN} SELECT count(*) FILTER (WHERE NOT from_self) AS n_onto, count(*) FILTER (WHERE from_self) AS n_self, count(*) FILTER (WHERE from_self AND canonicalized) AS n_fused, count(*) FILTER (WHERE from_self AND NOT canonicalized) AS n_added FROM mg")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_counters(merging.self_mapped_merged(aligned_graph(spark, sf_dir), own_records(spark, sf_dir)))


ISA = "CASE CAST(pos % 4 AS INTEGER) WHEN 0 THEN ' Is-A' WHEN 1 THEN 'is ' WHEN 2 THEN 'isa' ELSE predicate END"


@registered(f"""WITH {KG}, u AS (SELECT 1 AS part, pos, {ISA} AS p, NULL AS extra FROM kg UNION ALL SELECT 2, pos, {ISA}, 'x' FROM kg WHERE predicate = 'part_of')
SELECT part, pos, CASE WHEN lower(trim(p)) IN ('is-a', 'is') THEN 'isa' ELSE p END AS predicate, lower(trim(p)) IN ('is-a', 'is') AS normalized, extra FROM u""")
def union_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("pos") % 4 == 0, " Is-A").when(F.col("pos") % 4 == 1, "is ").when(F.col("pos") % 4 == 2, "isa").otherwise(F.col("predicate"))
    g = graph(spark, sf_dir)
    first, second = g.select("pos", p.alias("predicate")), g.filter("predicate = 'part_of'").select("pos", p.alias("predicate"), F.lit("x").alias("extra"))
    return merging.union_normalized(first, second).select("part", "pos", "predicate", "normalized", "extra")


@registered(f"WITH {KG} SELECT lower(trim(p_name)) AS entity FROM part WHERE FALSE UNION ALL (SELECT DISTINCT lower(trim(c_name)) FROM customer INTERSECT SELECT lower(trim(e)) FROM (SELECT subject AS e FROM kg UNION ALL SELECT object FROM kg))")
def vocab_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.vocabulary_overlap(graph(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_name").alias("term")))


@registered(f"WITH {KG} SELECT count(DISTINCT predicate) AS n_predicates FROM kg")
def unique_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.unique_predicates(graph(spark, sf_dir)).select(F.col("n_predicates").cast("long"))


@registered(f"WITH {AL} SELECT count(*) AS total, count(*) FILTER (WHERE canonicalized) AS n_canonicalized, round(100.0 * count(*) FILTER (WHERE canonicalized) / greatest(count(*), 1), 1) AS pct_canonicalized, count(*) FILTER (WHERE NOT canonicalized) AS n_unmapped FROM al")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.report(aligned_graph(spark, sf_dir))


# Checkpoints and filters.


@registered(f"""WITH {AL}, fin AS (SELECT triplet_id, 'done_' || CAST(CASE WHEN pos % 6 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS state FROM al WHERE pos % 2 = 0)
SELECT pos, al.triplet_id, coalesce(state, 'todo') AS state FROM al LEFT JOIN fin ON al.triplet_id = fin.triplet_id""")
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned_graph(spark, sf_dir).select("pos", "triplet_id")
    done = rows.filter("pos % 2 = 0").withColumn("nth", F.explode(F.array(F.lit(0), F.lit(1)))).filter("nth = 0 OR pos % 6 = 0")
    finished = done.select((F.col("pos") * 2 + F.col("nth")).alias("pos"), "triplet_id", F.concat(F.lit("done_"), F.col("nth").cast("string")).alias("state"))
    return unmapped.remaining(rows, finished).withColumn("state", F.lit("todo")).unionByName(unmapped.resumed(rows, finished))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned graph with missing flags and definitions that say the predicate was canonical."""
    flag = F.when(F.col("pos") % 5 != 0, F.col("canonicalized"))
    said = F.when(F.col("pos") % 7 == 0, F.lit(X.ALREADY_CANONICAL)).otherwise(F.col("predicate_definition"))
    return aligned_graph(spark, sf_dir).withColumns({"canonicalized": flag, "predicate_definition": said})


FLAGGED = f"{AL}, fl AS (SELECT * REPLACE (CASE WHEN pos % 5 <> 0 THEN canonicalized END AS canonicalized, CASE WHEN pos % 7 = 0 THEN {_sql_text(X.ALREADY_CANONICAL)} ELSE predicate_definition END AS predicate_definition) FROM al)"


@registered(f"WITH {FLAGGED} SELECT pos, 'self' AS kind FROM fl WHERE NOT coalesce(canonicalized, FALSE) AND NOT starts_with(lower(predicate_definition), '(already canonical') UNION ALL SELECT pos, 'clusters' FROM fl WHERE NOT coalesce(canonicalized, TRUE) UNION ALL SELECT pos, 'define' FROM fl WHERE pos % 7 = 0")
def unmapped_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    named = lambda d, k: d.select("pos", F.lit(k).alias("kind"))
    return named(unmapped.unmapped_for_self(rows), "self").union(named(unmapped.unmapped_for_clusters(rows), "clusters")).union(named(rows.filter(unmapped.needs_definition(F.col("predicate_definition"))), "define"))


@registered(f"WITH {FLAGGED} SELECT lower(trim(original_predicate)) AS key, arg_min(original_predicate, pos) AS predicate, arg_min(predicate_definition, pos) AS definition FROM fl WHERE NOT coalesce(canonicalized, TRUE) GROUP BY 1")
def unmapped_first_per_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmapped.first_unmapped(flagged(spark, sf_dir))


@registered(f"WITH {KG} SELECT predicate AS key, arg_min(sentence, pos) AS definition FROM kg WHERE pos % 3 <> 0 GROUP BY predicate")
def definition_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("pos") % 2 == 0, F.upper("predicate")).otherwise(F.concat(F.lit(" "), "predicate"))
    return unmapped.definition_cache(graph(spark, sf_dir).select("pos", p.alias("predicate"), F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("sentence")).alias("response")))


# Flows with stand-in models: definitions repeat the triple, choices take the first letter now and then, vectors count letters.


def align_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "region")
    rows = n.select(F.concat(F.lit("rel_"), F.lower("r_name")).alias("relation"), F.concat(F.lit("things of "), F.lower("r_name")).alias("def"))
    both = rows.unionByName(spark.range(1).select(F.lit("part_of").alias("relation"), F.lit("being a part of").alias("def")))
    from pyspark.sql import Window

    return both.withColumn("rel_idx", (F.row_number().over(Window.orderBy("relation")) - 1).cast("long"))


def _define(prompt: str) -> str:
    m = re.search(r"Triplet: \['(.*)', '(.*)', '(.*)'\]", prompt)
    return f"{m[2]} of {m[3]}"


def _choose(prompt: str) -> str:
    m = re.search(r"Triplet: \['(.*)', '(.*)', '(.*)'\]", prompt)
    return "A" if len(m[1]) % 2 else "Answer: B" if len(m[1]) % 3 == 0 else "none of these"


COUNTS = "[CAST(length(lower({0})) - length(replace(lower({0}), chr(97 + CAST(i AS INTEGER)), '')) AS DOUBLE) FOR i IN range(0, 26)]"
ALIGN = f"""{KG}, o AS (SELECT *, row_number() OVER (ORDER BY relation) - 1 AS rel_idx FROM (SELECT 'rel_' || lower(r_name) AS relation, 'things of ' || lower(r_name) AS def FROM region UNION ALL SELECT 'part_of', 'being a part of')),
ov AS (SELECT *, {COUNTS.format('def')} AS cv FROM o)"""
CHOSEN = """dv AS (SELECT DISTINCT def, {counts} AS v FROM x),
sc AS (SELECT dv.def, relation, row_number() OVER (PARTITION BY dv.def ORDER BY list_cosine_similarity(v, cv) DESC, rel_idx DESC) AS k, round(list_cosine_similarity(v, cv), 4) + 0 AS sim FROM dv CROSS JOIN ov),
tp AS (SELECT def, max(relation) FILTER (WHERE k = 1) AS a, max(relation) FILTER (WHERE k = 2) AS b, max(sim) FILTER (WHERE k = 1) AS sa FROM sc GROUP BY def)""".format(counts=COUNTS.format("def"))


@registered(f"""WITH {ALIGN}, x AS (SELECT *, predicate || ' of ' || object AS def FROM kg WHERE predicate <> 'part_of'), {CHOSEN},
lt AS (SELECT def, string_agg(relation || '=' || CAST(CAST(round(sim * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY k) AS top FROM sc WHERE k <= 5 GROUP BY def),
ans AS (SELECT pos, sentence, subject, object, x.def AS predicate_definition, predicate, CASE WHEN length(subject) % 2 = 1 THEN a WHEN length(subject) % 3 = 0 THEN b END AS chosen, sa, top FROM x JOIN tp ON x.def = tp.def JOIN lt ON x.def = lt.def),
res AS (SELECT pos, sentence, subject, predicate, object, predicate_definition, coalesce(chosen, predicate) AS canonical_predicate, chosen IS NOT NULL AS canonicalized, sa AS best_similarity, top AS top_candidates, TRUE AS asked FROM ans
UNION ALL SELECT pos, sentence, subject, predicate, object, {_sql_text(X.ALREADY_CANONICAL)}, predicate, FALSE, NULL, '', FALSE FROM kg WHERE predicate = 'part_of')
SELECT *, {_ID} AS triplet_id, predicate AS original_predicate, 0 AS n_unstamped FROM res""")
def align_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.aligned(graph(spark, sf_dir), align_ontology(spark, sf_dir), lambda: FunctionCompleter(_define), lambda: FunctionCompleter(_choose), LetterCounts)
    top = F.array_join(F.transform("top_candidates", lambda c: F.concat(c["relation"], F.lit("="), F.round(c["similarity"] * 10_000).cast("long").cast("string"))), " ")
    return out.select(
        "pos", "sentence", "subject", "predicate", "object", "predicate_definition", "canonical_predicate", "canonicalized", F.try_element_at("top_candidates", F.lit(1))["similarity"].alias("best_similarity"), top.alias("top_candidates"),
        (F.col("definition_call").isNotNull() & F.col("choice_call").isNotNull()).alias("asked"), "triplet_id", "original_predicate", F.col("processed_at").isNull().cast("int").alias("n_unstamped"),
    )


@registered(f"""WITH {ALIGN}, fd AS (SELECT predicate AS p, arg_min(predicate || ' of ' || object, pos) AS def FROM kg GROUP BY predicate), x AS (SELECT kg.*, fd.def FROM kg JOIN fd ON predicate = p), {CHOSEN.replace("max(sim) FILTER (WHERE k = 1) AS sa", "max(relation) FILTER (WHERE k = 5) AS e")}
SELECT pos, x.def AS predicate_definition, CASE WHEN length(subject) % 2 = 1 THEN a WHEN length(subject) % 3 = 0 THEN a ELSE e END AS canonical_predicate FROM x JOIN tp ON x.def = tp.def""")
def align_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition a predicate, and the loose reading, which finds an A in "Answer: B" and an E in "none of these"."""
    out = align.aligned(graph(spark, sf_dir), align_ontology(spark, sf_dir), lambda: FunctionCompleter(_define), lambda: FunctionCompleter(_choose), LetterCounts, mode="cached")
    return out.select("pos", "predicate_definition", "canonical_predicate")


@registered()
def cluster_average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors. Agglomerative merging is no SQL; a test compares it with plain merging."""
    return clusters.clustered(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")), 0.35)


@registered()
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmapped predicates clustered, labelled by a stand-in model, and written back."""
    records, _ = mapping.relabelled(aligned_graph(spark, sf_dir), LetterCounts, lambda: FunctionCompleter(lambda p: "'joint_label'. Because"), 0.35)
    return records.select("pos", "canonical_predicate", "canonicalized", "canonicalization_method")


@registered()
def self_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growing schema over all distinct types of triples. It is sequential; a test compares it with a plain loop."""
    rows = type_triples(spark, sf_dir).select((F.col("pos") * 4 + F.when(F.col("predicate") == "part_of", 0).when(F.col("predicate") == "made_as", 1).otherwise(2)).alias("pos"), F.lit("").alias("sentence"), "subject", "predicate", "object")
    out = self_canonical.self_canonicalized(rows, lambda: FunctionCompleter(_define), lambda: FunctionCompleter(_choose), LetterCounts)
    return out.select("pos", "original_predicate", "predicate_definition", "canonical_predicate", "canonicalized")
