"""The registered queries of the text operators: thin wrappers with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.oracles import ORACLES  # noqa: F401


#: The key of the registered query; a real one is a secret that the caller passes.
PII_KEY = "registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.surrogates import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op2_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.gam import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.language import languages

    return languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.simhash import simhash_classes

    return simhash_classes(table(spark, sf_dir, "documents"), shingle=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.line_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents"), ["doc_id"]).drop("removed")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.warc import roundtrip

    return roundtrip(table(spark, sf_dir, "pages"))


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.templates import main_texts

    return main_texts(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.winnowing import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.piece_bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.licences import scanned

    return scanned(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.metric_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.block_kmeans import clustered

    return clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_gam": op2_gam,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_line_rules": op5_line_rules,
    "op6_warc": op6_warc,
    "op7_templates": op7_templates,
    "op8_winnowing": op8_winnowing,
    "op9_piece_bpe": op9_piece_bpe,
    "op10_licences": op10_licences,
    "op11_jaccard": op11_jaccard,
    "op12_importance": op12_importance,
    "op13_centroids": op13_centroids,
}
