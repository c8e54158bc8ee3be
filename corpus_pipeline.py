"""The corpus pipeline: five stages over `documents`, each on all that its predecessor kept.

Null and empty texts have no words: the quality rules reject them, the other stages would keep them (near-dedup as one
class, tokens as the end id alone). Of rows that are equal in doc_id and text one stays, of a class of near copies the
row with the least doc_id, null ids last. Nulls in other columns pass through; a null source is a host of its own.
Columns beyond those of documents are left out. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import written
from weftline.llm.line_rules import cleaned
from weftline.llm.near import deduplicated
from weftline.llm.piece_bpe import encoded
from weftline.llm.queries import PII_KEY, table
from weftline.llm.surrogates import pseudonymised
from weftline.llm.winnowing import contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars that of the text as it now is."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted by frequent lines; those lines go from the others."""
    return _documents(cleaned(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: SimHash links, and five-word shingles of similarity 0.8 or more."""
    return _documents(deduplicated(docs.select(*COLUMNS), shingle=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of a benchmark item: eight of its words in a row, or two short items whole."""
    found = contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), COLUMNS)
    return _documents(found.filter((F.col("n_long_items") == 0) & (F.col("n_items") < 2)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates."""
    return _documents(pseudonymised(docs.select(*COLUMNS), PII_KEY, count=None))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of what they decode to."""
    import public_tokenizers

    return encoded(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"], ids=True, remembered=200_000).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL has no XXH64 SimHash, min-wise hashes or piece merging; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
