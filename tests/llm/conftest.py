import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["fp", "n_words", "score", "features", "node", "root", "band", "key", "h", "host", "kept", "mention", "surrogate", "type", "value", "words", "family", "page", "__row"]


def words(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(words(1, 60_000))
    lines = "\n".join(" ".join(words(k, 12)) for k in range(10, 16))
    return [
        (1, lines, "en", "a", 10), (1, lines, "en", "a", 10), (2, lines, None, None, None), (None, lines + "\nx", "en", "a", 3), (None, None, None, None, None), (3, None, "en", "b", 0),
        (4, "", "en", "b", 0), (5, "   \n\t ", "de", "b", 6), (6, long, "fr", "a", len(long)), (7, "one", "en", "a", 3), (8, "ünï 漢字 \x00 � é", "en", "a", 9), (9, " ".join(["same"] * 500), "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCUMENTS)
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
