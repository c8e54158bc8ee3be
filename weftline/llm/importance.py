"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are the runs of 1 to GRAM successive words, joined by a space; a feature's bucket is the CRC-32 of its bytes
modulo BUCKETS. No feature is ever written out: each word's CRC is computed once, and the CRC of a longer run follows
from those of its parts, as crc(A + B) = shift(crc(A), len(B)) ^ crc(B), where the shift by n bytes is a linear map
over GF(2). Maps for the powers of two are tables (Shift), which any length is composed of.

The counts of both sides give each bucket a gain, a document's weight is the sum of its features' gains, and a Gumbel
number keyed by the document's id is added: the highest scores are a sample without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import byte_table, map_texts, small_batches, steps, task, written

BUCKETS, GRAM = 10_000, 3
TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)
#: The polynomial of CRC-32, bits reversed (a fixed value).
POLYNOMIAL = 0xEDB88320
#: What the estimate of a rank may be off by, as a share of all rows (see `ranked`).
ACCURACY = 10_000


def _tables(columns: list[int]) -> np.ndarray:
    """The linear map whose images of the 32 unit vectors are given, as four tables of 256 entries, by byte."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            half = 1 << bit
            out[byte, half : 2 * half] = out[byte, :half] ^ np.uint32(columns[8 * byte + bit])
    return out


class Shift:
    """The maps of a CRC over zero bytes: tables for 1, 2, 4, ... bytes, each the square of the one before."""

    def __init__(self) -> None:
        bit = [POLYNOMIAL, *[1 << i for i in range(31)]]  # one zero bit
        columns = bit
        for _ in range(3):
            columns = self._square(columns)
        self.powers = [_tables(columns)]

    @staticmethod
    def _square(columns: list[int]) -> list[int]:
        t = _tables(columns)
        return [int(x) for x in Shift._applied(t, np.array(columns, dtype=np.uint32))]

    @staticmethod
    def _applied(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]

    def one(self, crc: np.ndarray) -> np.ndarray:
        return self._applied(self.powers[0], crc)

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each crc shifted by its own number of bytes."""
        out = crc.copy()
        k = 0
        while len(length) and int(length.max()) >> k:
            if k == len(self.powers):
                t = self.powers[-1]
                self.powers.append(_tables([int(x) for x in self._applied(t, self._applied(t, np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))))]))
            at = np.flatnonzero((length >> k) & 1)
            out[at] = self._applied(self.powers[k], out[at])
            k += 1
        return out


SPACE = np.uint32(zlib.crc32(b" "))


class Buckets:
    """The features' buckets of some texts: one array for each number of words, and the text of each feature."""

    def __init__(self, texts: list[bytes | None], shift: Shift, gram: int = GRAM, buckets: int = BUCKETS) -> None:
        split = [(t or b"").translate(TABLE).split() for t in texts]
        self.n = np.array([len(w) for w in split], dtype=np.int64)
        words = [w for own in split for w in own]
        crc = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.repeat(np.arange(len(texts)), self.n)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        run = crc
        for k in range(gram):
            if k:
                # A run and a space, shifted by the next word, and that word.
                run = shift(shift.one(run[:-1]) ^ SPACE, length[k:]) ^ crc[k:] if len(run) else run
            whole = text[: len(run)] == text[k : k + len(run)]
            self.parts.append(((run % np.uint32(buckets))[whole].astype(np.int64), text[: len(run)][whole]))


def bucket_counts(docs: DataFrame, text: str = "text", gram: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts each bucket holds. A task passes on one row for each bucket at most."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(__name__):
            shift, total = Shift(), np.zeros(buckets, dtype=np.int64)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for lo, hi in steps([len(t or b"") for t in texts]):
                    for own, _ in Buckets(texts[lo:hi], shift, gram, buckets).parts:
                        total += np.bincount(own, minlength=buckets)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, floor(1000 ln) of its smoothed share in the target over that in the source. `buckets` rows reach the driver."""
    counts = np.zeros((2, buckets), dtype=np.int64)
    for k, df in enumerate((source, target)):
        for bucket, n in df.collect():
            counts[k, bucket] = n
    s, t = counts.astype(np.float64)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, carry: list[str], text: str = "text", gram: int = GRAM) -> DataFrame:
    """Each row's carried columns, n_words, n_features and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def make():
        shift, value = Shift(), shared.value

        def work(texts):
            found = Buckets(texts, shift, gram, len(value))
            weight, n = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for own, at in found.parts:
                ends = np.concatenate(([0], np.cumsum(value[own])))
                n += (k := np.bincount(at, minlength=len(texts)))
                edge = np.concatenate(([0], np.cumsum(k)))
                weight += ends[edge[1:]] - ends[edge[:-1]]
            return {"n_words": found.n, "n_features": n, "weight": weight}

        return work

    return map_texts(docs, text, carry, "n_words long, n_features long, weight long", make)


def ranked(rows: DataFrame, drawn: int, score: str, tie: str, row: str) -> tuple[DataFrame, tuple]:
    """(row, rank) of the `drawn` rows of the highest score (ties: smaller `tie`, nulls first, then `row`), and the last one's (score, tie, row).

    A quantile of guaranteed error leaves out rows that cannot be among them; the rest are sorted by ranges, and a
    range's first rank is the number of rows in the ranges before it. Only the ranges' sizes reach the driver.
    """
    share = drawn / rows.count()
    low = rows.select(F.percentile_approx(score, max(0.0, 1 - share - 3 / ACCURACY), ACCURACY)).first()[0]
    some = rows.filter(F.col(score) >= low)
    if some.count() < drawn:
        some = rows
    order = [F.desc(score), F.asc_nulls_first(tie), F.asc(row)]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = some.select(score, tie, row).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed).withColumn("__part", F.shiftright("__at", 33)).withColumn("__k", F.col("__at").bitwiseAND((1 << 33) - 1))
    before, at = [], 0
    for part, n in placed.groupBy("__part").count().orderBy("__part").collect():
        before.append((part, at))
        at += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "__part long, __before long"))
    found = placed.join(starts, "__part").withColumn("rank", F.col("__before") + F.col("__k") + 1).filter(F.col("rank") <= drawn)
    last = found.filter(F.col("rank") == drawn).select(score, tie, row).first()
    return found.select(row, score, tie, "rank"), tuple(last)


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank (null: not drawn) and n_words.

    Of the N documents of at least `least_words` words, floor(percent * N / 100) are drawn. Null and empty texts have
    no features and weight 0. A null doc_id is hashed as an empty text; among equal scores it goes first, and rows of
    one id and score go in any one order. Empty tables give an empty result; with no target every bucket is only smoothed.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    scored = weighted(given, gain, ["doc_id"], "__text").withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored)
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    rank = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, rank, "n_words")
    top, (score, tie, row) = ranked(able, drawn, "score", "doc_id", "row")
    # A row is drawn if it is not behind the last one drawn, so the others need no join; the drawn ones meet their ranks.
    equal = F.col("doc_id").isNull() if tie is None else F.col("doc_id").eqNullSafe(F.lit(tie))
    sooner = F.col("doc_id").isNull() if tie is not None else F.lit(False)
    smaller = sooner if tie is None else sooner | F.coalesce(F.col("doc_id") < F.lit(tie), F.lit(False))
    ahead = (F.col("n_words") >= least_words) & ((F.col("score") > score) | (F.col("score") == score) & (smaller | equal & (F.col("row") <= row)))
    own = scored.filter(ahead).join(top.select("row", "rank"), "row").select(*columns, "rank", "n_words")
    return own.unionByName(scored.filter(~ahead).select(*columns, rank, "n_words"))
