"""Quality rules with cross-document line frequency.

Each line is normalised (ASCII lower case, digits as 0, white space as single spaces) and hashed. For each host the
distinct documents that hold a line are counted: documents of equal text are one, any difference makes two. Lines
above the limit are removed; documents left with too few words, or too small a part of them, are rejected. Near
copies are documents of their own here, so what more than the limit of them share in a host goes as boilerplate;
near-duplicate removal is another operator's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, Words, byte_table, map_texts, written

#: A line is boilerplate for a host if more distinct documents than this have it.
LEAST_DOCUMENTS = 20
#: A document is depleted if fewer words than this, or than this part of its words, are left.
LEAST_WORDS, LEAST_PART = 5, 0.3
WINDOW = 5
TABLE = byte_table(SPACES, lower=False)
LINE = byte_table(b"", lower=True)[:48] + b"0" * 10 + byte_table(b"", lower=True)[58:]
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "lines array<struct<h: long, words: long>>"


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(LINE).split())


def _hash(normal: bytes) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(normal)
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: bytes) -> int:
    return _hash(normal_line(line))


def repeated_words(words: Words) -> np.ndarray:
    """For each text: words in WINDOW-word windows that are found twice or more in the text, the first included."""
    g, whole = words.grams(WINDOW)
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(len(words.first) - 1, dtype=np.int64)
    x = g[at] ^ (words.text[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(x, kind="stable")
    y = x[order]
    same = y[1:] == y[:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return inside[words.first[1:]] - inside[words.first[:-1]]


def _lines(text: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Lines with a word equal to an earlier line, and words by normalised line hash."""
    seen: set[bytes] = set()
    dup = 0
    words: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        normal = normal_line(line)
        words[normal] = words.get(normal, 0) + n
    return dup, [(_hash(x), n) for x, n in words.items()]


def measured(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """For each row: the carried columns, the base measures, and its lines' hashes with their words."""

    def make():
        def work(texts):
            words = Words(texts, TABLE)
            plain = [t or b"" for t in texts]
            lines = [_lines(t) for t in plain]
            spaces = str.maketrans("", "", SPACES.decode())
            return {
                "n_words": np.diff(words.first),
                "word_chars": [len(t.decode("utf-8", "replace").translate(spaces)) if not t.isascii() else len(t.translate(None, SPACES)) for t in plain],
                "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in plain],
                "n_dup_lines": [x[0] for x in lines],
                "n_repeat_words": repeated_words(words),
                "lines": [[{"h": h, "words": n} for h, n in x[1]] for x in lines],
            }

        return work

    return map_texts(docs, text, carry, f"{BASE}, {LINES}", make)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def frequent_lines(measures: DataFrame, host: str, text_key: str, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(host, h) of the lines in more than `least` distinct documents of a host.

    Counts are sums over distinct (host, line, document) rows, so neither a host nor a line meets in one task.
    """
    lines = measures.select(F.col(host).alias("host"), F.col(text_key).alias("document"), F.explode("lines.h").alias("h"))
    return lines.distinct().groupBy("host", "h").agg(F.count("*").alias("documents")).filter(F.col("documents") > least).select("host", "h")


def text_key(text: F.Column) -> F.Column:
    """What tells documents of unequal text apart."""
    return F.xxhash64(text, F.length(text))


def verdicts(docs: DataFrame, carry: list[str], text: str = "text", host: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """For each row: the carried columns, base measures, base_failed, removed_words, removed (hashes of its removed lines), kept.

    Null and empty texts have no words and fail the base rules. A null host is a host of its own. Repeated rows are
    judged alike. Only line hashes are shuffled, never texts.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed", "kept"]
    carry = [c for c in carry if c not in (*own, "lines", "__row", "__host", "__text_key")]
    given = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.col(f"`{host}`").alias("__host"), text_key(F.col(f"`{text}`")).alias("__text_key"), F.col(f"`{text}`").alias("__line_text")
    )
    rows = written(measured(given, [*carry, "__host", "__text_key"], "__line_text").withColumn("__row", F.monotonically_increasing_id()))
    # Written, so that the join with it is of two plain exchanges: Spark then splits a line of very many documents.
    bad = written(frequent_lines(rows, "__host", "__text_key", least))
    lines = rows.select("__row", "__host", F.explode("lines").alias("l")).select("__row", "__host", "l.h", "l.words")
    met = lines.join(bad, lines["__host"].eqNullSafe(bad["host"]) & (lines["h"] == bad["h"]))
    lost = met.groupBy("__row").agg(F.sum("words").alias("removed_words"), F.collect_list(lines["h"]).alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        rows.join(lost, "__row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= LEAST_PART * F.col("n_words")))
        .select(*carry, *own)
    )


#: Up to this many frequent lines (24 bytes each) are broadcast to the workers; with more, each text's own are joined to it.
BROADCAST_LINES = 500_000


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs without the documents that the rules reject, and without the removed lines in the texts of the others.

    Two passes over the texts: one to count lines, one to apply the counts. Texts are not shuffled unless there are
    more frequent lines than BROADCAST_LINES; then the list of its own removed lines is joined to each text.
    """
    given = docs.select(F.col(f"`{host}`").alias("__host"), text_key(F.col(f"`{text}`")).alias("__text_key"), F.col(f"`{text}`").alias("__line_text"))
    measures = written(measured(given, ["__host", "__text_key"], "__line_text").select("__host", "__text_key", "lines"))
    bad = written(frequent_lines(measures, "__host", "__text_key", least))
    schema = docs.schema
    place, of_host = schema.fieldNames().index(text), schema.fieldNames().index(host)
    if bad.count() <= BROADCAST_LINES:
        by_host: dict[object, set[int]] = {}
        for h, line in bad.collect():
            by_host.setdefault(h, set()).add(line)
        known = docs.sparkSession.sparkContext.broadcast(by_host)
        given, joined = docs, False
    else:
        lines = measures.select("__host", "__text_key", F.explode("lines.h").alias("h")).distinct()
        met = lines.join(bad, lines["__host"].eqNullSafe(bad["host"]) & (lines["h"] == bad["h"]))
        lists = written(met.groupBy("__host", "__text_key").agg(F.collect_list(lines["h"]).alias("__bad"))).withColumnsRenamed({"__host": "__h", "__text_key": "__k"})
        own = docs[host].eqNullSafe(lists["__h"]) & (text_key(docs[text]) == lists["__k"])
        given, known, joined = docs.join(lists, own, "left").select(*docs.columns, "__bad"), None, True
    from weftline.llm.common import small_batches, steps, task

    small_batches(docs.sparkSession)
    n = len(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        with task(__name__):
            for batch in batches:
                texts = batch.column(place).to_pylist()
                for lo, hi in steps([len(t or "") for t in texts]):
                    part = batch.slice(lo, hi - lo)
                    plain = [(t or "").encode("utf-8", "replace") for t in texts[lo:hi]]
                    words = Words(plain, TABLE)
                    n_words, n_repeat = np.diff(words.first), repeated_words(words)
                    sets = [set(x or ()) for x in part.column(n).to_pylist()] if joined else [known.value.get(h, ()) for h in part.column(of_host).to_pylist()]
                    keep, out = [], []
                    for t, w, r, gone in zip(plain, n_words.tolist(), n_repeat.tolist(), sets, strict=True):
                        ok = w >= 10 and 100 * r <= 20 * w
                        if ok and gone:
                            t = without_lines(t, gone)
                            left = len(t.split())
                            ok = left >= LEAST_WORDS and left >= LEAST_PART * w
                        keep.append(ok)
                        out.append(t.decode() if ok else None)
                    columns = [pa.array(out, arrow.field(i).type) if i == place else part.column(i) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)).cast(arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

    return given.mapInArrow(run, schema)


def without_lines(text: bytes, removed: set[int]) -> bytes:
    """A text without the lines whose hashes are given; lines without a word stay."""
    return b"\n".join(x for x in text.split(b"\n") if not x.split() or line_hash(x) not in removed)
