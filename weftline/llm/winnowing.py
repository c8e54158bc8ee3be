"""Benchmark decontamination by winnowing.

A text's words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Of each window of
WINDOW - GRAM + 1 successive GRAM-word hashes the least is kept. Any WINDOW words that a document shares with an
item keep the same least hash in both, so joining the kept hashes misses no such span; each meeting is extended
to the WINDOW-word windows around it and those are compared as text. Items of fewer words go whole, by their length.

A benchmark of up to BLOCK_BYTES of text is indexed and broadcast, and the join is a lookup as the texts pass. A larger one's
kept hashes are a table, and are joined with those of the documents that a bit array of fixed size lets through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Words, byte_table, map_texts, mixed, written

WINDOW, GRAM = 8, 5
#: Bytes of item texts up to which all items are indexed and broadcast.
BLOCK_BYTES = 2 << 20
#: Bits of the array that says which hashes an item may have: 16 MB, whatever the number of items.
FILTER_BITS = 1 << 27
TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)
RESULT = "n_words long, hit_spans array<int>, item_ids array<string>, n_hit long, n_items long, n_long_items long"


def kept_hashes(words: Words) -> np.ndarray:
    """Positions of the winnowed GRAM-word hashes, and the hashes. All equal least hashes of a window are kept."""
    g, whole = words.grams(GRAM)
    span = WINDOW - GRAM + 1
    m = len(g) - span + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = g[:m].copy()
    for j in range(1, span):
        np.minimum(least, g[j : j + m], out=least)
    inside = words.text[:m] == words.text[WINDOW - 1 :]
    kept = np.zeros(len(g), dtype=bool)
    for j in range(span):
        kept[j : j + m] |= (g[j : j + m] == least) & inside
    at = np.flatnonzero(kept & whole)
    return at, g[at]


class Index:
    """Some items: winnowed hashes, and items by window text. Windows of items under WINDOW words go by length."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        words = Words([t for _, t in items], TABLE)
        self.windows: dict[bytes, list[str]] = {}
        short: dict[int, set[int]] = {}
        for i, (item, _) in enumerate(items):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            n = min(WINDOW, hi - lo)
            own = [words.word(j) for j in range(lo, hi)]
            for j in range(len(own) - n + 1 if n else 0):
                ids = self.windows.setdefault(b" ".join(own[j : j + n]), [])
                if item not in ids[-1:]:
                    ids.append(item)
            if 0 < n < WINDOW:
                short.setdefault(n, set()).add(lo)
        self.kept = np.unique(kept_hashes(words)[1])
        self.short = {n: np.unique(words.grams(n)[0][sorted(at)]) for n, at in short.items()}


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    i = np.searchsorted(known, x)
    i[i == len(known)] = 0
    return known[i] == x


class Scan:
    """Finds an Index's windows in texts."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(index.kept & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[set[tuple[int, int]]], list[set[str]], list[set[str]]]:
        """Words in each text; spans (first word, words) of windows that occur; items they belong to; those with a window of WINDOW words."""
        words = Words(texts, TABLE)
        n = np.diff(words.first)
        spans: list[set[tuple[int, int]]] = [set() for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        long: list[set[str]] = [set() for _ in texts]

        def test(start: int, length: int, text: int) -> None:
            span = (start - int(words.first[text]), length)
            if span not in spans[text] and (ids := self.index.windows.get(b" ".join(map(words.word, range(start, start + length))))):
                spans[text].add(span)
                items[text].update(ids)
                if length == WINDOW:
                    long[text].update(ids)

        at, g = kept_hashes(words)
        some = np.flatnonzero(self.seen[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
        for p in at[some[_among(g[some], self.index.kept)]].tolist():
            text = int(words.text[p])
            for start in range(max(p - WINDOW + GRAM, int(words.first[text])), min(p, int(words.first[text + 1]) - WINDOW) + 1):
                test(start, WINDOW, text)
        for length, known in self.index.short.items():
            g, whole = words.grams(length)
            for p in np.flatnonzero(_among(g, known) & whole).tolist():
                test(p, length, int(words.text[p]))
        return n, spans, items, long


def merged(spans: set[tuple[int, int]] | list[tuple[int, int]]) -> list[int]:
    """Spans as a flat list of (start, end), sorted and without overlaps."""
    out: list[int] = []
    for start, n in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], start + n)
        else:
            out += [start, start + n]
    return out


def contamination(docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of docs: the carried columns, n_words, hit_spans (flat word ranges), item_ids, n_hit, n_items,
    n_long_items (items found by a window of WINDOW words).

    Null texts have no words; null or empty items, and items with a null id, match nothing; repeated items count
    once; with no items nothing is hit. Texts are never shuffled.
    """
    own = items.filter(F.col(f"`{item_id}`").isNotNull() & (F.length(F.col(f"`{item_text}`")) > 0)).select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("t"))
    if (own.agg(F.sum(F.octet_length("t") + F.octet_length("item"))).first()[0] or 0) > BLOCK_BYTES:
        return joined(docs, own, carry, text)
    block = docs.sparkSession.sparkContext.broadcast([(r[0], r[1].encode("utf-8", "replace")) for r in own.collect()])

    def make():
        scan = Scan(Index(block.value))

        def work(texts):
            n, spans, ids, long = scan(texts)
            flat = [merged(s) for s in spans]
            return {"n_words": n, "hit_spans": flat, "item_ids": [sorted(x) for x in ids], "n_hit": [sum(x[1::2]) - sum(x[0::2]) for x in flat], "n_items": [len(x) for x in ids], "n_long_items": [len(x) for x in long]}

        return work

    return map_texts(docs, text, carry, RESULT, make)


POINT = "struct<h: long, n: int, p: int, gram: string, before: array<string>, after: array<string>>"


def points(words: Words, lengths: list[int] | None, may: np.ndarray | None) -> list[list[dict]]:
    """Each text's kept hashes with their place, words and the words that a window may reach around them (the nearest first).

    n is 0 for winnowed hashes, else the length of a short item: all of such lengths, or (lengths null) of a text
    under WINDOW words itself. `may`: bits of the hashes that are wanted.
    """
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    reach = WINDOW - GRAM

    def wanted(h: np.ndarray) -> np.ndarray:
        if may is None:
            return np.ones(len(h), dtype=bool)
        bit = h & np.uint64(8 * len(may) - 1)
        return (may[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def add(h: int, n: int, p: int, size: int, around: int) -> None:
        text = int(words.text[p])
        lo, hi = int(words.first[text]), int(words.first[text + 1])
        word = lambda i: words.word(i).decode("utf-8", "replace")
        out[text].append({"h": h - (1 << 64) if h >> 63 else h, "n": n, "p": p - lo, "gram": " ".join(map(word, range(p, p + size))), "before": [word(i) for i in range(p - 1, max(lo, p - around) - 1, -1)], "after": [word(i) for i in range(p + size, min(hi, p + size + around))]})

    at, g = kept_hashes(words)
    some = wanted(g)
    for p, h in zip(at[some].tolist(), g[some].tolist(), strict=True):
        add(h, 0, p, GRAM, reach)
    counts = np.diff(words.first)
    for n in range(1, WINDOW) if lengths is None else lengths:
        g, whole = words.grams(n)
        place = np.flatnonzero(whole) if lengths is not None else words.first[:-1][counts == n]
        g = mixed(g[place] + np.uint64(n))
        some = wanted(g)
        for p, h in zip(place[some].tolist(), g[some].tolist(), strict=True):
            add(h, n, p, n, 0)
    return out


def _bits(hashes: DataFrame, column: str) -> np.ndarray:
    """FILTER_BITS bits, those of the hashes set: grouped sums of at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    table = hashes.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint8)


def joined(docs: DataFrame, items: DataFrame, carry: list[str], text: str) -> DataFrame:
    """`contamination` by items (item, t) of any number: a join of kept hashes, whose meetings are then extended."""
    sc = docs.sparkSession.sparkContext

    def of_items():
        return lambda texts: {"points": points(Words(texts, TABLE), None, None)}

    known = map_texts(items, "t", ["item"], f"points array<{POINT}>", of_items).select("item", F.explode("points").alias("x"))
    known = written(known.select("item", "x.h", "x.n", "x.gram", "x.before", "x.after").distinct())
    # Items that have a gram with the same words around it share a place, which meets documents once for all of them.
    key = ["h", "n", "gram", "before", "after"]
    places = written(known.select(*key).distinct().withColumn("place", F.monotonically_increasing_id()))
    same = known["h"] == places["h"]
    for c in key[1:]:
        same &= known[c].eqNullSafe(places[c])
    of_place = written(known.join(places, same).select("place", "item"))
    lengths = sorted(r[0] for r in known.filter("n > 0").select("n").distinct().collect())
    may = sc.broadcast(_bits(known, "h"))

    def of_docs():
        def work(texts):
            words = Words(texts, TABLE)
            return {"n_words": np.diff(words.first), "__points": points(words, lengths, may.value)}

        return work

    taken = ("n_words", "hit_spans", "item_ids", "n_hit", "n_items", "n_long_items")
    carry = [c for c in carry if c not in taken and c not in ("__points", "__row")]
    rows = written(map_texts(docs, text, carry, f"n_words long, __points array<{POINT}>", of_docs).withColumn("__row", F.monotonically_increasing_id()))
    own = rows.select("__row", F.explode("__points").alias("d")).select("__row", "d.p", F.col("d.h").alias("h"), F.col("d.n").alias("n"), F.col("d.gram").alias("gram"), F.col("d.before").alias("b"), F.col("d.after").alias("a"))
    met = own.join(places, ["h", "n", "gram"])
    left, right = _alike("b", "before"), _alike("a", "after")
    span = met.select("__row", "place", "n", (F.col("p") - left).alias("start"), (F.col("p") + F.when(F.col("n") > 0, F.col("n")).otherwise(GRAM) + right).alias("end"))
    span = written(span.filter(f"n > 0 or end - start >= {WINDOW}").distinct())
    found = span.groupBy("__row", "place").agg(F.max((F.col("n") == 0).cast("int")).alias("long"))
    ids = found.join(of_place, "place").groupBy("__row", "item").agg(F.max("long").alias("long"))
    ids = ids.groupBy("__row").agg(F.array_sort(F.collect_list("item")).alias("item_ids"), F.count("*").cast("long").alias("n_items"), F.sum("long").alias("n_long_items"))
    flat = F.array_sort(F.collect_set(F.struct("start", "end")))
    empty = F.array().cast("array<int>")
    last = lambda acc: F.element_at(acc, -1)
    cut = lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1)
    fold = lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1))), F.concat(cut(acc), F.array(F.greatest(last(acc), x["end"])))).otherwise(F.concat(acc, F.array(x["start"], x["end"])))
    hits = span.groupBy("__row").agg(flat.alias("s")).select("__row", F.aggregate("s", empty, fold).alias("hit_spans"))
    total = F.aggregate(F.transform("hit_spans", lambda v, i: F.when(i % 2 == 0, -v).otherwise(v)), F.lit(0), lambda acc, v: acc + v)
    out = rows.drop("__points").join(hits, "__row", "left").join(ids, "__row", "left").withColumn("hit_spans", F.coalesce("hit_spans", empty))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*carry, "n_words", "hit_spans", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), total.cast("long").alias("n_hit"), zero("n_items"), zero("n_long_items"))


def _alike(a: str, b: str) -> F.Column:
    """How many words two arrays of up to WINDOW - GRAM words have in common from their beginning."""
    out = F.lit(0)
    for n in range(1, WINDOW - GRAM + 1):
        same = F.slice(a, 1, n) == F.slice(b, 1, n)
        out = F.when((F.size(a) >= n) & (F.size(b) >= n) & same, n).otherwise(out)
    return out
