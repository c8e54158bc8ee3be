"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Distinct fingerprints are nodes. Structured bit masks make the tables: bit i of a fingerprint has a non-zero
vector m(i) of radius + 1 bits, the table of a non-zero vector v keeps the bits with <m(i), v> = 1. Up to `radius`
differing bits have vectors that some v is orthogonal to, so that pair is equal in the table of v: every linked
pair meets in some table. Small buckets are compared inside themselves. In a bucket of more than SMALL
fingerprints no pairs are made: its members are spread over the centres within one bit of them; two fingerprints
differ in two bits or fewer exactly if they share a centre, and a centre has 65 neighbours at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, byte_table, map_texts, written
from weftline.llm.components import components

BITS = 64
#: Fingerprints that a bucket may have to be compared pair by pair.
SMALL = 64
TABLE = byte_table(SPACES, lower=True)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The SimHash of a text as a signed 64-bit number: a bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    words = (text or b"").translate(TABLE).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """Each row's carried columns and `fp`. Words are runs of other than ASCII white space, A-Z lower-cased; null texts have none (fp 0)."""

    def make():
        return lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]}

    return map_texts(docs, text, carry, "fp long", make)


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 covering masks as signed 64-bit numbers."""
    n = (1 << radius + 1) - 1
    vector = [1 + i % n for i in range(BITS)]
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) among the distinct numbers `fp` that connect just what pairs at `radius` or fewer differing bits connect. radius: 1 or 2.

    At radius 2 a large bucket gives links from each centre's least neighbour; at radius 1 all linked pairs around a centre.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(shared, ["t", "key"]).select("t", "key", "fp", "n"))
    pair = lambda group: F.flatten(F.transform(group, lambda x: F.transform(F.filter(group, lambda y: (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= radius)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = met.filter(f"n <= {SMALL}").groupBy("t", "key").agg(F.collect_list("fp").alias("g")).select(F.explode(pair(F.col("g"))).alias("l"))
    ones = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(BITS)])
    around = met.filter(f"n > {SMALL}").select("fp").distinct().select("fp", F.explode(F.transform(ones, lambda b: F.col("fp").bitwiseXOR(b))).alias("centre"))
    ball = around.groupBy("centre").agg(F.collect_set("fp").alias("g")).filter("size(g) > 1")
    if radius == 2:
        large = ball.select(F.explode(F.transform(F.filter("g", lambda y: y > F.array_min("g")), lambda y: F.struct(F.array_min("g").alias("a"), y.alias("b")))).alias("l"))
    else:
        large = ball.select(F.explode(pair(F.col("g"))).alias("l"))
    return small.union(large).select("l.a", "l.b").distinct()


def classes(prints: DataFrame, doc_id: str = "doc_id", radius: int = 2) -> DataFrame:
    """Each row of `prints` (doc_id, fp, ...) with component_id: the least doc_id that links lead to, its own included.

    Rows with equal fingerprints are one node, so copies are never paired, and a group of copies meets only in sums and
    in a join whose large partitions Spark splits. Null doc_ids get their component's id and lend it none (null if
    there is no other). An empty table gives an empty one.
    """
    nodes = written(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = components(links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written, so that the joins below are of plain exchanges, whose large partitions Spark splits.
    placed = written(placed)
    ids = written(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(placed.join(ids, "root").select("fp", "component_id"), "fp")


def simhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, carried columns, fingerprint (16 hex digits), component_id."""
    keep = [doc_id, *[c for c in carry if c not in (doc_id, "fp", "component_id", "fingerprint")]]
    prints = written(fingerprints(docs, keep, text, shingle))
    found = classes(prints, doc_id, radius)
    return found.select(*keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
