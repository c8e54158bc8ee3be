"""Near-duplicate classes of whole texts at a word-shingle similarity.

Texts meet by their SimHash (see `simhash`: all pairs within a few bits) and, as pairs at a Jaccard similarity of 0.8
differ in four to eleven bits of 64, by bands of min-wise hashes. Meeting makes candidates only: a pair is linked when the
sets of its shingles have the similarity. Texts with equal signatures (SimHash and HASHES min-wise hashes) are
one node from the start.

Candidates are compared in three rounds, each against the classes then known. First those of each node with the
best estimates; then what is left of all pairs in buckets of up to PAIRED nodes, and of a maximum spanning forest of the estimates
in larger ones (buckets over BUCKET get longer keys for that); last all pairs of two classes that met in a bucket over
PAIRED. Those are compared where they meet: nodes with a partner of a near enough estimate bring their shingles to
their group, which passes on only the links that connect. So no pair of a bucket is lost, and none is emitted but the
links of a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Words, map_texts, mixed, small_batches, task, written
from weftline.llm.components import components
from weftline.llm.simhash import TABLE, fingerprint, links

#: Min-wise hashes of a signature; bands of ROWS of them. Two texts of similarity 0.8 share a band with probability 0.9996.
HASHES, BANDS, ROWS = 256, 26, 6
BUCKET, LEVELS, PAIRED = 512, 12, 32
#: An estimate from HASHES hashes has a standard error of 0.025 at 0.8; pairs from four of them under the similarity are compared by their shingles.
SLACK = 0.1
#: A group that is compared by shingles holds about so many nodes and shingles at most; a longer text is a block of its own.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Candidates of each node in the first round.
BEST = 2
#: Up to this many rows to drop (some 60 bytes each) are broadcast, so that texts are not shuffled; more are joined.
BROADCAST_ROWS = 500_000
_A = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(20)) >> np.uint64(13)).astype(np.uint32)


def hash_of(words: np.ndarray) -> np.uint64:
    """One hash of a few words' hashes."""
    own = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in words:
            own = own * np.uint64(0x9E3779B97F4A7C15) + x
    return mixed(np.array([own]))[0]


def signatures(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: HASHES bytes, BANDS keys, shingles. Shorter texts are one shingle; texts without words have zeros and no bands."""
    words = Words(texts, TABLE)
    n = np.diff(words.first)
    g, whole = words.grams(shingle)
    at, text = np.flatnonzero(whole), words.text[np.flatnonzero(whole)]
    h = g[at]
    few = np.flatnonzero((n > 0) & (n < shingle))
    for i in few.tolist():
        k = np.searchsorted(text, i)
        h, text = np.insert(h, k, hash_of(words.hashes[words.first[i] : words.first[i + 1]])), np.insert(text, k, i)
    mins = np.zeros((len(texts), HASHES), dtype=np.uint32)
    some = np.flatnonzero(n > 0)
    if len(some):
        starts = np.searchsorted(text, some)
        x = (h >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            mins[some, k] = np.minimum.reduceat((x ^ _B[k]) * _A[k], starts)
    keys = np.zeros((len(texts), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[:, b] = mixed(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + mins[:, b * ROWS + r] + np.uint64(b + 1))
    return ((mins * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8), keys.view(np.int64), np.maximum(n - shingle + 1, (n > 0).astype(n.dtype))


def sketched(docs: DataFrame, carry: list[str], text: str = "text", shingle: int = 5) -> DataFrame:
    """Each row's carried columns, fp (SimHash), sig (HASHES bytes), bands and n_shingles."""

    def make():
        def work(texts):
            sig, keys, n = signatures(texts, shingle)
            return {"fp": [fingerprint(t, shingle) for t in texts], "sig": [s.tobytes() for s in sig], "bands": list(keys), "n_shingles": n}

        return work

    return map_texts(docs, text, carry, "fp long, sig binary, bands array<long>, n_shingles long", make)


def _forest(group: np.ndarray, ids: list[int], similarity: float) -> list[tuple[int, int, float]]:
    """(a, b, estimated similarity) of a maximum spanning forest of the pairs that may be similar; of up to PAIRED nodes of all such pairs."""
    n = len(ids)
    agree = np.stack([(group == row).mean(axis=1) for row in group])
    agree = (agree - 1 / 256) / (1 - 1 / 256)  # unequal hashes agree in a byte by chance
    low = similarity - SLACK
    np.fill_diagonal(agree, -1)
    kept: set[tuple[int, int]] = set()
    left = np.ones(n, dtype=bool)
    best, to = np.full(n, -1.0), np.zeros(n, dtype=int)
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -2.0)))
        if best[i] >= low:
            kept.add((min(i, int(to[i])), max(i, int(to[i]))))
        left[i] = False
        better = agree[i] > best
        best[better], to[better] = agree[i][better], i
    if n <= PAIRED:
        kept |= {(int(i), int(j)) for i, j in np.argwhere(np.triu(agree >= low, 1))}
    return [(ids[i], ids[j], float(agree[i, j])) for i, j in sorted(kept)]


def _linker(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sigs = None, [], []
        batch_of = lambda found: pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "near"])

        def done() -> list[tuple[int, int, float]]:
            return _forest(np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(ids), -1), ids, similarity) if len(ids) > 1 else []

        with task(__name__):
            for batch in batches:
                found = []
                for band, key, node, sig in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if at != (band, key):
                        found += done()
                        at, ids, sigs = (band, key), [], []
                    ids.append(node)
                    sigs.append(sig)
                yield batch_of(found)
            yield batch_of(done())

    return run


def _sized(rows: DataFrame) -> DataFrame:
    """The buckets (band, key) of more than one row, with their number of rows n."""
    return rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")


def meetings(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n) of the nodes (node, bands) that share a bucket of n nodes."""
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    return written(keyed.join(_sized(keyed), ["band", "key"]).select("band", "key", "node", "n"))


def min_wise_links(nodes: DataFrame, meet: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, near) of the nodes (node, sig) that are or may be similar, with the estimate: see the module."""
    small_batches(nodes.sparkSession)
    parts = [meet.filter(f"n <= {BUCKET}").select("band", "key", "node")]
    large = meet.filter(f"n > {BUCKET}")
    for level in range(LEVELS):
        if large.isEmpty():
            break
        spot = F.pmod(F.lit(ROWS * BANDS + 2 * level) + 2 * F.col("band"), F.lit(HASHES - 1)).cast("int")
        longer = large.join(nodes.select("node", "sig"), "node").select("band", F.xxhash64("key", F.substr("sig", spot + 1, F.lit(2))).alias("key"), "node")
        now = written(longer.join(_sized(longer), ["band", "key"]).select("band", "key", "node", "n"))
        parts.append(now.filter(f"n <= {BUCKET}").select("band", "key", "node"))
        large = now.filter(f"n > {BUCKET}")
    else:
        blocks = F.ceil(F.col("n") / (BUCKET // 2)).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        pairs = large.select("band", "key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        parts.append(pairs.select("band", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    dealt = rows.join(nodes.select("node", "sig"), "node").select("band", "key", "node", "sig")
    return dealt.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(_linker(similarity), "a long, b long, near double").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("near").alias("near"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of equal first values, with the rest of their rows."""
    at, rows = None, []
    for batch in batches:
        columns = [[x.values.to_numpy(zero_copy_only=False) for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for group, *row in zip(*columns, strict=True):
            if at != group and rows:
                yield at, rows
                rows = []
            at = group
            rows.append(row)
    if rows:
        yield at, rows


def _partners(similarity: float):
    """Of groups of rows (group, side, root, node, sig): those whose estimate with one of another root, across the sides if there are two, is near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(__name__):
            for group, rows in _groups(batches):
                side, root, node = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
                sigs = np.frombuffer(b"".join([r[3] for r in rows]), dtype=np.uint8).reshape(len(rows), -1)
                one = np.flatnonzero(side == 0)
                two = np.flatnonzero(side == 1) if side.any() else one
                some = np.zeros(len(rows), dtype=bool)
                for i in one.tolist():
                    agree = ((sigs[two] == sigs[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                    hit = two[(agree >= similarity - SLACK) & (root[two] != root[i])]
                    some[hit] = True
                    some[i] |= len(hit) > 0
                at = np.flatnonzero(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group), pa.int64()), *[pa.array(x[at], pa.int64()) for x in (side, root, node)]], names=["group", "side", "root", "node"])

    return run


def _linked(similarity: float):
    """Of groups of rows (group, side, root, node, shingles): links (a, b) of nodes with the similarity, as many as connect what can be connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(__name__):
            for _, rows in _groups(batches):
                found = connecting([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], similarity)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def connecting(side: list[int], root: list[int], node: list[int], sets: list, similarity: float) -> list[tuple[int, int]]:
    """Links between the nodes of a group (sets: without repeats), across the sides if there are two, that connect all that have the similarity."""
    size = np.array([len(x) for x in sets])
    values, index = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in sets]), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    up = {r: r for r in root}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    across = any(side)
    out = []
    for i in range(len(node)):
        if across and side[i]:
            continue
        mark = np.zeros(len(values), dtype=bool)
        mark[index[starts[i] : starts[i] + size[i]]] = True
        shared = np.add.reduceat(mark[index], starts)
        for j in np.flatnonzero(shared >= similarity * (size + size[i] - shared)).tolist():
            if j != i and (not across or side[j]) and (x := top(root[i])) != (y := top(root[j])):
                up[x] = y
                out.append((min(node[i], node[j]), max(node[i], node[j])))
    return out


def shingle_sets(nodes: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes (node, text_hash); only their texts are read into sets."""
    hashed = docs.select(F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    hashes = written(nodes.select("text_hash").distinct())
    if hashes.count() <= BROADCAST_ROWS:
        hashes = F.broadcast(hashes)
    texts = hashed.join(hashes, "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def make():
        def work(parts):
            words = Words(parts, TABLE)
            n = np.diff(words.first)
            g, _ = words.grams(shingle)
            sets = [np.unique(g[lo : max(lo, hi - shingle + 1)]) for lo, hi in zip(words.first[:-1], words.first[1:], strict=True)]
            # A text of fewer words is one shingle, whose words are hashed together.
            few = lambda i: np.array([hash_of(words.hashes[words.first[i] : words.first[i + 1]])], dtype=np.uint64)
            return {"shingles": [(x if len(x) or not k else few(i)).view(np.int64) for i, (x, k) in enumerate(zip(sets, n, strict=True))]}

        return work

    return written(map_texts(texts, "t", ["text_hash"], "shingles array<long>", make).join(nodes.select("node", "text_hash"), "text_hash").select("node", "shingles"))


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets (node, shingles) have the similarity."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return met.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def apart(meet: DataFrame, nodes: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of nodes (node, sig, n_shingles; sets: node, shingles) that meet in a bucket over PAIRED, are in two classes (node, root) of `found`, and have the similarity.

    Nodes of a bucket are dealt to blocks, a large class to blocks of its own, and blocks are compared two by two but
    for those of one class. So a class of very many near copies is compared with what is outside it only.
    """
    small_batches(nodes.sparkSession)
    weight = nodes.select("node", F.col("n_shingles").alias("w"))
    large = meet.filter(f"n > {PAIRED}").select("band", "key", "node").join(weight, "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks_of = lambda n, w: F.ceil(F.greatest(n / F.lit(BLOCK), w / F.lit(BLOCK_SHINGLES)))
    classes = written(large.groupBy("band", "key", "root").agg(F.count("*").alias("m"), F.sum("w").alias("w")))
    classes = classes.withColumn("own", blocks_of(F.col("m"), F.col("w")))
    few = lambda c: F.sum(F.when(F.col("own") <= 1, F.col(c)).otherwise(0))
    mixed_ = classes.groupBy("band", "key").agg(blocks_of(few("m"), few("w")).alias("others"), F.count("*").alias("k")).filter("k > 1").drop("k")
    sized = large.drop("w").join(classes.select("band", "key", "root", "own"), ["band", "key", "root"]).join(mixed_, ["band", "key"])
    part = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    own = F.when(F.col("own") > 1, F.col("root"))
    block = F.when(own.isNull(), part(F.col("others"))).otherwise(F.xxhash64("root", part(F.col("own"))))
    rows = written(sized.select("band", "key", "node", "root", block.cast("long").alias("block"), own.alias("own")))
    blocks = rows.select("band", "key", "block", "own").distinct()
    x, y = (blocks.select("band", "key", F.struct(F.col("own").isNotNull().alias("one"), "block").alias(k), F.col("own").alias(f"{k}_own")) for k in "xy")
    pairs = x.join(y, ["band", "key"]).filter("x <= y and (x_own is null or y_own is null or x_own != y_own)")
    pairs = written(pairs.select("band", "key", "x", "y", F.xxhash64("band", "key", "x", "y").alias("group")))
    sides = pairs.select("band", "key", F.col("x").alias("at"), "group", F.lit(0).alias("side")).union(pairs.filter("x != y").select("band", "key", F.col("y").alias("at"), "group", F.lit(1).alias("side")))
    given = rows.select("band", "key", "node", "root", F.struct(F.col("own").isNotNull().alias("one"), "block").alias("at"))
    dealt = given.join(sides, ["band", "key", "at"]).join(nodes.select("node", "sig"), "node").select("group", "side", "root", "node", "sig")
    near = written(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_partners(similarity), "group long, side long, root long, node long"))
    met = near.join(sets, "node").select("group", "side", "root", "node", "shingles")
    return met.repartition("group").sortWithinPartitions("group").mapInArrow(_linked(similarity), "a long, b long").distinct()


def near_classes(docs: DataFrame, carry: list[str], text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """Each row's carried columns, n_shingles and `root`, equal for the rows of one near-duplicate class.

    Words are runs of other than ASCII white space, A-Z lower-cased. Texts without words are one class. Only
    signatures are shuffled, distinct ones, and never texts; classes are found by `components`.
    """
    carry = [c for c in carry if c not in ("fp", "sig", "bands", "n_shingles", "node", "root", "text_hash")]
    given = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text])], F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    rows = written(sketched(given, [*carry, "text_hash"], text, shingle).withColumn("node", F.xxhash64("fp", "sig")))
    nodes = written(rows.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.max("n_shingles").alias("n_shingles")))
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    bits = links(nodes.select("fp").distinct(), radius)
    close = bits.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    meet = meetings(nodes.filter("n_shingles > 0"))
    simhash = same.union(close).withColumn("near", F.lit(1.0))
    pairs = written(min_wise_links(nodes, meet, similarity).union(simhash).groupBy("a", "b").agg(F.max("near").alias("near")))
    ends = pairs.select(F.col("a").alias("node"), "a", "b", "near").union(pairs.select(F.col("b").alias("node"), "a", "b", "near"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("near"), "a", "b"))
    best = written(ends.withColumn("k", place).filter(f"k <= {BEST}").select("a", "b").distinct())
    # The shingles of all nodes that any round may compare, made once.
    wanted = ends.select("node").union(meet.filter(f"n > {PAIRED}").select("node")).distinct()
    sets = shingle_sets(written(nodes.join(wanted, "node").select("node", "text_hash")), docs, text, shingle)
    proven = [written(compared(best, sets, similarity))]
    found = written(components(proven[0]))
    roots = lambda k: found.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    left = pairs.join(best, ["a", "b"], "left_anti").join(roots("a"), "a", "left").join(roots("b"), "b", "left")
    left = written(left.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
    if not left.isEmpty():
        proven.append(written(compared(left, sets, similarity)))
        found = written(components(proven[0].union(proven[1])))
    if not (rest := written(apart(meet, nodes, found, sets, similarity))).isEmpty():
        found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(rest))
    return rows.join(found, "node", "left").select(*carry, "n_shingles", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the least doc_id (null last), of rows that are equal in id and text any one.

    A row is known by its doc_id and a hash of its text, so its columns are read once more and joined with the rows to drop.
    """
    key = [F.col(f"`{doc_id}`").cast("string").alias("__id"), F.xxhash64(F.col(f"`{text}`"), F.length(F.col(f"`{text}`"))).alias("__hash")]
    rows = written(near_classes(docs.select(F.col(f"`{doc_id}`").alias("__doc"), *key, F.col(f"`{text}`").alias("__text")), ["__doc", "__id", "__hash"], "__text", **options))
    place = F.struct(F.col("__doc").isNull().alias("n"), F.col("__doc").alias("d"), F.col("__hash").alias("h"))
    # Written, so that the join with it is of two plain exchanges, whose large partitions Spark splits.
    least = written(rows.groupBy("root").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("root", "kept"))
    gone = rows.join(least, "root").filter(place != F.col("kept")).select("__id", "__hash").distinct()
    twice = written(rows.groupBy("__id", "__hash").count().filter("count > 1").select("__id", "__hash"))
    marked = docs.select("*", *key)
    met = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__hash"] == b["__hash"])
    if (gone := written(gone)).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = marked.join(gone, met(marked, gone), "left_anti")
    if not twice.isEmpty():
        few = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
        once = kept.join(few, met(kept, few), "left_anti")
        kept = once.union(kept.join(few, met(kept, few), "left_semi").dropDuplicates(["__id", "__hash"]))
    return kept.drop("__id", "__hash")
