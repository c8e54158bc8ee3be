"""Classes of documents under a Jaccard similarity, by an exact join in the metric space of the distance d = 1 - similarity.

A document is its set of distinct shingles; documents of equal sets are one node. Two sets that link share a shingle of
their prefixes: the first n - ceil(similarity * n) + 1 of a set of n in an order that all sets agree on. Nodes that share
no prefix shingle with any other have no link and go no further. Shingles that many prefixes hold are put last in the
order: they are counted in the prefixes of the order so far, ROUNDS times, and marked in a bit array of a fixed size.
Marks of other shingles by chance cost time, never a link, as every document reads the same array.

- Pivots. The least node of each shared prefix shingle is a pivot, to whose Voronoi region all nodes come that share a
  prefix shingle of it: the nearest pivot is a node's home, in the regions of the others it is a boundary document. Two nodes
  that link share a prefix shingle, so they meet in the region of its pivot. Links to pivots give classes; a region whose
  nodes are all of one class is finished.
- Images. A set's image counts its shingles in IMAGE buckets of their hashes. The Jaccard distance of counts is a metric too, and
  images are never further from each other than their sets. So images of a fixed size rule pairs out, and give distances to
  pivots, before any set is read: sets are read for pairs whose images link.
- Windows. Regions are cut into rings of the linking radius r by the images' distance to the pivot. As |d(x,p) - d(y,p)| <= d(x,y),
  nodes link inside a ring or with the next one only, which is replicated to it. Large rings are dealt to parts that meet two by
  two. Nodes of one class are never compared.
- Recursion. A task that holds a part's sets chooses pivots in it, gives each node to its nearest and to all that are at most
  2 r further, and goes on inside, until few nodes are left or they are too dense to be parted. Only links that connect leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Words, map_texts, mixed, small_batches, task, written
from weftline.llm.components import components
from weftline.llm.near import hash_of
from weftline.llm.simhash import TABLE

#: How often shingles are counted in prefixes before the order is final.
ROUNDS = 2
#: Bits of the array of frequent shingles, 16 MB at any size of the data; one in LOAD of them may be set.
FILTER_BITS, LOAD = 1 << 27, 8
#: Counts of an image.
IMAGE = 128
#: A task's part of a ring holds about so many nodes and shingles at most; a larger set is a part of its own.
BLOCK, BLOCK_SHINGLES = 128, 1 << 19
#: Nodes that are compared without further pivots, and pivots of one step of the recursion.
LEAF, PIVOTS = 48, 6
#: Up to this many text hashes (some 60 bytes each) are broadcast, so that texts are not shuffled; more are joined.
BROADCAST_ROWS = 500_000


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles two linked sets must share one of: all but the least number that they have in common, and one."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def shingle_hashes(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes. Fewer words than `shingle` are one; no words are none.

    Unequal shingles have equal hashes with probability of about 2^-64.
    """
    words = Words(texts, TABLE)
    g, _ = words.grams(shingle)
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            out.append(np.unique(g[lo : hi - shingle + 1]))
        else:
            out.append(np.array([hash_of(words.hashes[lo:hi])] if hi > lo else [], dtype=np.uint64))
    return out


def _node(x: np.ndarray) -> int:
    """A number of a set: equal for equal sets, for others with probability of about 2^-64."""
    with np.errstate(over="ignore"):
        total = mixed(x + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) * np.uint64(2) + np.uint64(len(x))
    return int(mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _marked(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (x >> np.uint64(37)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _prefix(x: np.ndarray, bits: np.ndarray | None, percent: int) -> np.ndarray:
    k = int(prefix_length(np.array(len(x)), percent))
    if bits is not None:
        some = _marked(x, bits)
        x = np.concatenate((x[~some], x[some]))
    return x[:k].view(np.int64)


def _image(x: np.ndarray) -> bytes:
    return np.bincount((x & np.uint64(IMAGE - 1)).astype(np.int64), minlength=IMAGE).astype("<u4").tobytes()


def _images(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u4").reshape(len(column), IMAGE)


def sketched(docs: DataFrame, carry: list[str], text: str, shingle: int, percent: int) -> DataFrame:
    """Each row's carried columns, node (null: no shingles), n_shingles, and prefix in the order of hashes alone."""

    def make():
        def work(texts):
            sets = shingle_hashes(texts, shingle)
            return {"node": [_node(x) if len(x) else None for x in sets], "n_shingles": [len(x) for x in sets], "prefix": [_prefix(x, None, percent) for x in sets]}

        return work

    return map_texts(docs, text, carry, "node long, n_shingles long, prefix array<long>", make)


def _texts_of(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(t, text_hash) of one text for each of the nodes' (node, text_hash)."""
    hashed = docs.select(F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    hashes = written(nodes.select("text_hash").distinct())
    if hashes.count() <= BROADCAST_ROWS:
        hashes = F.broadcast(hashes)
    return hashed.join(hashes, "text_hash", "left_semi")


def _filter(spark: SparkSession, counted: DataFrame, old: np.ndarray | None) -> np.ndarray:
    """The bit array with the shingles that are in more prefixes than a limit: the least power of two minus one at which they fit. FILTER_BITS / 64 rows reach the driver at most."""
    most = FILTER_BITS // LOAD
    sizes = counted.filter("n > 1").groupBy(F.floor(F.log2("n")).alias("k")).count().collect()
    left, least = sum(r["count"] for r in sizes), 1
    for r in sorted(sizes, key=lambda r: r.k):
        if left <= most:
            break
        left, least = left - r["count"], r.k + 1
    at = F.shiftrightunsigned("s", 37)
    found = counted.filter(F.col("n") >= 2**least).select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(s, 37) & 63 as int))").alias("bit"))
    words = np.zeros(FILTER_BITS // 64, dtype=np.uint64) if old is None else old.view(np.uint64).copy()
    table = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words[table["word"].to_numpy()] |= table["bits"].to_numpy().view(np.uint64)
    return words.view(np.uint8)


def prefixes(nodes: DataFrame, docs: DataFrame, text: str, shingle: int, percent: int, bits: np.ndarray) -> DataFrame:
    """(node, prefix, image) of the nodes (node, text_hash), prefixes in the order of the array."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        def work(texts):
            sets = shingle_hashes(texts, shingle)
            return {"node": [_node(x) for x in sets], "prefix": [_prefix(x, shared.value, percent) for x in sets], "image": [_image(x) for x in sets]}

        return work

    return map_texts(_texts_of(nodes, docs, text), "t", [], "node long, prefix array<long>, image binary", make).dropDuplicates(["node"])


def pivots_of(nodes: DataFrame, docs: DataFrame, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, pivot) of all nodes that share a prefix shingle with a pivot, and (node, image); nodes: (node, text_hash, prefix)."""
    spark = docs.sparkSession
    bits = None
    alive = nodes
    for _ in range(ROUNDS):
        postings = alive.select("node", F.explode("prefix").alias("s"))
        counted = written(postings.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"))
        # In any order that all agree on, a node that shares no prefix shingle has no link.
        held = written(postings.join(counted.select("s"), "s", "left_semi").select("node").distinct())
        bits = _filter(spark, counted, bits)
        rest = written(nodes.join(held, "node", "left_semi").select("node", "text_hash"))
        alive = written(prefixes(rest, docs, text, shingle, percent, bits))
    postings = alive.select("node", F.explode("prefix").alias("s"))
    counted = written(postings.groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1"))
    met = written(postings.join(counted.select("s", "pivot"), "s").filter("node != pivot").select("node", "pivot").distinct())
    return met, alive.select("node", "image")


def imaged(met: DataFrame, images: DataFrame) -> DataFrame:
    """(node, pivot, small, large): the sums of the lesser and of the greater counts of both images, which bound intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(__name__):
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    node, pivot, x, y = batch.slice(lo, 4096).columns
                    x, y = _images(x.to_pylist()), _images(y.to_pylist())
                    small, large = np.minimum(x, y).sum(axis=1, dtype=np.int64), np.maximum(x, y).sum(axis=1, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([node, pivot, pa.array(small, pa.int64()), pa.array(large, pa.int64())], names=["node", "pivot", "small", "large"])

    given = met.join(images, "node").join(images.select(F.col("node").alias("pivot"), F.col("image").alias("other")), "pivot").select("node", "pivot", "image", "other")
    return given.mapInArrow(run, "node long, pivot long, small long, large long")


def shingle_sets(nodes: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes (node, text_hash)."""

    def make():
        def work(texts):
            sets = shingle_hashes(texts, shingle)
            return {"node": [_node(x) for x in sets], "shingles": [x.view(np.int64) for x in sets]}

        return work

    return written(map_texts(_texts_of(nodes, docs, text), "t", [], "node long, shingles array<long>", make).dropDuplicates(["node"]))


def measured(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, pivot, shared, total): sizes of intersection and union of the pairs (node, pivot)."""
    x = sets.select("node", F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return met.join(x, "node").join(y, "pivot").select("node", "pivot", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("total"))


def region_parts(near: DataFrame, classes: DataFrame, sizes: DataFrame, radius: float) -> DataFrame:
    """(grp, side, root, node, d) of the rings' parts that hold nodes of several classes.

    near: (node, pivot, d); classes: (node, root); sizes: (node, n_shingles). A ring's group holds its own nodes as side 0
    and those of the next ring as side 1; parts of a large group meet two by two.
    """
    pivots = near.select(F.col("pivot").alias("node"), "pivot", F.lit(0.0).alias("d")).distinct()
    members = near.select("node", "pivot", "d").union(pivots).join(sizes, "node").join(classes, "node", "left")
    members = written(members.select("pivot", "node", "d", F.col("n_shingles").alias("w"), F.coalesce("root", "node").alias("root"), F.floor(F.col("d") / (radius * (1 + 1e-6))).cast("int").alias("ring")))
    open_ = members.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("pivot")
    members = members.join(written(open_), "pivot")
    windows = F.explode(F.array(F.struct(F.col("ring").alias("at"), F.lit(0).alias("side")), F.struct((F.col("ring") - 1).alias("at"), F.lit(1).alias("side"))))
    dealt = members.withColumn("window", windows).select("pivot", "window.at", "window.side", "node", "root", "d", "w").filter("at >= 0")
    # By class: a class of many nodes gets parts of its own, the others share some.
    parts = lambda n, w: F.ceil(F.greatest(n / F.lit(BLOCK), w / F.lit(BLOCK_SHINGLES)))
    held = written(dealt.groupBy("pivot", "at", "root").agg(F.count("*").alias("m"), F.sum("w").alias("w"), F.min("side").alias("first")))
    held = held.withColumn("own", parts(F.col("m"), F.col("w")))
    few = lambda c: F.sum(F.when(F.col("own") <= 1, F.col(c)).otherwise(0))
    groups = held.groupBy("pivot", "at").agg(parts(few("m"), few("w")).alias("others"), F.count("*").alias("k"), F.min("first").alias("first")).filter("k > 1 and first = 0")
    groups = written(groups.select("pivot", "at", "others"))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))
    sized = dealt.join(written(held.select("pivot", "at", "root", "own")), ["pivot", "at", "root"]).join(groups, ["pivot", "at"])
    own = F.when(F.col("own") > 1, F.col("root"))
    part = F.when(own.isNull(), deal(F.col("others"))).otherwise(F.xxhash64("root", deal(F.col("own"))))
    rows = written(sized.select("pivot", "at", "side", "node", "root", "d", part.cast("long").alias("part"), own.alias("own")))
    found = rows.select("pivot", "at", "part", "own").distinct()
    x, y = (found.select("pivot", "at", F.struct(F.col("own").isNotNull().alias("one"), "part").alias(k), F.col("own").alias(f"{k}_own")) for k in "xy")
    pairs = x.join(y, ["pivot", "at"]).filter("x <= y and (x_own is null or y_own is null or x_own != y_own)")
    pairs = written(pairs.select("pivot", "at", "x", "y", F.xxhash64("pivot", "at", "x", "y").alias("grp")))
    ends = pairs.select("pivot", "at", F.col("x").alias("p"), "grp", F.lit(0).alias("half")).union(pairs.filter("x != y").select("pivot", "at", F.col("y").alias("p"), "grp", F.lit(1).alias("half")))
    given = rows.select("pivot", "at", "side", "node", "root", "d", F.struct(F.col("own").isNotNull().alias("one"), "part").alias("p"))
    return given.join(ends, ["pivot", "at", "p"]).select("grp", "half", "side", "root", "node", "d")


def _partners(percent: int):
    """Of groups of rows (grp, half, side, root, node, d, image): those that their image lets link with one of another class, half and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftline.llm.near import _groups

        with task(__name__):
            for grp, rows in _groups(batches):
                half, side, root, node = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
                d, images = np.array([r[4] for r in rows]), _images([r[5] for r in rows])
                size = images.sum(axis=1, dtype=np.int64)
                across, some = bool(half.any()), np.zeros(len(rows), dtype=bool)
                for i in np.flatnonzero(half == 0).tolist():
                    fit = (root != root[i]) & (side + side[i] < 2) & (np.abs(d - d[i]) <= 1 - percent / 100 + 1e-9)
                    at = np.flatnonzero(fit & (half == 1) if across else fit)
                    small = np.minimum(images[at], images[i]).sum(axis=1, dtype=np.int64)
                    at = at[100 * small >= percent * (size[at] + size[i] - small)]
                    some[at] = True
                    some[i] |= len(at) > 0
                at = np.flatnonzero(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), grp), pa.int64()), *[pa.array(x[at], pa.int64()) for x in (half, side, root, node)], pa.array(d[at], pa.float64())],
                    names=["grp", "half", "side", "root", "node", "d"],
                )

    return run


class Region:
    """The nodes of a part: finds links that connect what can be connected, by recursion on pivots."""

    def __init__(self, half: list[int], side: list[int], root: list[int], node: list[int], d: list[float], sets: list[np.ndarray], percent: int) -> None:
        self.half, self.side, self.node = np.array(half), np.array(side), node
        self.percent, self.radius = percent, 1 - percent / 100
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        _, index = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(self.size)
        self.sets = [index[a:b] for a, b in zip(ends - self.size, ends, strict=True)]
        self.mark = np.zeros(int(index.max()) + 1, dtype=np.int64)
        self.across = bool(self.half.any())
        self.d = np.array(d)
        #: Each node's class, and the nodes of each.
        names, self.at = np.unique(np.array(root), return_inverse=True)
        self.members = [np.flatnonzero(self.at == k).tolist() for k in range(len(names))]
        self.links: list[tuple[int, int]] = []
        self.compared = 0

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """The size of the intersection of node i's set with each of the others."""
        self.mark[self.sets[i]] = 1
        starts = np.concatenate(([0], np.cumsum(self.size[others])[:-1]))
        found = np.add.reduceat(self.mark[np.concatenate([self.sets[j] for j in others])], starts)
        self.mark[self.sets[i]] = 0
        self.compared += len(others)
        return found

    def _join(self, a: int, b: int) -> None:
        x, y = sorted((int(self.at[a]), int(self.at[b])), key=lambda k: len(self.members[k]))
        self.at[self.members[x]] = y
        self.members[y] += self.members[x]
        self.members[x] = []
        self.links.append((self.node[a], self.node[b]))

    def _leaf(self, ids: np.ndarray, table: np.ndarray) -> None:
        """Compares all pairs that no pivot's distance (columns of `table`), size, class, side or half rules out."""
        for k in range(len(ids) - 1):
            i, later = ids[k], np.arange(k + 1, len(ids))
            other = ids[later]
            small, large = np.minimum(self.size[i], self.size[other]), np.maximum(self.size[i], self.size[other])
            fit = (self.at[other] != self.at[i]) & (100 * small >= self.percent * large) & (self.side[other] + self.side[i] < 2)
            if self.across:
                fit &= self.half[other] != self.half[i]
            fit &= (np.abs(table[later] - table[k]) <= self.radius + 1e-9).all(axis=1)
            other = other[fit]
            if len(other):
                shared = self.shared(i, other)
                for j in other[100 * shared >= self.percent * (self.size[i] + self.size[other] - shared)].tolist():
                    if self.at[i] != self.at[j]:
                        self._join(int(i), j)

    def solve(self, ids: np.ndarray | None = None, table: np.ndarray | None = None) -> list[tuple[int, int]]:
        if ids is None:
            ids, table = np.arange(len(self.node)), self.d[:, None]
        if len(np.unique(self.at[ids])) < 2:
            return self.links
        if len(ids) <= LEAF:
            self._leaf(ids, table)
            return self.links
        # Each pivot after the first is the node furthest from those before it.
        far, spread, at = [], np.full(len(ids), np.inf), 0
        for _ in range(PIVOTS):
            shared = self.shared(int(ids[at]), ids)
            far.append(1 - shared / (self.size[ids] + self.size[ids[at]] - shared))
            spread = np.minimum(spread, far[-1])
            at = int(spread.argmax())
            if spread[at] == 0:
                break
        far = np.stack(far, axis=1)
        window = far <= far.min(axis=1)[:, None] + 2 * self.radius + 1e-9
        table = np.concatenate((table, far), axis=1)
        if (window.sum(axis=0) ** 2).sum() > 0.7 * len(ids) ** 2:  # too dense to be parted
            self._leaf(ids, table)
        else:
            for own in window.T:
                self.solve(ids[own], table[own])
        return self.links


def _joined(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftline.llm.near import _groups

        with task(__name__):
            for _, rows in _groups(batches):
                half, side, root, node, d, sets = zip(*rows, strict=True)
                found = Region(list(half), list(side), list(root), list(node), list(d), list(sets), percent).solve()
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least doc_id that links lead to, its own included).

    Words are runs of other than ASCII white space, A-Z lower-cased. Two documents link if percent * union <= 100 * intersection of
    their sets; null texts and texts without words have no set and link with nothing, their component is their own doc_id. Null
    doc_ids get their component's id and lend it none (null if there is no other). Repeated rows count each; empty tables stay
    empty, other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    rows = written(sketched(given, ["doc_id", "text_hash"], "__text", shingle, percent))
    nodes = written(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.max("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix")))
    met, images = pivots_of(nodes, docs, text, shingle, percent)
    near = written(imaged(met, images))
    able = near.filter(100 * F.col("small") >= percent * F.col("large")).select("node", "pivot")
    sets = lambda wanted: shingle_sets(nodes.join(wanted.distinct(), "node", "left_semi").select("node", "text_hash"), docs, text, shingle)
    sizes = measured(able, sets(able.select("node").union(able.select(F.col("pivot").alias("node")))))
    links = sizes.filter(100 * F.col("shared") >= percent * F.col("total")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    found = written(components(links))
    parts = region_parts(near.select("node", "pivot", (1 - F.col("small") / F.col("large")).alias("d")), found, nodes.select("node", "n_shingles"), 1 - percent / 100)
    dealt = parts.join(images, "node").select("grp", "half", "side", "root", "node", "d", "image")
    kind = "grp long, half long, side long, root long, node long, d double"
    open_ = written(dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_partners(percent), kind))
    dealt = open_.join(sets(open_.select("node")), "node").select("grp", "half", "side", "root", "node", "d", "shingles")
    more = written(dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_joined(percent), "a long, b long").distinct())
    if not more.isEmpty():
        found = written(components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)))
    placed = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that the join with it is of plain exchanges, whose large partitions Spark splits.
    named = written(placed.join(ids, "root").select("node", "component_id"))
    return rows.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
