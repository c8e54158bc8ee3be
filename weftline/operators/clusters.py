"""Average-linkage clustering of predicate vectors under a cosine distance, and labels for the clusters.

The mean distance between the members of two clusters is one less the inner product of the means of their unit vectors,
so a cluster is a size and a mean, and no table of distances is kept. Average linkage is reducible: a cluster is never
nearer to the union of two others than to the nearer of them. So each round merges all pairs of clusters that are each
other's nearest under the threshold, as taking the nearest pair each time would in the end; a cluster with no other under
the threshold is finished. Ties go to the least id. The few clusters that are left are merged in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import cleaned_label, singleton_label
from weftline.operators.metric_index import nearest_under
from weftline.runtime import materialised

#: Clusters whose distances one task holds as a matrix (130 MB); with as many left or fewer the rounds end.
FEW = 4096
#: Distances are compared to this many decimals, so that rounding does not part ties.
DECIMALS = 12


def average_linkage(means: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers, by first member, of clusters of unit vectors with these means and sizes: the nearest two merge while their mean distance is under the threshold; ties to the first."""
    n = len(means)
    d = np.round(1 - means @ means.T, DECIMALS)
    np.fill_diagonal(d, np.inf)
    size, label = sizes.astype(float), np.arange(n)
    # Each row's nearest, so that a merge looks at rows whose nearest it changes and not at all pairs.
    to = d.argmin(axis=1) if n else np.zeros(0, dtype=int)
    least = d[np.arange(n), to]
    for _ in range(n - 1):
        i = int(np.argmin(least))
        j = int(to[i])
        if not least[i] < threshold:
            break
        i, j = min(i, j), max(i, j)
        joined = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        near = d[:, i]
        sooner = (near < least) | ((near == least) & (i < to))
        again = (to == i) | (to == j)
        to[sooner], least[sooner] = i, near[sooner]
        for k in {i, j, *np.flatnonzero(again).tolist()}:
            to[k] = d[k].argmin()
            least[k] = d[k, to[k]]
    return np.unique(label, return_inverse=True)[1]


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) by spreading least ids, with pointers doubled each round."""
    edges = materialised(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialised(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    while not labels.isEmpty():
        seen = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("seen"))
        step = labels.join(seen, labels.id == seen.a).select("id", "component", F.least("component", "seen").alias("to"))
        far = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        now = materialised(step.join(far, "to", "left").select("id", "component", F.least("to", "further").alias("after")))
        done = now.filter("component != after").isEmpty()
        labels = now.select("id", F.col("after").alias("component"))
        if done:
            break
    return labels


def _merged(active: DataFrame, pairs: DataFrame) -> DataFrame:
    """The clusters (id, size, vector) after the pairs (a, b) have each become one of id a."""
    gone = active.join(pairs.select(F.col("b").alias("id"), "a"), "id").select("a", F.col("size").alias("n"), F.col("vector").alias("v"))
    left = active.join(pairs.select(F.col("b").alias("id")), "id", "left_anti").withColumnsRenamed({"size": "m", "vector": "u"})
    mean = F.zip_with("u", "v", lambda x, y: (x * F.col("m") + y * F.col("n")) / (F.col("m") + F.col("n")))
    alone = F.col("n").isNull()
    return left.join(gone, F.col("id") == F.col("a"), "left").select("id", (F.col("m") + F.coalesce("n", F.lit(0.0))).alias("size"), F.when(alone, F.col("u")).otherwise(mean).alias("vector"))


def _finished(active: DataFrame, threshold: float) -> DataFrame:
    """Merges (a, b) of the last few clusters, made by one task."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids = frame["id"].to_numpy()
        own = average_linkage(np.array(frame["vector"].tolist(), dtype=float), frame["size"].to_numpy(), threshold)
        first = frame["id"].groupby(own).transform("min").to_numpy()
        return pd.DataFrame({"a": first[first != ids], "b": ids[first != ids]})

    return active.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merge, "a long, b long")


def clustered(rows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(id, cluster) of rows (id long, vector): cluster is the least id in it. Fewer than two rows are clusters of their own.

    Vectors have one length; one without length (all zeros) is at distance 1 from all. Rows of one direction begin as one
    cluster if the threshold is over zero. Each round writes the clusters that are left, so a lost executor repeats one round.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    unit = F.transform("vector", lambda x: F.when(F.col("norm") > 0, F.round(x.cast("double") / F.col("norm"), DECIMALS + 3)).otherwise(0.0))
    given = materialised(rows.select("id", "vector").withColumn("norm", norm).select("id", unit.alias("vector"), (F.col("norm") > 0).alias("turned")))
    # Equal directions are at distance 0: one cluster, whatever their number.
    joined = F.col("turned") if threshold > 0 else F.lit(False)
    key = F.when(joined, F.lit(0)).otherwise(F.col("id"))
    first = materialised(given.groupBy("vector", key.alias("k")).agg(F.min("id").alias("first"), F.count("*").cast("double").alias("size")))
    keyed = given.withColumn("k", key)
    merges = [materialised(keyed.join(first, ["vector", "k"]).filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")))]
    active = first.select(F.col("first").alias("id"), "size", "vector")
    while True:
        near = materialised(nearest_under(active, threshold, DECIMALS))
        left = near.count()
        if not left:
            break
        active = materialised(active.join(near.select("id"), "id", "left_semi"))
        if left <= FEW:
            merges.append(_finished(active, threshold))
            break
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = materialised(near.select("id", "other").join(back, ["id", "other"]).filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")))
        merges.append(pairs)
        active = materialised(_merged(active, pairs))
    edges = merges[0]
    for more in merges[1:]:
        edges = edges.union(more)
    found = components(edges)
    return given.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def cluster_members(unmapped: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, members array<struct<predicate, definition>>) of rows (id, predicate, definition)."""
    listed = unmapped.join(clusters, "id").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", "predicate", "definition"))).alias("m"))
    return listed.select("cluster", F.transform("m", lambda m: F.struct(m["predicate"].alias("predicate"), m["definition"].alias("definition"))).alias("members"))


def split_single(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return members.filter(F.size("members") == 1), members.filter(F.size("members") > 1)


def labelled(members: DataFrame, answers: DataFrame) -> DataFrame:
    """(cluster, members, label): one member's own name as a label, else the answer (cluster, answer) cleaned, or the first member's name."""
    single, several = split_single(members)
    name = F.col("members")[0]["predicate"]
    one = single.withColumn("label", singleton_label(name))
    return one.unionByName(several.join(answers, "cluster", "left").withColumn("label", cleaned_label(F.col("answer"), name)).select("cluster", "members", "label"))


def predicate_labels(labels: DataFrame) -> DataFrame:
    """(key, label) by lower-cased member name."""
    return labels.select(F.explode("members").alias("m"), "label").select(F.lower("m.predicate").alias("key"), "label").groupBy("key").agg(F.max("label").alias("label"))


def mapping_applied(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Unmapped rows whose lower-cased original predicate has a label get it as predicate, and canonicalization_method cluster_llm."""
    name = F.lower(F.coalesce(F.nullif(F.col("original_predicate"), F.lit("")), F.col("predicate"), F.lit("")))
    joined = rows.withColumn("__key", name).join(labels.select(F.col("key").alias("__key"), F.col("label").alias("__label")), "__key", "left")
    hit = F.col("__label").isNotNull() & ~F.coalesce("canonicalized", F.lit(True))
    method = F.col("canonicalization_method") if "canonicalization_method" in rows.columns else F.lit(None).cast("string")
    out = joined.withColumns({
        "canonicalization_method": F.when(hit, F.lit("cluster_llm")).otherwise(method),
        "canonical_predicate": F.when(hit, F.col("__label")).otherwise(F.col("canonical_predicate")),
        "canonicalized": F.when(hit, F.lit(True)).otherwise(F.col("canonicalized")),
    })
    return out.drop("__key", "__label")
