"""Definitions kept between runs."""

import os
import re

from pyspark.sql import functions as F

from weftline.operators import cache
from weftline.operators.models import FunctionCompleter, LetterCounts
from weftline.plans import align

KG = "pos long, sentence string, subject string, predicate string, object string"
SCHEMA = "key string, definition string"


def held(spark, path, *keys):
    return {r.key: r.definition for r in cache.look_up(spark.createDataFrame([(k,) for k in keys], "key string"), path).collect()}


def test_a_key_is_asked_once_over_all_runs(spark, tmp_path):
    from tests.test_flows import counting

    asked = lambda: len(os.listdir(tmp_path / "asked"))
    define = counting(tmp_path / "asked", lambda p: "" if "'blank'" in p else "def " + re.search(r"Triplet: \['(.*?)', '(.*?)'", p)[2])
    relations = spark.createDataFrame([("r", 0, "d")], "relation string, rel_idx int, def string")

    def run(names):
        g = spark.createDataFrame([(i, f"s{i}", "a", n, "b") for i, n in enumerate(names)], KG)
        out = align.aligned(g, relations, define, lambda: FunctionCompleter(lambda p: "A"), LetterCounts, mode="cached", cache=f"{tmp_path}/cache")
        return {r.predicate: (r.predicate_definition, r.definition_call is not None) for r in out.collect()}

    assert run(["p", "q", "P", "blank"]) == {"p": ("def p", True), "P": ("def p", True), "q": ("def q", True), "blank": ("", True)}
    assert asked() == 3
    assert run(["q", "new", "p", "blank"]) == {"p": ("def p", False), "q": ("def q", False), "new": ("def new", True), "blank": ("", True)}
    assert asked() == 5  # the blank answer is asked for again
    assert run(["new", "p"]) == {"p": ("def p", False), "new": ("def new", False)} and asked() == 5


def test_two_writers_segments_and_merging(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert held(spark, path, "a") == {} and cache.segments(path) == []
    first = cache.added(spark.createDataFrame([("a", "one"), ("b", " "), (None, "x")], SCHEMA), path)
    cache.added(spark.createDataFrame([("a", "two"), ("c", "three")], SCHEMA), path)
    # A writer that failed: no _SUCCESS.
    lost = cache.added(spark.createDataFrame([("d", "lost")], SCHEMA), path)
    os.remove(tmp_path / "cache" / lost / "_SUCCESS")
    want = {"a": "one", "c": "three"}
    assert held(spark, path, "a", "b", "c", "d", None) == want
    one = cache.merged(spark, path)
    # Begun before the merge was seen, added after it.
    cache.added(spark.createDataFrame([("a", "late"), ("e", "five")], SCHEMA), path)
    assert cache.segments(path)[0] == one and len(cache.segments(path)) == 2 and first not in cache.segments(path)
    assert held(spark, path, "a", "b", "c", "d", "e") == want | {"e": "five"}
    assert cache.merged(spark, path, least=3) is None


def test_few_keys_read_few_buckets(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/cache"
    cache.added(spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("d"), "id").alias("definition")), path)
    keys = spark.range(4990, 5010).select(F.concat(F.lit("k"), "id").alias("key"))
    plan = cache.look_up(keys.limit(1), path)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(key" in plan or "In(key" in plan
    want = {f"k{i}": f"d{i}" for i in range(4990, 5000)}
    for few in (cache.FEW, 3):
        monkeypatch.setattr(cache, "FEW", few)
        assert {r.key: r.definition for r in cache.look_up(keys, path).collect()} == want
