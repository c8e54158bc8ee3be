"""Definitions that outlive a run: a table of segments, asked before a model is.

A segment is what one run added: Parquet with Bloom filters on the keys, dealt to buckets by key. It counts once its `_SUCCESS` is
there, so a run that fails adds nothing. Segments are never changed: of a key that several hold, the first one by name (the time at which
it was begun) counts for all readers. `merged` writes one segment in place of many; what it replaces is in a list beside the segments that
takes effect with the new one's `_SUCCESS`.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.json_parts import _filesystem

BUCKETS = 16
#: Up to this many keys are looked up as a list, which Bloom filters and buckets answer; more are joined.
FEW = 2000
SCHEMA = "key string, definition string, bucket int"


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


def segments(path: str) -> list[str]:
    """The names of the segments that count, the first first."""
    from pyarrow import fs

    system, place = _filesystem(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return []
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(place)) if i.base_name.startswith("segment-")]
    done = [n for n in names if system.get_file_info(f"{place}/{n}/_SUCCESS").type == fs.FileType.File]
    gone: set[str] = set()
    for n in done:
        if system.get_file_info(f"{place}/replaces-{n}.json").type == fs.FileType.File:
            with system.open_input_stream(f"{place}/replaces-{n}.json") as f:
                gone |= set(json.loads(f.read()))
    return sorted(set(done) - gone)


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame | None:
    found = None
    for n in names:
        own = spark.read.schema(SCHEMA).parquet(f"{path}/{n}").withColumn("segment", F.lit(n))
        found = own if found is None else found.unionByName(own)
    return found


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min_by("definition", "segment").alias("definition"))


def look_up(keys: DataFrame, path: str) -> DataFrame:
    """(key, definition) of the keys (key) that the cache holds. Of up to FEW keys only the buckets and row groups that may hold them are read."""
    spark = keys.sparkSession
    rows = _rows(spark, path, segments(path))
    if rows is None:
        return spark.createDataFrame([], "key string, definition string")
    wanted = keys.select("key").filter("key is not null").distinct()
    some = wanted.select("key", _bucket().alias("bucket")).limit(FEW + 1).collect()
    if len(some) <= FEW:
        return _first(rows.filter(F.col("bucket").isin(sorted({r.bucket for r in some})) & F.col("key").isin([r.key for r in some])))
    return _first(rows.join(wanted, "key", "left_semi"))


def _written(rows: DataFrame, path: str, name: str) -> None:
    dealt = rows.select("key", "definition", _bucket().alias("bucket")).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "key")
    dealt.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/{name}")


def _name() -> str:
    return f"segment-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def added(rows: DataFrame, path: str) -> str:
    """Adds the rows (key, definition) as a segment; blank definitions are left out. Returns its name. Two runs at one time may both add a key; later readers all see the first."""
    name = _name()
    _written(rows.filter(F.col("key").isNotNull() & (F.trim("definition") != "")).groupBy("key").agg(F.min("definition").alias("definition")), path, name)
    return name


def merged(spark: SparkSession, path: str, least: int = 2) -> str | None:
    """One segment in place of the present ones, if there are `least` or more; its name. It takes the first one's place in order, so segments added meanwhile come after it."""
    names = segments(path)
    if len(names) < max(least, 1):
        return None
    system, place = _filesystem(path)
    name = f"{'-'.join(names[0].split('-')[:2])}-{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(f"{place}/replaces-{name}.json") as f:
        f.write(json.dumps(names).encode())
    _written(_first(_rows(spark, path, names)), path, name)
    return name
