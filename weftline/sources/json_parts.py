"""Large JSON files, arrays or objects, read and written in parts.

Reading. Spark's text reader splits files at `}`, whatever their layout. Whether a split begins inside a text, and inside which
brackets, follows from the splits before it: each reports its quotes' parity, and the brackets it leaves open and
closes, for both beginnings. These reports, one row a split, are put together by file. Then every split knows where it begins and
gives the records that begin in it; of a record over a border the pieces are joined.

Writing. Rows are sorted by ranges, each range is a file of the array's items in order, and a manifest names the files of a
commit; `joined_file` puts the bytes in one file, a piece at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.runtime import materialised

_TOKEN = re.compile(r'["\[\]{}]|\\.', re.DOTALL)
#: Rows of a file at most: positions are the file's place among the sorted paths times this, plus the row's place.
FILE_ROWS = 1 << 40
#: Rows of a batch that leaves a task.
ROWS = 5000


class Nesting:
    """The brackets that a text closes before it and leaves open, and whether a string literal is open."""

    def __init__(self, inside: bool = False) -> None:
        self.inside, self.closed, self.open = inside, 0, ""

    def bracket(self, c: str) -> None:
        if c in "[{":
            self.open += c
        elif self.open:
            self.open = self.open[:-1]
        else:
            self.closed += 1


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, text) of the text before each `}`; those of one split of a file come together and in order."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The rows of each split, by its key; each group has to be read to its end."""
    from itertools import groupby

    rows = ((p, b, t) for batch in batches for p, b, t in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in own)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether it has an odd number of quotes, and for a beginning outside (0) and inside (1) of a string the brackets closed and left open."""
    for (path, block), texts in _by_split(batches):
        odd, found = False, (Nesting(), Nesting())
        for text in texts:
            for m in _TOKEN.finditer(text):
                c = m[0]
                if c == '"':
                    odd = not odd
                elif len(c) == 1:
                    found[odd].bracket(c)
            found[odd].bracket("}")
        row = {"path": path, "block": block, "odd": odd, **{f"{n}{k}": getattr(found[k], n) for k in (0, 1) for n in ("closed", "open")}}
        yield pa.RecordBatch.from_pylist([row])


def _starts(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a file's reports: what each split begins in. The end of a file counts as one `}` more, which may close nothing."""
    inside, stack, out = False, "", []
    rows = frame.sort_values("block").to_dict("records")
    for i, r in enumerate(rows):
        out.append((r["path"], r["block"], inside, stack))
        closed, opened = r[f"closed{int(inside)}"], r[f"open{int(inside)}"]
        if closed > len(stack) and not (i == len(rows) - 1 and closed == len(stack) + 1 and not opened):
            raise ValueError(f"broken JSON: {r['path']}")
        stack = stack[: max(0, len(stack) - closed)] + opened
        inside ^= r["odd"]
    if inside or stack:
        raise ValueError(f"broken JSON: {frame['path'].iloc[0]}")
    return pd.DataFrame(out, columns=["path", "block", "inside", "stack"])


def _level(stack: str) -> int:
    """How many brackets are around a record that `stack` is in or just opens, 0 for none: items of an array, values of an object, and items of its array values."""
    if stack[1:2] == "{":
        return 1
    return 2 if stack[:3] == "{[{" else 0


def _wanted(stack: str, record: object, mode: str) -> bool:
    """Whether a record under these brackets is a row: see `files.read_graph`."""
    if stack == "[":
        return True
    if mode == "values":
        return stack == "{"
    return "def" not in record or (mode == "list_items" and stack == "{[")


def _pieces(text: str, state: Nesting) -> Iterator[tuple[str, str, str]]:
    """(what, brackets around, text) of a text with its `}`: 'whole' records, the 'head' of one that is open before, the 'tail' of one left open."""
    level = _level(state.open)
    at = 0 if level else None
    begun = False
    whole = text + "}"
    for m in _TOKEN.finditer(whole):
        c = m[0]
        if c == '"':
            state.inside = not state.inside
        elif len(c) == 1 and not state.inside:
            state.bracket(c)
            if at is None and c == "{" and (level := _level(state.open)) and level == len(state.open) - 1:
                at, begun = m.start(), True
            elif at is not None and len(state.open) == level:
                yield ("whole" if begun else "head"), state.open, whole[at : m.end()]
                at, begun = None, False
    if at is not None:
        yield ("tail" if begun else "through"), state.open[:level], whole[at:]


def records(spark: SparkSession, path: str, schema: T.StructType, row: Callable[[dict], dict], mode: str) -> DataFrame:
    """Rows of `schema` (its first column: pos) of the JSON files' records, in the order of sorted paths and of each file. row gives a record's other columns.

    One row a split of the input reaches the driver, as its list of files does. A broken file fails with a message.
    """
    splits = _splits(spark, path)
    report = splits.mapInArrow(_reports, "path string, block long, odd boolean, closed0 long, open0 string, closed1 long, open1 string")
    starts = report.groupBy("path").applyInPandas(_starts, "path string, block long, inside boolean, stack string").collect()
    begins = spark.sparkContext.broadcast({(r.path, r.block): (r.inside, r.stack) for r in starts})
    inner = T.StructType([T.StructField("path", T.StringType()), T.StructField("block", T.LongType()), T.StructField("around", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("piece", T.StringType()), *schema.fields])

    def parsed(text: str, around: str) -> list[dict]:
        record = json.loads(text)
        return [row(record)] if _wanted(around, record, mode) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out = to_arrow_schema(inner), []
        for (path, block), texts in _by_split(batches):
            state = Nesting()
            state.inside, state.open = begins.value[path, block]
            given = {"path": path, "block": block}
            n, held, part = 0, [], 0
            for text in texts:
                for what, around, piece in _pieces(text, state):
                    if what in ("through", "head"):
                        held.append(piece)
                        if what == "through":
                            continue
                        piece = "".join(held)
                        held = []
                        if part == 0:  # begun in a split before
                            out.append(given | {"around": around, "part": 0, "piece": piece})
                            part = 1
                            continue
                    elif what == "tail":
                        held, part = [piece], 1
                        continue
                    part = 1
                    for r in parsed(piece, around):
                        out.append(given | {"pos": n} | r)
                        n += 1
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if held:
                out.append(given | {"around": state.open[: _level(state.open)], "part": part, "piece": "".join(held)})
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = materialised(splits.mapInArrow(run, inner))
    # Pieces of a record go to the split that it begins in, the last with one of part 1.
    order = Window.partitionBy("path").orderBy("block", "part")
    owner = F.last(F.when(F.col("part") == 1, F.col("block")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = found.filter("piece is not null").withColumn("owner", owner).groupBy("path", "owner")
    over = pieces.agg(F.max("around").alias("around"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "piece"))), lambda x: x["piece"]), "").alias("piece"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = [{"path": p, "block": b, "pos": None} | r for p, b, around, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in parsed(text, around)]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(T.StructType([*inner.fields[:2], *schema.fields])))

    last = materialised(over.select("path", "owner", "around", "piece").mapInArrow(finish, T.StructType([*inner.fields[:2], *schema.fields])))
    whole = found.filter("piece is null").select(*last.columns)
    n = whole.groupBy("path", "block").agg(F.count("*").alias("n")).join(last.select("path", "block", F.lit(1).alias("more")), ["path", "block"], "full")
    ahead = F.sum(F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    files = {p: i for i, p in enumerate(sorted({r.path for r in starts}))}
    first = spark.createDataFrame([(p, i * FILE_ROWS) for p, i in files.items()], "path string, first long")
    # One row a split: as small as the list of splits.
    before = n.select("path", "block", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(ahead, F.lit(0)).alias("ahead")).join(F.broadcast(first), "path")
    every = whole.unionByName(last).join(F.broadcast(materialised(before)), ["path", "block"])
    pos = (F.col("first") + F.col("ahead") + F.coalesce("pos", "n")).alias("pos")
    return every.select(pos, *[F.col(f"`{f.name}`") for f in schema.fields[1:]])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_array(rows: DataFrame, path: str, order: list[str], indent: int = 2, key: str | None = None, value: str | None = None, columns: tuple[str, ...] | None = None) -> list[str]:
    """Rows (their `columns`, or all) as one JSON array in order, or with `key` and `value` (a column of JSON) as one object; returns the parts' paths, whose bytes make the whole.

    Each range of rows is written by one task to a file of a name of its own; only files that the tasks' results name belong to
    the array, so a repeated task leaves one file too many that nothing refers to. The manifest, `<path>/_parts.json`, is written last.
    `path` is a folder that driver and executors share; files that an earlier manifest named are left to it. Null fields are left out, as in Spark's JSON.
    """
    body = F.col(value) if value else F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns or rows.columns]))
    given = rows.select(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], (F.col(key) if key else F.lit(None)).cast("string").alias("k"), body.alias("body"))
    names = [f"o{i}" for i in range(len(order))]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written, so that the ranges are those of one run however often a task repeats.
    placed = materialised(given.repartitionByRange(parts, *names).withColumn("part", F.spark_partition_id()))
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at, out, name = [], None, None, None
        for batch in batches:
            for part, k, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part != at:
                    if out is not None:
                        out.close()
                    at, name = part, f"{path}/part-{part:06d}-{run_id}-{uuid.uuid4().hex[:8]}.json"
                    system, place = _filesystem(name)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(place)
                    found.append((part, name))
                    separator = ""
                item = json.dumps(json.loads(text), indent=indent, ensure_ascii=False).replace("\n", "\n" + " " * indent)
                head = " " * indent + (f"{json.dumps(k, ensure_ascii=False)}: " if key else "")
                out.write((separator + head + item).encode())
                separator = ",\n"
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([n for _, n in found], pa.string())], names=["part", "name"])

    written = placed.repartition(parts, "part").sortWithinPartitions("part", *names).select("part", "k", "body").mapInArrow(run, "part int, name string").collect()
    ends, empty = ("{", "}") if key else ("[", "]"), not written
    system, place = _filesystem(path)
    system.create_dir(place, recursive=True)

    def put(name: str, data: str) -> str:
        with system.open_output_stream(f"{place}/{name}") as f:
            f.write(data.encode())
        return f"{path}/{name}"

    paths = [put(f"begin-{run_id}.json", ends[0] + ("" if empty else "\n"))]
    for i, r in enumerate(sorted(written)):
        if i:
            paths.append(paths[0].replace("begin-", "comma-")) if i > 1 else paths.append(put(f"comma-{run_id}.json", ",\n"))
        paths.append(r.name)
    paths.append(put(f"end-{run_id}.json", ("" if empty else "\n") + ends[1]))
    put(f"_parts-{run_id}.json", json.dumps(paths))
    system.move(f"{place}/_parts-{run_id}.json", f"{place}/_parts.json")
    return paths


def parts_of(path: str) -> list[str]:
    """The paths of the parts of the array last written to a folder."""
    system, place = _filesystem(f"{path}/_parts.json")
    with system.open_input_stream(place) as f:
        return json.loads(f.read())


def joined_file(path: str, target: str, piece: int = 8 << 20) -> int:
    """Copies the parts to one file, a piece at a time, under a temporary name first; returns its bytes."""
    system, place = _filesystem(target)
    total, temporary = 0, f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        for name in parts_of(path):
            own, at = _filesystem(name)
            with own.open_input_stream(at) as f:
                while data := f.read(piece):
                    total += len(data)
                    out.write(data)
    system.move(temporary, place)
    return total
