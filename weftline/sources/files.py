"""File formats. All split but SRDEF tables and alias maps, which are small."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.merging import missing_columns
from weftline.schema import KG_OPEN, TRIPLE
from weftline.sources.json_parts import FILE_ROWS, records, write_array

SRDEF = "kind string, id string, name string, tree string, def string, f5 string, f6 string, f7 string, abbr string, inverse string, f10 string"


def _ranked(rows: DataFrame) -> DataFrame:
    """rows of files with __start, the first position of their file: paths are sorted, as partitions are packed by size."""
    paths = sorted(rows.inputFiles())
    ranks = rows.sparkSession.createDataFrame([(p, i * FILE_ROWS) for i, p in enumerate(paths)], "__path string, __start long")
    return rows.withColumn("__path", F.input_file_name()).join(F.broadcast(ranks), "__path").drop("__path")


def _positioned(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """pos and the columns of rows of unsplit files: the order of paths, and in a file that of its rows."""
    placed = rows.withColumn("__nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return _ranked(placed).select((F.col("__start") + F.col("__nth")).alias("pos"), *columns)


def read_srdef(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated semantic types and relations: pos, kind, name, def, inverse of lines with ten fields or more.

    pos orders lines within a file; broken bytes become U+FFFD.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("pos", "line"))
    parts = F.split("line", r"\|")
    return lines.filter(F.size(parts) >= 10).select(F.col("pos").cast("long"), parts[0].alias("kind"), parts[2].alias("name"), parts[4].alias("def"), parts[9].alias("inverse"))


def read_triples_csv(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object of a CSV file with a header; raises if one is missing. pos orders the rows, files by their paths."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if absent := missing_columns(rows, TRIPLE):
        raise ValueError(f"missing columns: {absent}")
    return _positioned(rows, TRIPLE)


def write_triples_json(rows: DataFrame, path: str) -> list[str]:
    """Triples in order as one indented JSON array, in parts under a folder; returns the parts."""
    return write_array(rows, path, ["pos"], columns=TRIPLE)


def _records(value: object, mode: str) -> Iterator[dict]:
    """A graph file's rows: a list is its items; of a dict's values lists give their items and dicts themselves.

    list_items (V1, V2): dicts with a `def` are left out only as values. strict (final): everywhere. values: a dict's values as they are.
    """
    if isinstance(value, list):
        yield from (x for x in value if isinstance(x, dict))
    elif isinstance(value, dict):
        for v in value.values():
            if mode == "values":
                if isinstance(v, dict):
                    yield v
            elif isinstance(v, list):
                yield from (x for x in v if isinstance(x, dict) and (mode == "list_items" or "def" not in x))
            elif isinstance(v, dict) and "def" not in v:
                yield v


def read_graph(spark: SparkSession, path: str, mode: str = "strict", extra: str = "") -> DataFrame:
    """pos, sentence, subject, predicate, object and the `extra` columns (DDL) of graph files in JSON; missing fields are empty texts, extras null."""
    if mode not in ("list_items", "strict", "values"):
        raise ValueError("mode is list_items, strict or values")
    schema = T._parse_datatype_string(KG_OPEN + (f", {extra}" if extra else ""))
    names = [f.name for f in schema.fields[1:]]
    return records(spark, path, schema, lambda r: {n: r.get(n, "" if k < 4 else None) for k, n in enumerate(names)}, mode)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log: blank and broken lines are left out, a missing path is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; a task's lines appear when it commits."""
    rows.write.mode("append").json(path)


def write_json_array(rows: DataFrame, path: str, order: list[str], indent: int = 2, columns: tuple[str, ...] | None = None) -> list[str]:
    """Rows in order as one indented JSON array, in parts under a folder (see `json_parts.write_array`); returns the parts. `json_parts.joined_file` makes one file of them."""
    return write_array(rows, path, order, indent, columns=columns)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(term, target) of a JSON object of strings. Pickled maps are not read: unpickling runs code."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("term", "target"))


def read_terms(spark: SparkSession, path: str, column: str = "term", lowercase: bool = False) -> DataFrame:
    """(pos, term) of a CSV term list: trimmed, blank ones left out, order and repetitions kept. Raises if the column is missing."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if missing_columns(rows, (column,)):
        raise ValueError(f"missing column: {column}")
    term = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    out = _positioned(rows.select((F.lower(term) if lowercase else term).alias("term")), ("term",))
    return out.filter("term is not null and term != ''")


def read_lexicon(spark: SparkSession, index: str, exceptions: str) -> tuple[DataFrame, DataFrame]:
    """The tables (lexicon, exceptions) of `lemmas.lemmas` from a word index (a word, its class and more on each line; lines that begin with a space are notes) and a list of irregular forms (a form and its lemmas on each line)."""
    words = spark.read.text(index).filter(~F.col("value").startswith(" ")).select(F.split("value", " ")[0].alias("word")).filter("word != ''")
    each = spark.read.text(exceptions).select(F.split(F.trim("value"), " +").alias("w")).filter("size(w) > 1")
    return words, each.select(F.col("w")[0].alias("word"), F.posexplode(F.slice("w", F.lit(2), F.size("w") - 1)).alias("pos", "lemma"))


def read_terms_excel(spark: SparkSession, path: str, column: str = "term", lowercase: bool = False) -> DataFrame:
    """The same of an Excel sheet on the driver. Needs openpyxl."""
    import pandas as pd

    frame = pd.read_excel(path)
    if column not in frame.columns:
        raise ValueError(f"missing column: {column}")
    terms = [str(t).strip() for t in frame[column].dropna()]
    return spark.createDataFrame([(i, t.lower() if lowercase else t) for i, t in enumerate(terms) if t], "pos long, term string")


def distinct_terms(terms: DataFrame) -> DataFrame:
    return terms.select(F.lower(F.trim("term")).alias("term")).distinct()


def layout(output: str) -> dict[str, str]:
    """The folders that belong to an output: results, the logs of both model phases, the checkpoint, the schema, clusters and labels."""
    stem = output.removesuffix(".json")
    return {"result": output, **{k: f"{stem}.{k}.jsonl" for k in ("phase2", "phase3", "checkpoint", "cluster_labels")}, **{k: f"{stem}.{k}.json" for k in ("schema", "clusters")}}


def write_run(output: str, **tables: DataFrame) -> dict[str, str]:
    """Writes what a run made to the places of `layout`, by its names (result, phase2, phase3, checkpoint, schema, clusters, cluster_labels), as JSON lines; returns the paths written."""
    places = layout(output)
    if unknown := set(tables) - set(places):
        raise ValueError(f"not a part of a run: {sorted(unknown)}")
    for name, rows in tables.items():
        rows.write.mode("append" if places[name].endswith(".jsonl") else "overwrite").json(places[name])
    return {name: places[name] for name in tables}


def call_log(rows: DataFrame, call: str, phase: int, model: str, max_tokens: int, prompt: str | None = None) -> DataFrame:
    """The log of a model phase from rows with a `call` struct: ids, fields, prompt, model, time, answer, usage, error, attempts. Rows that were not asked are left out."""
    asked = F.lit(None).cast("string") if prompt is None else F.col(prompt)
    return rows.filter(F.col(call).isNotNull()).select(
        "triplet_id", F.lit(phase).alias("phase"), "predicate", "sentence", "subject", "object", asked.alias("prompt"), F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"),
        F.current_timestamp().alias("called_at"), F.col(f"{call}.text").alias("response"), *[F.col(f"{call}.{f}").alias(f) for f in rows.schema[call].dataType.fieldNames() if f != "text"],
    )
