"""Similarity joins of rows against a set of relations: exact top-k by cosine, and by a weighted sum of three cosines.

Relations are put in blocks of a checked size; each block is broadcast as one matrix, and a batch of rows is one
matrix product. More relations than a block make more passes, whose short lists are merged. No row of all pairs is
ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = "array<struct<score: double, rel_idx: long, relation: string, def: string, parts: array<double>>>"
#: Numbers in a block's matrix at most (8 bytes each).
BLOCK_NUMBERS = 4_000_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as float64 rows; null or wrongly sized vectors are zeros."""
    out = np.zeros((len(column), width))
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    if (sizes == width).all():
        return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width:
            out[i] = v
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero, so its cosine is 0."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _blocks(relations: DataFrame, columns: list[str]) -> Iterator[list]:
    block, numbers = [], 0
    definition = F.col("def") if "def" in relations.columns else F.lit(None).cast("string")
    for r in relations.select("rel_idx", "relation", definition.alias("def"), *columns).orderBy("rel_idx").toLocalIterator():
        size = sum(len(r[c] or ()) for c in columns) + len(r["def"] or "") // 8
        if block and numbers + size > BLOCK_NUMBERS:
            yield block
            block, numbers = [], 0
        block.append(r)
        numbers += size
    if block:
        yield block


def _scored(queries: DataFrame, block: list, parts: list[tuple[str, str, float]], k: int, last_first: bool, round_to: int | None) -> DataFrame:
    """Adds `found`, the block's best k as FOUND. parts: (row's vector, relation's vector, weight)."""
    sc = queries.sparkSession.sparkContext
    matrices = []
    for _, column, _ in parts:
        width = max((len(r[column]) for r in block if r[column] is not None), default=0)
        m = np.zeros((len(block), width))
        for i, r in enumerate(block):
            if r[column] is not None and len(r[column]) == width:
                m[i] = r[column]
        matrices.append(_unit(m))
    known = sc.broadcast((matrices, [r["rel_idx"] for r in block], [r["relation"] for r in block], [r["def"] for r in block]))
    schema = T.StructType([*queries.schema.fields, T.StructField("found", T._parse_datatype_string(FOUND))])
    names, weights = [p[0] for p in parts], [p[2] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        ms, idx, relations, defs = known.value
        for b in batches:
            each = [_unit(_matrix(b.column(b.schema.get_field_index(n)), m.shape[1])) @ m.T for n, m in zip(names, ms, strict=True)]
            total = sum(w * e for w, e in zip(weights, each, strict=True))
            if round_to is not None:
                scale = 10.0**round_to
                total = np.floor(total * scale + 0.5) / scale
            order = np.argsort(-total, axis=1, kind="stable") if not last_first else total.shape[1] - 1 - np.argsort(-total[:, ::-1], axis=1, kind="stable")
            rows = [[{"score": total[i, j], "rel_idx": idx[j], "relation": relations[j], "def": defs[j], "parts": [e[i, j] for e in each]} for j in order[i, :k].tolist()] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(b.columns, arrow, strict=False)], pa.array(rows, type=arrow.field("found").type)], schema=arrow)

    return queries.mapInArrow(run, schema)


def _best(queries: DataFrame, relations: DataFrame, parts: list[tuple[str, str, float]], k: int, last_first: bool, round_to: int | None) -> DataFrame:
    """Rows with `found` over all blocks; with several, each adds its list and the best k of both stay."""
    out = None
    for block in _blocks(relations, [p[1] for p in parts]):
        if out is None:
            out = _scored(queries, block, parts, k, last_first, round_to)
            continue
        both = _scored(out.withColumnRenamed("found", "__before"), block, parts, k, last_first, round_to)
        before = lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise((F.sign(y["rel_idx"] - x["rel_idx"]) if last_first else F.sign(x["rel_idx"] - y["rel_idx"])).cast("int"))
        out = both.withColumn("found", F.slice(F.array_sort(F.concat("__before", "found"), before), 1, k)).drop("__before")
    if out is None:
        return queries.withColumn("found", F.lit(None).cast(FOUND))
    return out


def top_k(queries: DataFrame, relations: DataFrame, vector: str, relation_vector: str, k: int) -> DataFrame:
    """queries with `found`: the k relations of highest cosine, of equal ones the later first. relations: rel_idx, relation, a vector,
    and def if there is one, which comes along.

    Null or zero vectors have cosine 0 with everything; without relations `found` is null.
    """
    return _best(queries, relations, [(vector, relation_vector, 1.0)], k, True, None)


def weighted_top_k(queries: DataFrame, relations: DataFrame, parts: list[tuple[str, str, float]], k: int = 5) -> DataFrame:
    """The same by a weighted sum of cosines, rounded to four places before sorting; of equal ones the earlier first."""
    return _best(queries, relations, parts, k, False, 4)


def candidates_column() -> F.Column:
    """`found` of three parts as the named scores of a retrieved candidate, each rounded to four places."""
    return F.transform("found", lambda c: F.struct(c["relation"].alias("relation"), F.round(c["score"], 4).alias("score"), *[F.round(c["parts"][i], 4).alias(n) for i, n in enumerate(("pred_name_score", "pred_def_score", "triplet_def_score"))]))


def top_candidates_column() -> F.Column:
    """`found` as (relation, similarity), rounded to four places."""
    return F.transform("found", lambda c: F.struct(c["relation"].alias("relation"), F.round(c["score"], 4).alias("similarity")))
