"""What the text operators share: shared scratch folders, Arrow passes over texts, vectorised words and hashes."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.runtime import scratch_dir

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weftline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES instead of Spark's 64 MB, unless the session names a size of its own: long texts then need no large buffers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b", "64MB"):
        spark.conf.set(name, f"{BATCH_BYTES}b")


#: What a worker process keeps between tasks, by operator: functions that drop it.
_kept: dict[str, Callable[[], None]] = {}
_state: dict[str, str | None] = {"task": None}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Says that this process keeps something for `owner` between tasks, to be dropped when another operator's task comes."""
    _kept[owner] = drop


def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps its own habits
        return None


@contextlib.contextmanager
def task(owner: str) -> Iterator[None]:
    """A Python worker's task: drops what other operators kept, and gives freed memory back at the end.

    Workers live on from stage to stage, so what one leaves behind would lessen what the next may use.
    """
    if _state["task"] is None:
        pa.set_memory_pool(pa.system_memory_pool())
        if libc := _libc():
            libc.mallopt(-3, 1 << 18)  # large arrays are mapped, and unmapped when freed
            libc.mallopt(-8, 2)
    if _state["task"] != owner:
        for name in [k for k in _kept if k != owner]:
            _kept.pop(name)()
        _state["task"] = owner
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if libc := _libc():
            libc.malloc_trim(0)


def steps(sizes: list[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about `most` bytes."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def map_texts(df: DataFrame, text: str, carry: list[str], out: str | T.StructType, make: Callable[[], Callable[[list[bytes | None]], dict[str, object]]]) -> DataFrame:
    """One output row for each row of df: the carried columns, and what make()(texts) returns by column name.

    Texts reach Python as UTF-8 bytes (null: None). make() runs once a task; its function gets some rows' texts
    at a time. A carried column whose name is also an output column is left out.
    """
    from pyspark.sql import functions as F

    small_batches(df.sparkSession)
    added = out if isinstance(out, T.StructType) else T._parse_datatype_string(out)
    carry = [c for c in carry if c not in added.fieldNames()]
    given = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], *added.fields])
    k = len(carry)

    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        with task(owner):
            work = make()
            for batch in batches:
                texts = batch.column(k).to_pylist()
                for lo, hi in steps([len(t or b"") for t in texts]):
                    got = work(texts[lo:hi])
                    own = [pa.array(got[f.name], type=arrow.field(k + i).type, from_pandas=False) for i, f in enumerate(added.fields)]
                    held = [batch.column(i).slice(lo, hi - lo) for i in range(k)]
                    yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(held)] + own, schema=arrow)

    return given.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of a well-known public generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        x = np.full(max(n, STEP_BYTES + 4096), base, dtype=np.uint64)
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name][:n]


class Words:
    """The words of some texts, vectorised: byte ranges, text number and a 64-bit hash of each.

    `table` (256 bytes) maps each byte of a text, separators to a space. Words that are equal as bytes have equal
    hashes; unequal words have equal hashes with probability of about 2^-64.
    """

    def __init__(self, texts: list[bytes | None], table: bytes) -> None:
        parts = [(t or b"").translate(table) for t in texts]
        self.buffer = b" ".join(parts) + b" "
        a = np.frombuffer(self.buffer, dtype=np.uint8)
        solid = a != 32
        edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        at = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        #: Words of text i are those from first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, at)
        self.text = np.repeat(np.arange(len(parts)), np.diff(self.first))
        if len(self.starts):
            x = (a.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", len(a))
            x[~solid] = 0
            self.hashes = mixed(np.add.reduceat(x, self.starts) * _power(_INVERSE, "down", len(a))[self.starts])
        else:
            self.hashes = np.zeros(0, dtype=np.uint64)

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word sequences that start at each word, and which of them lie in one text."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        total = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            total = total * np.uint64(_BASE) + self.hashes[j : j + m]
        return mixed(total), self.text[:m] == self.text[n - 1 :]


def byte_table(separators: bytes, lower: bool) -> bytes:
    x = bytearray(range(256))
    if lower:
        x[65:91] = bytes(range(97, 123))
    for b in separators:
        x[b] = 32
    return bytes(x)


#: The white space of `[^\\x20\\x09-\\x0D]+`.
SPACES = b" \t\n\x0b\x0c\r"
