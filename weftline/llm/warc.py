"""A deterministic sharded WARC writer, and a reader that verifies what it reads.

Records are range-sorted by page id into shards whose borders follow from the data alone, written as one gzip
member each into files that roll by compressed size. Tasks write under temporary names and return manifest rows;
only the rows of successful attempts are kept, their files are renamed, and the manifest is written last. What a
lost or repeated attempt left behind is never referred to, and goes with the temporary folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import scratch_dir, small_batches, written

#: Payload bytes of a shard at least; with more than MOST_SHARDS such shards they become larger.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 20_000
#: A file is closed when it holds this many compressed bytes.
ROLL_BYTES = 256 << 20
#: Ranges of page ids that the shards' borders are taken from, and parts that a range with more than a shard's bytes is cut into, again and again.
RANGES, PARTS = 20_000, 64
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "shard long, seq long, temporary string, path string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, path string, at long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{nth}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member without a time stamp."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, nth: int, refers_to: tuple[int | None, str] | None) -> bytes:
    """A response, or with refers_to (page id, record id) a revisit of it."""
    uri = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{page_id}"
    headers = [("WARC-Record-ID", record_id(page_id, digest, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    headers += [("WARC-X-Page-Id", str(page_id))] if page_id is not None else []
    headers += [("WARC-X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to[1])]
    headers += [("WARC-X-Refers-To-Page-Id", str(refers_to[0]))] if refers_to[0] is not None else []
    return record("revisit", headers, http)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """Writes one task's files under temporary names."""

    def __init__(self, folder: str, roll: int) -> None:
        self.fs, self.folder = filesystem(folder)
        self.roll, self.attempt = roll, uuid.uuid4().hex
        self.file, self.done, self.shard, self.seq = None, [], -1, 0

    def open(self, shard: int) -> None:
        self.seq = self.seq + 1 if shard == self.shard else 0
        self.shard = shard
        self.name = f"pages-{shard:07d}-{self.seq:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{self.attempt}"
        self.file = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.size, self.records, self.sha = 0, 0, hashlib.sha1()
        self.put(record("warcinfo", [("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.done.append({"shard": self.shard, "seq": self.seq, "temporary": self.temporary, "path": self.name, "records": self.records, "bytes": self.size, "sha1": self.sha.hexdigest()})
            self.file = None

    def add(self, shard: int, data: bytes) -> None:
        if self.file and (shard != self.shard or self.size >= self.roll):
            self.close()
        if not self.file:
            self.open(shard)
        self.put(data)


def _writer(folder: str, roll: int, least: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Shard(folder, roll)
        at: tuple | None = None
        marks: dict[str, int | None] = {}
        times: dict[str, int] = {}
        for batch in batches:
            for shard, page_id, kind, url, payload, top, sha in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if at != (shard, page_id):
                    at, marks, times = (shard, page_id), {}, {}
                if kind == 0:
                    marks[sha] = top
                    continue
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                nth = times.get(sha, 0)
                times[sha] = nth + 1
                refers = None
                if sha in marks and len(payload) >= least and (nth or marks[sha] != page_id):
                    refers = (marks[sha], record_id(marks[sha], digest))
                out.add(shard, page_record(page_id, url, payload, digest, nth, refers))
        out.close()
        for i in range(0, len(out.done), 1000):
            part = out.done[i : i + 1000]
            yield pa.RecordBatch.from_pylist(part, schema=_schema(MANIFEST))

    return run


def _schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of plain columns."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def _longs(values: list[int]) -> F.Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def range_of(page_id: F.Column, starts: list[int]) -> F.Column:
    """The number of the range that an id is in, by bisection: the last of the sorted starts that is not over it."""
    steps = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    known = _longs(starts)
    step = lambda at, n: F.when(F.coalesce(F.try_element_at(known, at + n + 1) <= page_id, F.lit(False)), at + n).otherwise(at)
    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), step)


def shard_of(digests: DataFrame) -> tuple[int, F.Column]:
    """How many shards the rows (page_id, size, sha) make, and a row's shard.

    Ids are cut into at most RANGES equal ranges, those with more than a shard's bytes into PARTS again, until they
    are small or one id; so a few far ids do not put the rest into one range. Exact byte sums of the ranges, taken in order,
    make the shards, so equal tables have equal shards. Null ids come first; they, and the rows of one id that
    are more than a shard's bytes, are dealt by their digest. The driver sees one number for each range.
    """
    low, high, total, none = digests.agg(F.min("page_id"), F.max("page_id"), F.sum("size"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    each = max(SHARD_BYTES, (total or 0) // MOST_SHARDS + 1)
    parts = lambda n: max(1, -(-n // each))
    nulls = 0 if none is None else parts(none)
    dealt = lambda n: F.pmod(F.xxhash64("sha"), n).cast("int")
    if low is None:
        return max(1, nulls), dealt(F.lit(max(1, nulls)))
    ids = digests.filter(F.col("page_id").isNotNull())
    width = (high - low) // RANGES + 1
    starts = list(range(low, high + 1, width))
    while True:
        sums = dict(ids.groupBy(range_of(F.col("page_id"), starts).alias("r")).agg(F.sum("size")).collect())
        ends = [*starts[1:], high + 1]
        cut: list[int] = []
        for r, (start, end) in enumerate(zip(starts, ends, strict=True)):
            cut += range(start, end, max(1, -(-(end - start) // PARTS))) if sums.get(r, 0) > each else [start]
        if len(cut) == len(starts):
            break
        starts = cut
    shard, held, first, many = nulls, 0, [], []
    for r in range(len(starts)):
        n = sums.get(r, 0)
        if held and held + n > each:
            shard, held = shard + 1, 0
        first.append(shard)
        many.append(parts(n))
        held += n
        if many[-1] > 1:
            shard, held = shard + many[-1], 0
    number = range_of(F.col("page_id"), starts) + 1
    own = F.element_at(_longs(first), number).cast("int") + dealt(F.element_at(_longs(many), number).cast("int"))
    return shard + (held > 0 or shard == 0), F.when(F.col("page_id").isNull(), dealt(F.lit(max(1, nulls)))).otherwise(own)


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write a WARC record for each row and return the committed manifest (columns of MANIFEST, path relative to `folder`).

    Payloads are the html in UTF-8, null as empty. Of records with equal payloads (by SHA-1) of at least least_bytes,
    the one with the largest page id is a response, of rows that share even that the first by url; the others are
    revisits of it. A null page id sorts first and is a response only if no equal payload has an id. An empty table
    gives an empty manifest. Payloads are shuffled once, to their shard; copies are found on digests alone.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{scratch_dir(spark)}/weftline/warc-{uuid.uuid4().hex}"
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)
    given = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = given.select("page_id", "url", "payload", F.sha1("payload").alias("sha"))
    digests = written(rows.select("page_id", F.length("payload").cast("long").alias("size"), "sha"))
    shards, shard = shard_of(digests)
    digests = digests.drop("size")
    copies = digests.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha", "top")
    marks = digests.join(copies, "sha").distinct()
    both = marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "top", "sha").union(rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("top"), "sha"))
    dealt = both.select(shard.cast("int").alias("shard"), "*").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "sha")
    found = written(dealt.select("shard", "page_id", "kind", "url", "payload", "top", "sha").mapInArrow(_writer(folder, roll_bytes, least_bytes), MANIFEST))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{top}/{r['path']}").size != r["bytes"]:  # done before, if a task is repeated
                    fs.move(f"{top}/{r['temporary']}", f"{top}/{r['path']}")
            yield batch

    renamed = found.mapInArrow(rename, MANIFEST)
    renamed.write.parquet(f"{folder}/_manifest")
    fs.delete_dir(f"{path}/_temporary")
    return spark.read.parquet(f"{folder}/_manifest").withColumn("folder", F.lit(folder))


def members(read, most: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream; read(n) gives bytes."""
    z, start, at, parts, data = zlib.decompressobj(31), 0, 0, [], b""
    while True:
        if not data and not (data := read(most)):
            if parts or at > start:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(z.decompress(data))
        at += len(data) - len(z.unused_data)
        data = z.unused_data
        if z.eof:
            yield start, b"".join(parts)
            z, start, parts = zlib.decompressobj(31), at, []


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the block; digests are verified."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(rest) != len(block) + 4 or "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"a damaged record: {headers.get('warc-record-id')}")
    return headers, block


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The page records of committed archives (columns of RECORD). Each file is one task's stream; payload is null unless asked for, and for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(RECORD)
        for batch in batches:
            for r in batch.to_pylist():
                fs, top = filesystem(r["folder"])
                rows, held = [], 0
                with fs.open_input_stream(f"{top}/{r['path']}", compression=None) as f:
                    for at, content in members(f.read):
                        h, block = parsed(content)
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                        if payload is not None and base32_sha1(payload) != digest:
                            raise ValueError(f"a damaged payload: {h['warc-record-id']}")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        size = len(payload) if payload is not None else number("warc-x-payload-length")
                        rows.append({"page_id": number("warc-x-page-id"), "url": h["warc-target-uri"], "payload": payload if payloads else None, "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number("warc-x-refers-to-page-id"), "record_id": h["warc-record-id"], "path": r["path"], "at": at})
                        held += size if payloads else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("folder", "path")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, RECORD)


def roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages, **options)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
