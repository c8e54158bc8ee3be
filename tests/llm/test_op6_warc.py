import base64
import gzip
import hashlib
import os

import pytest

from weftline.llm import warc

ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", "é漢" * 50), (5, None, None), (4, "http://a/4\r\nX: y", ""), (9, "http://b", "x" * 3000), (9, "http://a", "x" * 3000), (9, "http://b", "x" * 3000), (None, "http://n", "only null"), (None, "http://n2", "same")]
SCHEMA = "page_id long, url string, html string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def folder(tmp_path, name="w"):
    return f"file://{tmp_path}/{name}"


def test_round_trip(spark, tmp_path):
    got = warc.read(warc.write(spark.createDataFrame(ROWS, SCHEMA), folder(tmp_path)), payloads=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        full = [(h or "").encode() for i, _, h in ROWS if i == r.page_id]
        assert r.payload_digest in {digest(p) for p in full} and r.payload_bytes in {len(p) for p in full}
        assert r.payload is None if r.record_type == "revisit" else r.payload in full
    by = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert by == sorted([(0, "response", None), (0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "revisit", 5), (5, "response", None), (9, "response", None), (9, "revisit", 9), (9, "revisit", 9)])


def test_small_payloads_are_never_revisits(spark, tmp_path):
    got = warc.read(warc.write(spark.createDataFrame(ROWS, SCHEMA), folder(tmp_path), least_bytes=5)).collect()
    assert sorted(r.page_id for r in got if r.record_type == "revisit") == [9, 9]


def test_files_are_equal_run_by_run_and_gzip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 4000)
    rows = [(i, f"http://h/{i}", f"page {i} " * 40) for i in range(100)]
    seen = []
    for k in range(2):
        m = warc.write(spark.createDataFrame(rows[:: 1 - 2 * k], SCHEMA).repartition(1 + 3 * k), folder(tmp_path, f"w{k}"), roll_bytes=700).orderBy("path").collect()
        seen.append([(r.path, r.bytes, r.sha1, r.records) for r in m])
        on_disk = sorted(f for f in os.listdir(f"{tmp_path}/w{k}") if f.endswith(".gz"))
        assert on_disk == [r.path for r in m] and not os.path.exists(f"{tmp_path}/w{k}/_temporary")
    assert seen[0] == seen[1] and len(seen[0]) > 8
    assert max(r[1] for r in seen[0]) < 1500 and {int(r[0].split("-")[1]) for r in seen[0]} == set(range(len({r[0].split("-")[1] for r in seen[0]})))
    text = gzip.open(f"{tmp_path}/w0/{seen[0][0][0]}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
    records = warc.read(spark.read.parquet(f"{tmp_path}/w0/_manifest").selectExpr("*", f"'file://{tmp_path}/w0' AS folder")).collect()
    order = [r.page_id for r in sorted(records, key=lambda r: (r.path, r.at))]
    assert order == list(range(100))


def test_far_ids_and_many_of_one_id_do_not_fill_one_shard(spark, tmp_path, monkeypatch):
    """One id far from the rest, very many null ids and very many rows of one id: shards stay near their size, and in the order of ids."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 4000)
    rows = [(i, f"http://h/{i}", f"page {i} " * 40) for i in range(200)] + [(1 << 40, "http://far/", "far"), (-(1 << 62), None, "first"), ((1 << 63) - 1, None, "last")]
    rows += [(None, f"http://n/{i}", f"no id {i} " * 40) for i in range(60)] + [(77, f"http://s/{i}", f"same id {i} " * 40) for i in range(60)]
    m = warc.write(spark.createDataFrame(rows, SCHEMA), folder(tmp_path))
    got = warc.read(m).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got) == sorted((i is None, i or 0, len(t)) for i, _, t in rows)
    size, ids = {}, {}
    for r in got:
        shard = int(r.path.split("-")[1])
        size[shard] = size.get(shard, 0) + r.payload_bytes
        ids.setdefault(shard, []).append(-(1 << 63) if r.page_id is None else r.page_id)
    assert len(size) > 15 and max(size.values()) < 12_000
    order = [x for k in sorted(ids) for x in (min(ids[k]), max(ids[k]))]
    assert order == sorted(order)


def test_damage_is_found(spark, tmp_path):
    m = warc.write(spark.createDataFrame([(1, "http://a", "payload")], SCHEMA), folder(tmp_path))
    path = f"{tmp_path}/w/{m.first().path}"
    with open(path, "rb") as f:
        records = [content for _, content in warc.members(f.read)]
    assert records[1].endswith(b"payload\r\n\r\n")
    with open(path, "wb") as f:
        f.write(b"".join(gzip.compress(x.replace(b"\npayload", b"\npay10ad")) for x in records))
    with pytest.raises(Exception, match="damaged"):
        warc.read(m).collect()


def test_truncated_archives_are_found():
    import io

    data = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert len(list(warc.members(io.BytesIO(data * 2).read))) == 2
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(data + data[:-9]).read))


def test_empty_table_and_other_columns(spark, tmp_path):
    assert warc.roundtrip(spark.createDataFrame([], SCHEMA), folder=folder(tmp_path)).count() == 0
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA + ", sha string, shard string")
    assert warc.roundtrip(df, folder=folder(tmp_path, "v")).count() == len(ROWS)
