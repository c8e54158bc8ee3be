"""JSON arrays and objects in parts, against json.loads and json.dumps of the whole."""

import json
import random

import pytest

from weftline.sources import files, json_parts


def text(rnd):
    return "".join(rnd.choice(['a', '"', "\\", "}", "{", "[", "]", "é", "漢", "\n", " ", "\\\\", '\\"']) for _ in range(rnd.randrange(12)))


def record(rnd, i):
    r = {"sentence": text(rnd), "subject": f"s{i}", "predicate": text(rnd), "object": text(rnd), "validation": text(rnd)}
    if rnd.random() < 0.3:
        r["deep"] = {"x": [{"y": text(rnd)}, []], "def": 1}
    if rnd.random() < 0.2:
        r["def"] = text(rnd)
    return r


def graph(rnd, kind, n):
    if kind == "array":
        return [record(rnd, i) if rnd.random() < 0.9 else rnd.choice([1, "}", None, [], [{"no": 1}]]) for i in range(n)]
    return {f"k}}{i}": rnd.choice([record(rnd, i), [record(rnd, 1000 * i + k) for k in range(rnd.randrange(9))], text(rnd), 3, {"def": "d"}, [1, [{"no": "}"}]]]) for i in range(n)}


@pytest.mark.parametrize("kind", ["array", "object"])
@pytest.mark.parametrize("indent", [None, 2])
def test_splits_read_as_the_whole(spark, tmp_path, kind, indent):
    rnd = random.Random(repr((kind, indent)))
    names = {}
    for name, n in (("a.json", 150), ("b.json", 0), ("c.json", 40)):
        names[name] = graph(rnd, kind, n)
        (tmp_path / name).write_text(json.dumps(names[name], indent=indent, ensure_ascii=rnd.random() < 0.5) + rnd.choice(["", "\n"]), encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in ("300", "5000", size):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            for mode in ("list_items", "strict", "values"):
                rows = files.read_graph(spark, f"{tmp_path}/*.json", mode, extra="validation string")
                got = sorted(map(tuple, rows.collect()))
                want = []
                for i, name in enumerate(sorted(names)):
                    kept = list(files._records(names[name], mode))
                    want += [(i * json_parts.FILE_ROWS + k, *[r.get(c, None if c == "validation" else "") for c in ("sentence", "subject", "predicate", "object", "validation")]) for k, r in enumerate(kept)]
                assert got == want, (most, mode)
            assert most == size or json_parts._splits(spark, f"{tmp_path}/*.json").rdd.getNumPartitions() > (20 if most == "300" else 1)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("broken", ['[{"a": 1}', '{"a": [1}', '[{"a": "x}]', '[{"a": 1}]]'])
def test_broken_files_fail(spark, tmp_path, broken):
    (tmp_path / "x.json").write_text(broken)
    with pytest.raises(Exception, match="broken JSON|JSONDecodeError"):
        files.read_graph(spark, f"{tmp_path}/x.json").collect()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_an_array_in_parts_is_the_array(spark, tmp_path, n):
    rnd = random.Random(n)
    rows = [(i, text(rnd), [text(rnd)]) for i in range(n)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "pos long, name string, list array<string>")
    want = json.dumps([{"pos": p, "name": x, "list": y} for p, x, y in sorted(rows)], indent=2, ensure_ascii=False).encode()
    for _ in range(2):  # the second time over the first
        paths = files.write_json_array(frame, f"{tmp_path}/out", ["pos"])
        assert json_parts.joined_file(f"{tmp_path}/out", f"{tmp_path}/one.json") == len(want) and (tmp_path / "one.json").read_bytes() == want
        assert json_parts.parts_of(f"{tmp_path}/out") == paths
    assert n < 500 or len([p for p in paths if "/part-" in p]) > 1


def test_an_object_in_parts_is_the_object(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(f'k"{i:03d}', i, ["x"] * (i % 3)) for i in range(200)]
    frame = spark.createDataFrame(rows, "key string, n long, list array<string>").withColumn("value", F.to_json(F.struct("n", "list")))
    json_parts.write_array(frame, f"{tmp_path}/out", ["key"], key="key", value="value")
    json_parts.joined_file(f"{tmp_path}/out", f"{tmp_path}/one.json")
    assert (tmp_path / "one.json").read_text() == json.dumps({k: {"n": n, "list": x} for k, n, x in rows}, indent=2)
