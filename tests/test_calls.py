"""Calls in flight against a service that counts what it is asked."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators.calls import AHEAD, Pace, Paced, Service, in_order
from weftline.operators.models import FunctionCompleter, completed


class Counted:
    """Answers after a while; knows how many calls were open at one time and when each began."""

    def __init__(self, seconds=0.02, fails=()):
        self.seconds, self.fails, self.open, self.most, self.began, self.lock = seconds, dict(fails), 0, 0, [], threading.Lock()

    def complete(self, prompts, max_tokens):
        (p,) = prompts
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
            self.began.append(time.monotonic())
            left = self.fails.get(p, 0)
            self.fails[p] = left - 1
        time.sleep(self.seconds)
        with self.lock:
            self.open -= 1
        if left > 0:
            raise RuntimeError("busy")
        return [(p.upper(), None)]


def test_answers_keep_the_order_of_rows_and_the_window():
    service = Counted()
    taken = []
    items = (taken.append(i) or f"p{i}" for i in range(60))
    seen = []
    for answer in in_order(items, lambda p: service.complete([p], 5)[0][0], 6):
        seen.append(answer)
        assert len(taken) - len(seen) <= AHEAD * 6
    assert seen == [f"P{i}" for i in range(60)] and 1 < service.most <= 6


def test_a_slow_call_holds_nothing_but_its_place():
    began = time.monotonic()
    got = list(in_order(iter(range(16)), lambda i: time.sleep(0.3 if i == 0 else 0.02) or i, 4))
    assert got == list(range(16)) and time.monotonic() - began < 0.6


def test_an_error_stops_the_window():
    def call(i):
        if i == 3:
            raise ValueError("three")
        return i

    with pytest.raises(ValueError, match="three"):
        list(in_order(iter(range(1000)), call, 2))


def test_pace():
    now, waits = [10.0], []
    pace = Pace(4, clock=lambda: now[0], sleep=waits.append)
    for _ in range(4):
        pace.wait()
    assert waits == [0.25, 0.5, 0.75]
    now[0] += 5
    pace.wait()
    assert len(waits) == 3  # unused time is not saved up
    service = Counted(0.0)
    paced = Paced(service, Pace(50), None)
    list(in_order(iter("abcdefghij"), lambda p: paced.complete([p], 5), 10))
    assert service.began[-1] - service.began[0] >= 9 / 50 - 0.01


def test_a_call_without_an_answer_counts_as_failed():
    paced = Paced(Counted(5.0), Pace(None), 0.05)
    began = time.monotonic()
    with pytest.raises(TimeoutError, match="no answer"):
        paced.complete(["a"], 5)
    assert time.monotonic() - began < 2
    with pytest.raises(RuntimeError, match="busy"):
        Paced(Counted(0.0, {"a": 1}), Pace(None), 1).complete(["a"], 5)


def test_a_service_gives_what_a_completer_gives(spark, monkeypatch):
    """Rows, nulls, attempts and errors are the same, whatever the calls in flight and the batches."""
    rows = spark.range(500).select("id", F.when(F.col("id") % 9 > 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("prompt")).repartition(3, "id")
    make = lambda: FunctionCompleter(lambda p: p * 2)
    want = sorted(map(tuple, completed(rows, "prompt", make, 5).collect()))
    for batch in (7, 1000):
        assert sorted(map(tuple, completed(rows, "prompt", Service(make, in_flight=5, per_second=100_000, timeout=30), 5, batch=batch).collect())) == want
    assert completed(rows.limit(0), "prompt", Service(make), 5).count() == 0


def test_a_killed_task_asks_nothing_twice(spark, tmp_path):
    """A task ends with its process at one prompt; what its finished chunks hold is not asked for again, nor are answers of a run before."""
    import os
    import uuid

    os.makedirs(tmp_path / "asked")
    rows = spark.range(60).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).coalesce(1)
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")

    def service(fatal, wrong=None):
        def one(p):
            if p == fatal:
                os._exit(1)
            open(f"{tmp_path}/asked/{p}-{uuid.uuid4().hex}", "w").close()
            if p == wrong:
                raise RuntimeError("busy")
            return p.upper()

        return Service(lambda: FunctionCompleter(one), in_flight=1, saved=f"file://{tmp_path}/saved")

    asked = lambda: [n.split("-")[0] for n in os.listdir(tmp_path / "asked")]
    with pytest.raises(Exception, match="(?i)worker|crash|EOF|exit"):
        completed(rows, "prompt", service("p47"), 5, batch=10).collect()
    first = asked()
    assert set(first) >= {f"p{i}" for i in range(40)}
    got = completed(rows, "prompt", service(None), 5, batch=10).collect()
    assert [r.answer.text for r in sorted(got)] == [f"P{i}" for i in range(60)]
    assert all(asked().count(f"p{i}") == 1 for i in range(40)) and all(asked().count(f"p{i}") == 1 for i in range(50, 60))
    n = len(asked())
    assert sorted(completed(rows, "prompt", service("p0"), 5, batch=10).collect()) == sorted(got) and len(asked()) == n


def test_failed_answers_are_not_saved(tmp_path):
    from weftline.operators.calls import Saved

    saved = Saved(f"{tmp_path}/s", 5)
    good, bad = {"text": "A", "attempts": 1, "error": None, "usage": None}, {"text": "", "attempts": 4, "error": "busy", "usage": None}
    saved.save(["a", None, "b"], [good, None, bad])
    assert saved.load(["a", None, "b"]) == [good, None, None] and saved.load(["a"]) == [None] and Saved(f"{tmp_path}/s", 6).load(["a", None, "b"]) == [None] * 3
