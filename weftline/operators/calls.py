"""Calls to a model service: several in flight in each task, answers in the order of the rows and saved as they come, one rate for all tasks."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from weftline.sources.json_parts import _filesystem

#: Answers that may wait for an earlier one, for each call in flight.
AHEAD = 4


@dataclass(frozen=True)
class Service:
    """A factory of a completer that a task may call from several threads, wherever a factory is taken.

    in_flight: calls of a task at one time. per_second: calls begun in a second by all tasks together; each of the tasks that may run at
    one time has an equal share, so the rate is never passed, and not reached while some have nothing to ask. timeout: seconds after which
    a call counts as failed; it is left to itself, as a thread cannot be stopped. Failed calls are asked again after the waits of `models.WAITS`.
    saved: a folder that all executors share, one for each model, in which a task saves the answers of each chunk of rows as it goes. A task that
    is repeated, in this run or a later one over the same rows, asks only for what is not there. Rows of a task have to come in one order:
    give it a table that was written.
    """

    make: Callable[[], Any]
    in_flight: int = 8
    per_second: float | None = None
    timeout: float | None = None
    saved: str | None = None

    def __call__(self) -> Any:
        return self.make()


class Pace:
    """Lets callers pass at even distances, `per_second` of them in a second at most."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.step = 1 / per_second if per_second else 0.0
        self.clock, self.sleep, self.next, self.lock = clock, sleep, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.step:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.step
        if at > now:
            self.sleep(at - now)


class Paced:
    """A completer that asks at a pace, and gives a call up after a time."""

    def __init__(self, completer: Any, pace: Pace, timeout: float | None) -> None:
        self.completer, self.pace, self.timeout = completer, pace, timeout

    def complete(self, prompts: list[str], max_tokens: int) -> list[tuple[str, dict | None]]:
        self.pace.wait()
        if self.timeout is None:
            return self.completer.complete(prompts, max_tokens)
        answer: Future = Future()

        def ask() -> None:
            try:
                answer.set_result(self.completer.complete(prompts, max_tokens))
            except BaseException as e:  # the caller raises it
                answer.set_exception(e)

        threading.Thread(target=ask, daemon=True).start()
        try:
            return answer.result(self.timeout)
        except TimeoutError as e:
            raise TimeoutError(str(e) or f"no answer in {self.timeout} seconds") from e


def in_order(items: Iterator[Any], call: Callable[[Any], Any], in_flight: int) -> Iterator[Any]:
    """call(item) of each item, in order, `in_flight` of them at one time. Not more than AHEAD times as many items are taken before their answers are."""
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque[Future] = deque()
        try:
            for item in items:
                waiting.append(pool.submit(call, item))
                while waiting and (len(waiting) >= AHEAD * in_flight or waiting[0].done()):
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for f in waiting:
                f.cancel()


class Saved:
    """Answers of chunks of prompts in a folder, under a hash of the prompts. A file appears whole or not at all; failed answers are not kept."""

    def __init__(self, folder: str | None, max_tokens: int) -> None:
        self.folder, self.max_tokens = folder, max_tokens

    def _place(self, prompts: list[str | None]):
        system, place = _filesystem(self.folder)
        name = hashlib.sha256(json.dumps([self.max_tokens, prompts]).encode()).hexdigest()
        return system, f"{place}/{name[:2]}/{name}.json"

    def load(self, prompts: list[str | None]) -> list[dict | None]:
        if self.folder:
            system, place = self._place(prompts)
            try:
                with system.open_input_stream(place) as f:
                    return json.loads(f.read())
            except FileNotFoundError:
                pass
        return [None] * len(prompts)

    def save(self, prompts: list[str | None], answers: list[dict | None]) -> None:
        if not self.folder:
            return
        system, place = self._place(prompts)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        temporary = f"{place}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as f:
            f.write(json.dumps([a if a and a["error"] is None else None for a in answers]).encode())
        system.move(temporary, place)
