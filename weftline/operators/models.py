"""Model steps: text completion and embedding behind small protocols, in Arrow batches, with deterministic stand-ins."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.calls import Pace, Paced, Saved, Service, in_order
from weftline.runtime import beside
from weftline.schema import COMPLETION

#: Attempts of a call, and seconds to wait after each failed one.
WAITS = (1, 2, 4, 8)
#: Prompts of a generation batch; texts of an embedding batch.
GENERATION_BATCH, EMBEDDING_BATCH = 100, 256


class Completer(Protocol):
    """Answers prompts at temperature 0, each with its token usage or None."""

    def complete(self, prompts: list[str], max_tokens: int) -> list[tuple[str, dict | None]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class FunctionCompleter:
    """A completer made of a function from prompt to answer."""

    def __init__(self, answer: Callable[[str], str]) -> None:
        self.answer = answer

    def complete(self, prompts: list[str], max_tokens: int) -> list[tuple[str, dict | None]]:
        return [(self.answer(p), None) for p in prompts]


class LetterCounts:
    """A stand-in embedder: how often each of the letters a to z occurs."""

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], dtype=float).reshape(-1, 26)


class OllamaCompleter:
    """A local Ollama server's chat model; one call a prompt. Needs the ollama package."""

    def __init__(self, model: str = "llama3") -> None:
        import ollama

        self.chat, self.model = ollama.chat, model

    def complete(self, prompts: list[str], max_tokens: int) -> list[tuple[str, dict | None]]:
        return [(self.chat(model=self.model, messages=[{"role": "user", "content": p}], options={"temperature": 0})["message"]["content"].strip(), None) for p in prompts]


class OpenAICompleter:
    """A chat model of an OpenAI-compatible service; one call a prompt. Needs the openai package."""

    def __init__(self, model: str, **client: object) -> None:
        from openai import OpenAI

        self.client, self.model = OpenAI(**client), model

    def complete(self, prompts: list[str], max_tokens: int) -> list[tuple[str, dict | None]]:
        out = []
        for p in prompts:
            r = self.client.chat.completions.create(model=self.model, messages=[{"role": "user", "content": p}], temperature=0, max_tokens=max_tokens)
            u = r.usage
            out.append(((r.choices[0].message.content or "").strip(), {"prompt_tokens": u.prompt_tokens, "completion_tokens": u.completion_tokens, "total_tokens": u.total_tokens} if u else None))
        return out


class TransformersCompleter:
    """A causal language model in the worker, decoded greedily. Needs torch and transformers; with a chat template, prompts are user messages."""

    def __init__(self, model: str, device: str = "auto") -> None:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        self.tokenizer = AutoTokenizer.from_pretrained(model)
        self.model = AutoModelForCausalLM.from_pretrained(model, torch_dtype=torch.bfloat16, device_map=device)
        if self.tokenizer.pad_token is None:
            self.tokenizer.pad_token = self.tokenizer.eos_token

    def complete(self, prompts: list[str], max_tokens: int) -> list[tuple[str, dict | None]]:
        out = []
        for p in prompts:
            text = self.tokenizer.apply_chat_template([{"role": "user", "content": p}], tokenize=False, add_generation_prompt=True) if self.tokenizer.chat_template else p
            given = self.tokenizer(text, return_tensors="pt").to(self.model.device)
            ids = self.model.generate(**given, max_new_tokens=max_tokens, do_sample=False, pad_token_id=self.tokenizer.pad_token_id)
            out.append((self.tokenizer.decode(ids[0][given["input_ids"].shape[1] :], skip_special_tokens=True).strip(), None))
        return out


class VLLMCompleter:
    """A vLLM engine in the worker: a batch of prompts at once, stopping at a line feed. Needs vllm."""

    def __init__(self, model: str, tensor_parallel_size: int = 1, **engine: object) -> None:
        from vllm import LLM, SamplingParams

        self.engine, self.params = LLM(model=model, tensor_parallel_size=tensor_parallel_size, dtype="bfloat16", enable_prefix_caching=True, **engine), SamplingParams

    def complete(self, prompts: list[str], max_tokens: int) -> list[tuple[str, dict | None]]:
        done = self.engine.generate(prompts, self.params(temperature=0, max_tokens=max_tokens, stop=["\n"]))
        return [(d.outputs[0].text.strip(), None) for d in done]


class SentenceEmbedder:
    """A sentence-transformers model in the worker. Needs that package."""

    def __init__(self, model: str = "all-MiniLM-L6-v2", normalize: bool = False) -> None:
        from sentence_transformers import SentenceTransformer

        self.model, self.normalize = SentenceTransformer(model), normalize

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.model.encode(texts, batch_size=EMBEDDING_BATCH, show_progress_bar=False, convert_to_numpy=True, normalize_embeddings=self.normalize)


def called(completer: Completer, prompts: list[str], max_tokens: int, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Answers with attempts and errors. A failing batch is retried prompt by prompt; a prompt that keeps failing has an empty text and its last error."""
    try:
        return [{"text": t, "attempts": 1, "error": None, "usage": u} for t, u in completer.complete(prompts, max_tokens)]
    except Exception as e:
        if len(prompts) > 1:
            return [r for p in prompts for r in called(completer, [p], max_tokens, waits, sleep)]
        error = str(e)
    sleep(waits[0])
    for attempt, wait in enumerate(waits[1:], start=2):
        try:
            ((text, usage),) = completer.complete(prompts, max_tokens)
            return [{"text": text, "attempts": attempt, "error": None, "usage": usage}]
        except Exception as e:
            error = str(e)
            sleep(wait)
    return [{"text": "", "attempts": len(waits), "error": error, "usage": None}]


def _added(df: DataFrame, name: str, kind: str, work: Callable[[], Callable[[list], list]], column: str, batch: int, kept: bool = True) -> DataFrame:
    place = df.columns.index(column)
    stay = [i for i in range(len(df.columns)) if kept or i != place]
    schema = T.StructType([*[df.schema.fields[i] for i in stay], T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        step = work()
        for b in batches:
            # The model gets `batch` values at a time, but rows leave as they came: a small batch costs as much to hand over as a large one.
            own = [x for at in range(0, b.num_rows, batch) for x in step(b.column(place).slice(at, batch).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(f.type) for i, f in zip(stay, arrow, strict=False)], pa.array(own, type=arrow.field(name).type)], schema=arrow)

    return df.mapInArrow(run, schema)


def completed(df: DataFrame, prompt: str, factory: Callable[[], Completer], max_tokens: int, out: str = "answer", batch: int = GENERATION_BATCH, kept: bool = True) -> DataFrame:
    """df with `out`: struct(text, attempts, error, usage) of each prompt, and without the prompts if they are not `kept`. Null prompts are not sent. factory() runs once a task; a `Service` is asked for several prompts at one time, one a call."""
    if isinstance(factory, Service):
        return _asked(df, prompt, factory, max_tokens, out, batch, kept)

    def work():
        completer = factory()

        def step(prompts: list[str | None]) -> list[dict | None]:
            asked = [p for p in prompts if p is not None]
            answers = iter(called(completer, asked, max_tokens) if asked else [])
            return [next(answers) if p is not None else None for p in prompts]

        return step

    return _added(df, out, COMPLETION, work, prompt, batch, kept)


def _asked(df: DataFrame, prompt: str, service: Service, max_tokens: int, out: str, batch: int, kept: bool) -> DataFrame:
    """`completed` by calls in flight: rows leave a task in their order, `batch` of them at a time."""
    place = df.columns.index(prompt)
    stay = [i for i in range(len(df.columns)) if kept or i != place]
    schema = T.StructType([*[df.schema.fields[i] for i in stay], T.StructField(out, T._parse_datatype_string(COMPLETION))])
    tasks = max(1, df.sparkSession.sparkContext.defaultParallelism)
    share = service.per_second / tasks if service.per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        completer, saved = Paced(service(), Pace(share), service.timeout), Saved(service.saved, max_tokens)
        parts: deque[tuple[pa.RecordBatch, list, bool]] = deque()

        def prompts() -> Iterator[tuple[str | None, dict | None]]:
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    texts = part.column(place).to_pylist()
                    old = saved.load(texts)
                    parts.append((part, texts, any(t is not None and a is None for t, a in zip(texts, old, strict=True))))
                    yield from zip(texts, old, strict=True)

        ask = lambda x: x[1] if x[0] is None or x[1] else called(completer, [x[0]], max_tokens)[0]
        done: list[dict | None] = []
        for answer in in_order(prompts(), ask, service.in_flight):
            done.append(answer)
            if len(done) == parts[0][0].num_rows:
                part, texts, new = parts.popleft()
                if new:
                    saved.save(texts, done)
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(f.type) for i, f in zip(stay, arrow, strict=False)], pa.array(done, type=arrow.field(out).type)], schema=arrow)
                done = []

    return df.mapInArrow(run, schema)


def embedded(df: DataFrame, text: str, factory: Callable[[], Embedder], out: str, batch: int = EMBEDDING_BATCH, normalize: bool = False) -> DataFrame:
    """df with the vector `out` of each text (null as empty); normalize scales it to length one."""

    def work():
        embedder = factory()

        def step(texts: list[str | None]) -> list[list[float]]:
            m = np.asarray(embedder.embed([t or "" for t in texts]), dtype=float)
            if normalize:
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            return list(m)

        return step

    return _added(df, out, "array<double>", work, text, batch)


def for_distinct(df: DataFrame, column: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A step over a column's distinct values only, written and joined back."""
    done = step(df.select(column).distinct())
    extra = [c for c in done.columns if c != column]
    side = beside(done.select(F.col(column).alias("__v"), *extra))
    return df.join(side, df[column].eqNullSafe(side["__v"]), "left").drop("__v")
