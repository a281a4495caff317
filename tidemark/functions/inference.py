"""Pluggable model calls: registries of batch functions, run as vectorised UDFs.

A model is a factory that is called once in a Python worker process, however many batches, tasks and queries that process
serves. Its batch function takes a list of texts and returns as many answers or vectors; failures become null answers with an error,
never exceptions. Calls are retried with growing, jittered pauses; results are kept in a cache of bounded size over
batches. The registered defaults are deterministic stubs: no model runs here.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BatchFn = Callable[[list[str]], list]
MODELS: dict[str, Callable[[], BatchFn]] = {}
EMBEDDERS: dict[str, Callable[[], BatchFn]] = {}
#: Results that a worker process keeps for each model.
KEPT = 10_000


def register(name: str, registry: dict[str, Callable[[], BatchFn]] | None = None) -> Callable[[Callable[[], BatchFn]], Callable[[], BatchFn]]:
    """Register a factory among the models, or among the embedders; it is called once in each Python worker process."""

    def add(factory: Callable[[], BatchFn]) -> Callable[[], BatchFn]:
        (MODELS if registry is None else registry)[name] = factory
        return factory

    return add


@register("stub")
def _stub() -> BatchFn:
    return lambda prompts: [hashlib.sha256(p.encode()).hexdigest()[:16] for p in prompts]


def _stub_embedder(width: int = 32) -> BatchFn:
    """Counts of words by a hash, with a sign from it, on the unit sphere; a text without words is the zero vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[i, h % width] += 1 if h >> 63 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1)).astype(np.float32).tolist()

    return embed


register("stub", EMBEDDERS)(_stub_embedder)


@dataclass(frozen=True)
class Retry:
    """Up to `attempts` calls; before each further one a pause of base * 2 ** (calls before - 1) seconds, `most` at the most, lengthened by up to `jitter` of itself."""

    attempts: int = 3
    base: float = 1.0
    most: float = 30.0
    jitter: float = 0.1
    sleep: Callable[[float], None] = time.sleep

    def pause(self, failed: int) -> float:
        return min(self.most, self.base * 2 ** (failed - 1)) * (1 + random.uniform(0, self.jitter))

    def call(self, fn: Callable[[], object]):
        """fn's result, or the last error."""
        for failed in range(1, self.attempts + 1):
            try:
                return fn()
            except Exception:  # a model may fail in any way
                if failed == self.attempts:
                    raise
                self.sleep(self.pause(failed))


class Kept:
    """The results used last, a bounded number of them, and how often they served."""

    def __init__(self, most: int = KEPT):
        self.most, self.hits, self.misses = most, 0, 0
        self._held: OrderedDict[Hashable, object] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, key: Hashable):
        """(known, result)"""
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return True, self._held[key]
        self.misses += 1
        return False, None

    def put(self, key: Hashable, result: object) -> None:
        self._held[key] = result
        self._held.move_to_end(key)
        if len(self._held) > self.most:
            self._held.popitem(last=False)


#: A process's batch functions and caches, by (kind, name).
_READY: dict[tuple[str, str], tuple[BatchFn, Kept]] = {}


def ready(kind: str, name: str, factory: Callable[[], BatchFn], most: int = KEPT) -> tuple[BatchFn, Kept]:
    """The process's one batch function of that name, made on first use, and its cache."""
    if (kind, name) not in _READY:
        _READY[kind, name] = factory(), Kept(most)
    return _READY[kind, name]


def answers_of(fn: BatchFn, prompts: list[str], retries: int = 3, retry: Retry | None = None) -> list[tuple[object, str | None]]:
    """(answer, error) of each prompt: the whole batch first, then, if that fails, one by one with retries."""
    retry = retry or Retry(retries)
    if len(prompts) > 1:
        try:
            return [(a, None) for a in fn(prompts)]
        except Exception:  # noqa: BLE001 - told prompt by prompt below
            retry.sleep(retry.pause(1))
            return [x for p in prompts for x in answers_of(fn, [p], retry=retry)]
    try:
        return [(retry.call(lambda: fn(prompts))[0], None)] if prompts else []
    except Exception as error:  # noqa: BLE001 - an error is data here
        return [(None, f"{type(error).__name__}: {error}")]


def served(kind: str, name: str, factory: Callable[[], BatchFn], texts: list[str], retry: Retry, most: int = KEPT) -> list[tuple[object, str | None]]:
    """(answer, error) of each text; each distinct one is asked for once, what the process remembers not at all. Errors are not remembered."""
    fn, kept = ready(kind, name, factory, most)
    known: dict[str, tuple[object, str | None]] = {}
    asked = []
    for text in dict.fromkeys(texts):
        held, answer = kept.get(text)
        if held:
            known[text] = answer, None
        else:
            asked.append(text)
    for text, (answer, error) in zip(asked, answers_of(fn, asked, retry=retry), strict=True):
        known[text] = answer, error
        if error is None:
            kept.put(text, answer)
    return [known[t] for t in texts]


def generate(prompt: Column, model: str = "stub", retries: int = 3, *, retry: Retry | None = None, most: int = KEPT) -> Column:
    """struct<answer, error> of each prompt. Not deterministic to Spark, so it is not evaluated twice."""
    ask = partial(served, "model", model, MODELS[model], retry=retry or Retry(retries), most=most)

    @F.pandas_udf("struct<answer: string, error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(ask(texts=list(batch.fillna(""))), columns=["answer", "error"])

    return run.asNondeterministic()(prompt)


def embed(text: Column, model: str = "stub", *, retry: Retry | None = None, most: int = KEPT) -> Column:
    """array<float> of each text; null for null and where the embedder failed for good."""
    ask = partial(served, "embedder", model, EMBEDDERS[model], retry=retry or Retry(), most=most)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            there = batch.notna()
            got = iter(ask(texts=list(batch[there])))
            yield pd.Series([next(got)[0] if t else None for t in there], dtype=object)

    return run.asNondeterministic()(text)


def verdict(criterion: Column, reference: Column, response: Column, model: str = "stub") -> Column:
    """True, false, or null where the judge failed: the answer read as yes or no."""
    prompt = F.concat_ws("\n", F.lit("Is the criterion met? Answer yes or no."), criterion, reference, response)
    said = F.lower(F.trim(generate(prompt, model)["answer"]))
    return F.when(said.startswith("yes"), True).when(said.startswith("no"), False)
