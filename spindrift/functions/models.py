"""Pluggable models: embedders, rerankers, text generators, and how their inputs are batched.

No model files ship with the engine. The defaults are deterministic: a hashing embedder, a lexical reranker, a generator that
repeats what it is given. Others are registered by name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of one unit of cost, tokens for each GB of memory when embedding and reranking, GB that a CPU counts as.
UNIT_TOKENS, EMBED_TOKENS_PER_GB, RERANK_TOKENS_PER_GB, CPU_GB = 256, 12_288, 6_144, 2
RERANK_CHARS = 2000
#: Rows of an Arrow batch that are embedded at a time.
SLICE_ROWS = 256


class Embedder(Protocol):
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class TextGenerator(Protocol):
    """``stream`` gives pieces of text as they come, and last the whole with its usage; it may be missing (see ``streamed``)."""

    def generate(self, system: str, messages: list[dict[str, str]]) -> Generated: ...

    def stream(self, system: str, messages: list[dict[str, str]]) -> Iterator[str | Generated]: ...


def streamed(generator: TextGenerator, system: str, messages: list[dict[str, str]]) -> Iterator[str | Generated]:
    """The generator's stream; the whole answer as one piece where it has none."""
    if hasattr(generator, "stream"):
        yield from generator.stream(system, messages)
    else:
        answer = generator.generate(system, messages)
        yield answer.content
        yield answer


@dataclass(frozen=True)
class Usage:
    input_tokens: int = 0
    output_tokens: int = 0
    cache_read_tokens: int = 0
    cache_write_tokens: int = 0

    @property
    def total_tokens(self) -> int:
        return self.input_tokens + self.output_tokens


@dataclass(frozen=True)
class Generated:
    content: str
    usage: Usage | None = None
    model: str = ""
    stop_reason: str | None = None


@lru_cache(maxsize=1 << 17)
def _word_number(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of words by the first 32 bits of their MD5, modulo the dimension, at unit length."""

    dimension: int = 512

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"[a-z0-9]+", text.lower()):
                v[_word_number(w) % self.dimension] += 1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out


@dataclass(frozen=True)
class Truncated:
    """Another embedder's vectors cut to their first components, not scaled again; a task prefix goes before each text."""

    inner: Embedder
    dimension: int
    prefix: str = ""

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [v[: self.dimension] for v in self.inner.embed_batch([self.prefix + t for t in texts])]


@dataclass(frozen=True)
class LexicalReranker:
    """The share of the query's distinct words that the text holds."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        words = lambda s: set(re.findall(r"[a-z0-9]+", s.lower()))
        q = words(query)
        return [len(q & words(t)) / len(q) if q else 0.0 for t in texts]


@dataclass(frozen=True)
class EchoGenerator:
    """Answers with the beginning of the last user message; for tests and offline use."""

    most: int = 200

    def generate(self, system: str, messages: list[dict[str, str]]) -> Generated:
        last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
        n = sum(len(m["content"].encode()) for m in messages) // 4
        return Generated(last[: self.most], Usage(n, min(len(last), self.most) // 4), "echo", "end_turn")

    def stream(self, system: str, messages: list[dict[str, str]]) -> Iterator[str | Generated]:
        """Word by word."""
        whole = self.generate(system, messages)
        yield from re.findall(r"\s*\S+\s*", whole.content)
        yield whole


class GenerationError(RuntimeError):
    """A text generator failed."""


class ThrottledError(GenerationError):
    """The service asks to slow down."""


class InvalidRequestError(GenerationError):
    """The service refuses the request."""


def classify_failure(code: str, message: str) -> GenerationError:
    """The error that a service's code stands for."""
    text = f"{code} {message}".lower()
    if re.search(r"throttl|rate.?limit|too many|429", text):
        return ThrottledError(message)
    if re.search(r"validation|invalid|bad request|400", text):
        return InvalidRequestError(message)
    return GenerationError(message)


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}
RERANKERS: dict[str, Callable[[], Reranker]] = {"lexical": LexicalReranker}
GENERATORS: dict[str, Callable[[], TextGenerator]] = {"echo": EchoGenerator}


def create(registry: dict[str, Callable], name: str):
    """The model registered as ``name``; ValueError if there is none."""
    if name not in registry:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]()


def budget(tokens_per_gb: int, gpu_gb: float | None = None) -> int:
    """Tokens of a batch on this much memory."""
    return int(tokens_per_gb * gpu_gb) if gpu_gb else tokens_per_gb * CPU_GB


class Packer:
    """Numbers batches: greedy in order, attention cost (tokens / unit) squared, whatever exceeds the capacity alone."""

    def __init__(self, most_tokens: int):
        self.capacity, self.next, self.open, self.used = most_tokens / UNIT_TOKENS, 0, -1, 0.0

    def place(self, tokens: int) -> int:
        """The number of the batch that the next item belongs to."""
        cost = max(1.0, tokens / UNIT_TOKENS) ** 2
        if cost > self.capacity:
            self.next += 1
            return self.next - 1
        if self.open < 0 or self.used + cost > self.capacity:
            self.open, self.used, self.next = self.next, 0.0, self.next + 1
        self.used += cost
        return self.open


def pack(tokens: Iterable[int], most_tokens: int) -> list[list[int]]:
    """Places of ``tokens`` in their batches, in the order in which batches are full; what is alone comes before the batch that is still open."""
    packer, done, held, number = Packer(most_tokens), [], [], -1
    for i, n in enumerate(tokens):
        place = packer.place(n)
        if place != packer.open:
            done.append([i])
        elif place == number:
            held.append(i)
        else:
            done += [held] if held else []
            held, number = [i], place
    return [*done, held] if held else done


def _embed_rows(model: Embedder, texts: list[str], most_tokens: int) -> list[list[float]]:
    out: list[list[float]] = [[]] * len(texts)
    for batch in pack((len(t.encode()) // 4 for t in texts), most_tokens):
        for i, v in zip(batch, model.embed_batch([texts[i] for i in batch]), strict=True):
            out[i] = v  # by place, so an oversize text that goes first moves nobody else's vector
    return out


def _vectors(rows: list[list[float]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.asarray(v, np.float32) for v in rows])))


def embedding(text: Column, name: str = "hashing", most_tokens: int = EMBED_TOKENS_PER_GB * CPU_GB) -> Column:
    """The text's vector; the model is made once in each worker."""
    make = EMBEDDERS[name] if name in EMBEDDERS else create(EMBEDDERS, name)

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            for at in range(0, len(texts), SLICE_ROWS):  # a vector takes many times its text's room as Python's numbers
                yield _vectors(_embed_rows(model, [t or "" for t in texts.slice(at, SLICE_ROWS).to_pylist()], most_tokens))

    return run(text)


def _score_rows(model: Reranker, query: str, texts: list[str], most_tokens: int) -> list[float]:
    """Scores of texts, in batches whose cost, with the query before each text, stays within the memory."""
    own, out = len(query.encode()) // 4, [0.0] * len(texts)
    for batch in pack((own + len(t.encode()) // 4 for t in texts), most_tokens):
        for i, s in zip(batch, model.scores(query, [texts[i] for i in batch]), strict=True):
            out[i] = s
    return out


def rerank(df: DataFrame, query: str, key: str, text: str, name: str = "lexical", most_tokens: int = RERANK_TOKENS_PER_GB * CPU_GB, slice_chars: int = RERANK_CHARS) -> DataFrame:
    """key and rerank_score: texts cut into slices, each scored against the query in batches of tokens, the best slice counts."""
    make = RERANKERS[name] if name in RERANKERS else create(RERANKERS, name)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(_score_rows(model, query, texts.tolist(), most_tokens), index=texts.index)

    last = F.greatest(F.lit(0), F.ceil(F.length("t") / slice_chars).cast("int") - 1)
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("t", i * slice_chars + 1, F.lit(slice_chars)))
    slices = df.select(key, F.coalesce(text, F.lit("")).alias("t")).select(key, F.explode(parts).alias("part"))
    return slices.select(key, run("part").alias("s")).groupBy(key).agg(F.max("s").alias("rerank_score"))


def hashed_counts(df: DataFrame, key: str, text: str, dimension: int = 512) -> DataFrame:
    """key, bucket, n: the hashing embedder natively, not scaled. Words are counted inside their row, nothing is shuffled."""
    number = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dimension).cast("int")
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+", -1), lambda w: w != "")
    sorted_ = df.select(key, F.array_sort(F.transform(words, number)).alias("b"))
    # a bucket's count is the distance between the places where it begins and where the next one does
    starts = F.filter(F.transform("b", lambda x, i: F.when((i == 0) | (F.get("b", i - 1) != x), i)), lambda i: i.isNotNull())
    cut = sorted_.select(key, "b", starts.alias("s"), F.size("b").alias("size"))
    each = F.transform("s", lambda i, k: F.struct(F.get("b", i).alias("bucket"), (F.coalesce(F.get("s", k + 1), F.col("size")) - i).cast("int").alias("n")))
    return cut.select(key, F.inline(each))
