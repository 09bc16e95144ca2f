"""A learned embedder: co-occurrence of words and subwords, factorised in Spark rounds.

Every word stands for itself and for its runs of four letters, each hashed to one of ``BUCKETS`` buckets (so the model's size is bounded, whatever the corpus). A context is some
``CONTEXT`` consecutive words; its row has a weight for each bucket, by how often it is there and in how few contexts. The rows' product with their transpose counts which
buckets occur together; its leading directions are found by a randomised range finder: each round is one pass of the contexts that multiplies them by a narrow matrix and back, summed up
by blocks of buckets. The narrow matrix (BUCKETS x ``WIDTH``) is all that tasks get and all that comes back. A text's vector is the sum of its buckets' vectors, at unit
length: look-ups in numpy on Arrow batches. Contexts may be learned from a sample of ``most`` documents, by hash; everything is deterministic.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.functions import models
from spindrift.plans.scratch import folder

#: Buckets (a power of two), directions kept and tried, buckets of a block, words of a context, documents to learn from.
BUCKETS, DIMENSION, WIDTH, BLOCK, CONTEXT, MOST = 1 << 15, 128, 160, 1 << 10, 64, 200_000
#: A word counts as much as its subwords together; leading directions are damped by this power of their weight.
DAMPED = 0.5
_WORD = re.compile(r"\w+")
_SUMS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType())])


def buckets_of(word: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a word and its subwords, and their weights."""
    framed = f"<{word}>"
    parts = [framed[i : i + 4] for i in range(len(framed) - 3)] if len(framed) > 5 else []
    hashed = [zlib.crc32(x.encode()) & (buckets - 1) for x in (word, *("#" + p for p in parts))]
    return np.array(hashed, np.int64), np.array([1.0, *(1.0 / len(parts) for _ in parts)], np.float32)


class _Buckets(dict):
    """``buckets_of`` of the words seen so far; emptied when it is large."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets

    def __reduce__(self) -> tuple:
        return _Buckets, (self.buckets,)

    def __missing__(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > 200_000:
            self.clear()
        made = self[word] = buckets_of(word, self.buckets)
        return made


def row_of(words: list[str], known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of some words, and how strongly each is there."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    counted = Counter(words)
    parts = [known[w] for w in counted]
    at = np.concatenate([p[0] for p in parts])
    weight = np.concatenate([p[1] * (1 + math.log(n)) for p, n in zip(parts, counted.values(), strict=True)])
    own, where = np.unique(at, return_inverse=True)
    return own, np.bincount(where, weights=weight).astype(np.float32)


@dataclass(frozen=True)
class SubwordEmbedder:
    """Vectors of texts by look-up; a text without words has a vector of zeros."""

    scale: np.ndarray  # of each bucket
    vectors: np.ndarray  # buckets x dimension
    known: _Buckets = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "known", _Buckets(len(self.scale)))

    @property
    def dimension(self) -> int:
        return self.vectors.shape[1]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            at, weight = row_of(_WORD.findall(text.lower()), self.known)
            v = (weight * self.scale[at]) @ self.vectors[at] if len(at) else np.zeros(self.dimension)
            length = float(np.sqrt((v * v).sum()))
            out.append((v / length if length else v).tolist())
        return out


def contexts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """at and weight (a bucket and its weight, each an array) of every context."""
    schema = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.FloatType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for b in batches:
            for value in b.column(0):
                words, rows = _WORD.findall((value.as_py() or "").lower()), []
                for lo in range(0, len(words), CONTEXT):
                    rows.append(row_of(words[lo : lo + CONTEXT], known))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow.field(0).type), pa.array([r[1] for r in rows], arrow.field(1).type)], schema=arrow)

    return texts.select(text).mapInArrow(run, schema)


def _summed(rows: DataFrame, buckets: int, width: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum of (buckets, width) matrices to which ``add(matrix, at, weight, starts)`` adds a batch of contexts: each task has one, blocks of them are
    added up after a shuffle."""

    block_size = min(BLOCK, buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((buckets, width), np.float32)
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy()
            if sizes.sum():
                add(own, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(), np.cumsum(sizes) - sizes)
        used = [i for i in range(buckets // block_size) if own[i * block_size : (i + 1) * block_size].any()]
        for i in used:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own[i * block_size : (i + 1) * block_size].tobytes()], pa.binary())], schema=to_arrow_schema(_SUMS))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, block = np.zeros((block_size, width), np.float64), 0
        for b in batches:
            block = b.column(0)[0].as_py()
            for x in b.column(1):
                whole += np.frombuffer(x.as_py(), np.float32).reshape(block_size, width)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([whole.astype(np.float32).tobytes()], pa.binary())], schema=to_arrow_schema(_SUMS))

    out = np.zeros((buckets, width), np.float64)
    for r in rows.mapInArrow(run, _SUMS).groupBy("block").applyInArrow(add_up, _SUMS).collect():  # buckets x width numbers
        out[r.block * block_size : (r.block + 1) * block_size] = np.frombuffer(r.data, np.float32).reshape(block_size, width)
    return out


def _scatter(own: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to the rows ``at`` of a matrix."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    own[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def learn(texts: DataFrame, text: str = "text", dimension: int = DIMENSION, width: int = WIDTH, rounds: int = 3, most: int = MOST, buckets: int = BUCKETS, seed: int = 5) -> SubwordEmbedder:
    """An embedder from at most about ``most`` of the texts. The passes read contexts from a table in the shared folder."""
    spark = texts.sparkSession
    every = max(1, math.ceil(texts.count() / most))
    sample = texts.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0) if every > 1 else texts
    where = folder(spark, "contexts")
    contexts(sample, text, buckets).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).write.parquet(where)
    rows = spark.read.parquet(where)
    n = max(1, rows.count())

    def held(own: np.ndarray, at: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> None:
        own[:, 0] += np.bincount(at, minlength=buckets)

    scale = np.log((1 + n) / (1 + _summed(rows, buckets, 1, held)[:, 0])).astype(np.float32) + np.float32(1e-3)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, width)))[0].astype(np.float32)
    for _ in range(rounds):
        narrow = q

        def there_and_back(own: np.ndarray, at: np.ndarray, weight: np.ndarray, starts: np.ndarray, narrow: np.ndarray = narrow) -> None:
            weight = weight * scale[at]
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
            weight /= np.sqrt(np.maximum(np.bincount(of, weights=weight * weight), 1e-12)).astype(np.float32)[of]
            full = np.flatnonzero(np.diff(np.append(starts, len(at))))
            seen = np.add.reduceat(narrow[at] * weight[:, None], starts[full], axis=0)
            _scatter(own, at, seen[np.searchsorted(full, of)] * weight[:, None])

        y = _summed(rows, buckets, width, there_and_back)
        small = q.T.astype(np.float64) @ y  # the counts, seen in the last round's directions
        last, q = q, np.linalg.qr(y)[0].astype(np.float32)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[: min(dimension, width)]
    vectors = last.astype(np.float64) @ turned[:, best] * np.maximum(values[best], 1e-9) ** (-DAMPED / 2)
    return SubwordEmbedder(scale, vectors.astype(np.float32))


def save(spark: SparkSession, model: SubwordEmbedder, path: str) -> None:
    rows = [(i, model.scale[i : i + BLOCK].tobytes(), model.vectors[i : i + BLOCK].tobytes(), model.dimension) for i in range(0, len(model.scale), BLOCK)]
    spark.createDataFrame(rows, "first int, scale binary, vectors binary, dimension int").write.mode("overwrite").parquet(path)


PREFIX = "learned:"


def use(spark: SparkSession, name: str) -> str:
    """Makes ``learned:<path>`` (what ``save`` wrote) known as an embedder; other names are left alone. Returns the name."""
    if name.startswith(PREFIX) and name not in models.EMBEDDERS:
        rows = spark.read.parquet(name.removeprefix(PREFIX)).orderBy("first").collect()
        scale = np.concatenate([np.frombuffer(r.scale, np.float32) for r in rows])
        model = SubwordEmbedder(scale, np.concatenate([np.frombuffer(r.vectors, np.float32).reshape(-1, r.dimension) for r in rows]))
        models.EMBEDDERS[name] = lambda: model
    return name


def embedding(text: Column, model: SubwordEmbedder) -> Column:
    """The text's vector."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.embed_batch(texts.fillna("").tolist()), index=texts.index)

    return run(text)
