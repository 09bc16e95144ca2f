"""Toxicity by weak supervision.

Voters are lexicons and patterns: words, and beginnings of words, that stand out in the documents marked as toxic
(log-likelihood ratio), dealt to many voters, and voters for several hits at once. A generative label model estimates by
expectation maximisation how often each voter fires on toxic and on clean documents, and from the correlations of the
voters inside the classes how much each adds to the others. Its posterior labels train a logistic regression over the
single hits, which scores every document.

The model is fitted on at most ``LABELLED`` labelled rows, those with the smallest hashes of their doc_id; every item of them that
passes the thresholds becomes a weight, however many they are, and everything else covers all documents. Null, empty and wordless texts get the score of a text without hits. Without labelled rows of both kinds the
score is the share of toxic rows (0 without rows). Repeated rows are scored one by one; labels with nulls teach nothing; of
several labels of a document the highest counts. Extra columns pass through unless they are named like the added ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, map_arrow, released, text_bytes, unused, written

LABELLED = 20_000
#: Lengths of the beginnings of words that patterns look at.
HEADS = (3, 4, 5, 6, 7)
#: What an item needs to get a vote: toxic documents of the sample, share of its documents that are toxic, log-likelihood ratio.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.7, 6.0
#: Voters of each kind, and the penalty on the classifier's weights.
VOTERS, PENALTY = 12, 0.005
#: Items that a worker counts before it hands its counts on.
COUNTED = 25_000
PREDICT_AT = 0.7

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    items: dict[str, int] = field(default_factory=dict)  # "=word" or "head*" -> column
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)  # voter -> how often it fires on toxic, on clean
    correlated: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def _items(text: str, most: dict[str, int] | None = None) -> set[str]:
    """What a text holds: its words and their beginnings; only those in ``most`` if that is given."""
    found = set()
    for w in set(_WORD.findall(text.lower())):
        for x in ("=" + w, *(w[:k] + "*" for k in HEADS if len(w) > k)):
            if most is None or x in most:
                found.add(x)
    return found


def _counts(sample: DataFrame, only: dict[str, int] | None = None) -> DataFrame:
    """item and number of the documents that hold it; of the items in ``only`` if that is given."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("docs", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], schema=arrow)
            have.clear()
            return made

        for b in batches:
            for v in b.column(0):
                have.update(_items(v.as_py().decode("utf-8", "replace"), only))
                if len(have) >= COUNTED:
                    yield counted()
        if have:
            yield counted()

    return sample.select("text").mapInArrow(released(run), schema).groupBy("item").agg(F.sum("docs").alias("docs"))


def _ratio(p: int, n: int, share: float) -> float:
    """How much likelier the marks of an item's documents are at its own share than at the common one."""
    own = p / (p + n)
    return p * math.log(own / share) + (n * math.log((1 - own) / (1 - share)) if n else 0.0) if own > share else 0.0


def mine(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """The items that stand out in toxic documents, words and patterns, best first; no pattern that a shorter one covers.

    Items are counted in the toxic documents of the sample; those in LEAST_DOCS of them, whose number the sample bounds, are then counted in
    the clean ones. A pattern is covered where one that it begins with
    ranks before it: that one is kept, or is covered itself by a still shorter one.
    """
    found = {r.item: r.docs for r in _counts(sample.where("toxic = 1")).where(F.col("docs") >= LEAST_DOCS).collect()}
    other = {r.item: r.docs for r in _counts(sample.where("toxic = 0"), found).collect()}
    share, ratio = toxic / (toxic + clean), {}
    for x, p in found.items():
        n = other.get(x, 0)
        if p >= LEAST_SHARE * (p + n) and (r := _ratio(p, n, share)) >= LEAST_RATIO:
            ratio[x] = r
    covered = lambda x: x[0] != "=" and any(ratio.get(x[:k] + "*", -1.0) >= ratio[x] for k in HEADS if k < len(x) - 1)
    return sorted((x for x in ratio if not covered(x)), key=lambda x: (-ratio[x], len(x), x))


class Hits:
    """Which items rows hold: a sparse matrix of ones."""

    def __init__(self, rows: list[list[int]], items: int):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.item = np.array([i for r in rows for i in r], np.int64)
        self.items = items

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each row the sum of its items' values."""
        return np.bincount(self.row, weights=w[self.item], minlength=len(self.sizes))

    def sums(self, g: np.ndarray) -> np.ndarray:
        """For each item the sum of its rows' values."""
        return np.bincount(self.item, weights=g[self.row], minlength=self.items)


def votes(hits: Hits, items: list[str]) -> tuple[np.ndarray, list[str]]:
    """Documents x voters: whether each voter fires. Items are dealt to the voters of their kind in turn."""
    groups: dict[str, int] = {}
    turn: Counter[str] = Counter()
    own = np.zeros(len(items), np.int64)
    for i, x in enumerate(items):
        kind = "lexicon" if x[0] == "=" else "pattern"
        own[i] = groups.setdefault(f"{kind} {turn[kind] % VOTERS}", len(groups))
        turn[kind] += 1
    fired = np.zeros((len(hits.sizes), len(groups)), bool)
    fired[hits.row, own[hits.item]] = True
    return np.hstack([fired, *((hits.sizes >= k)[:, None] for k in (1, 2, 4))]).astype(float), [*groups, "1 hit", "2 hits", "4 hits"]


def label_model(v: np.ndarray, prior: float, start: np.ndarray, times: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes, which stands ``times`` times (once if None); how often the voters fire on toxic, on clean; their correlations.

    A voter's log-odds are divided by one plus the sum of its positive correlations with the others inside
    the classes, so that ten voters that always agree count about as one.
    """
    q = start.copy()
    t = np.ones(len(v)) if times is None else times
    fire1 = fire0 = np.zeros(v.shape[1])
    r = np.eye(v.shape[1])
    for _ in range(rounds):
        fire1 = ((t * q) @ v + 0.5) / ((t * q).sum() + 1)
        fire0 = ((t * (1 - q)) @ v + 0.05) / ((t * (1 - q)).sum() + 1)
        z = q[:, None] * (v - fire1) + (1 - q)[:, None] * (v - fire0)
        z *= np.sqrt(t / t.sum())[:, None]
        s = np.sqrt((z * z).sum(axis=0)) + 1e-9
        r = (z.T @ z) / np.outer(s, s)
        thin = 1 / (1 + np.clip(r - np.eye(len(r)), 0, None).sum(axis=1))
        on, off = np.log(fire1 / fire0) * thin, np.log((1 - fire1) / (1 - fire0)) * thin
        odds = math.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    return q, fire1, fire0, r


def _logistic(hits: Hits, y: np.ndarray, times: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights (of the items, the logarithm of their number, whether there is one) and bias for soft labels of rows that stand ``times``
    times, by accelerated gradient steps."""
    extra = np.stack([np.log1p(hits.sizes), hits.sizes > 0, np.ones(len(y))], axis=1)
    n, total = hits.items, float(times.sum())
    forward = lambda w: hits.times(w[:n]) + extra @ w[n:]
    backward = lambda g: np.concatenate([hits.sums(g), extra.T @ g])
    v = np.ones(n + 3)
    for _ in range(50):  # the largest curvature, by the power method
        v = backward(times * forward(v / np.linalg.norm(v)))
    shrink = np.append(np.full(n + 2, penalty / total**0.5), 0.0)
    step = 4 / (1.05 * np.linalg.norm(v) / total + 4 * shrink[0])
    w = u = np.zeros(n + 3)
    for k in range(rounds):
        g = backward(times * (1 / (1 + np.exp(-np.clip(forward(u), -30, 30))) - y)) / total + shrink * u
        new = u - step * g
        u = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """A model from labelled documents. ``docs``: doc_id, text; ``labels``: doc_id, toxic (1 or 0)."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` rows of 12 bytes: safe to broadcast
    sample = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(marks), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # of several rows the least text
    sample = written(sample, "toxic-sample")
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    items = mine(sample, toxic, clean) if toxic and clean else []
    share = (toxic + 0.5) / (toxic + clean + 1) if toxic else 0.0
    if not items:
        return Model(bias=math.log(share / (1 - share)) if 0 < share < 1 else -30.0)
    index = {x: i for i, x in enumerate(items)}
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("hit", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(index[x] for x in _items(v.as_py().decode("utf-8", "replace"), index)) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], schema=to_arrow_schema(schema))

    rows = sample.select(F.col("toxic").cast("int"), "text").mapInArrow(run, schema).groupBy("toxic", "hit").count().orderBy("toxic", "hit").collect()
    hits, times, marked = Hits([r.hit for r in rows], len(items)), np.array([r["count"] for r in rows], float), np.array([r.toxic for r in rows], float)
    v, names = votes(hits, items)
    q, fire1, fire0, r = label_model(v, share, 0.05 + 0.9 * marked, times)
    w, b = _logistic(hits, q, times)
    return Model(index, w, b, {n: (float(x), float(y)) for n, x, y in zip(names, fire1, fire0, strict=True)}, r)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from PREDICT_AT on); replaces nothing but columns of these names."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.items)
        for b in batches:
            odds = []
            for v in b.column(len(keep)):
                hit = [model.items[x] for x in _items(v.as_py().decode("utf-8", "replace"), model.items)] if n else []
                extra = model.weights[n] * math.log1p(len(hit)) + model.weights[n + 1] if hit else 0.0
                odds.append(model.bias + float(model.weights[hit].sum()) + extra if hit else model.bias)
            made = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(made)], schema=arrow)

    scored = map_arrow(docs.select(*map(column, keep), text_bytes(text).alias(unused(keep, "raw")[0])), released(run), schema)
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
