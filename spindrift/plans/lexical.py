"""Lexical search: BM25 over block-compressed postings with impact bounds.

Documents are dealt to segments of some ``SEGMENT`` by hash, and only their texts are shuffled; a segment's postings are made where its texts are. A term's postings in a segment are one row, a
block: arrays of ids, counts and lengths, and its impact, the most that one of its documents can get from the term before the term's rarity is multiplied in. A file has the blocks of some
segments, ordered by term, so a query reads the pages that hold its terms; their bounds are read without the arrays.

A search adds up each segment's bounds, scores the most promising segments exactly, and takes the k-th best score as threshold: segments that can't reach it are skipped (max-score), the others
are scored exactly. The answer is that of scoring all documents; ``Found`` counts the blocks that were read and skipped.

Null and empty texts have no terms and are never found; they count as documents. Terms are runs of a-z and 0-9 of the lower-cased text, those of a query count once. Ties go to smaller ids.
Of rows that repeat an id each is a document of its own in counts and lengths, and their scores add up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.functions import models

K1, B = 1.2, 0.75
#: Documents of a segment, give or take the hash; segments that give the threshold.
SEGMENT, FIRST = 256, 16
#: Terms of the texts of a task that makes blocks, give or take the hash; postings that it holds.
PART_TERMS, HELD = 4_000_000, 1 << 17
PREFIX = "bm25:"
_TERM = re.compile("[a-z0-9]+")


def terms_of(text: str) -> list[str]:
    """The distinct terms of a query."""
    return sorted(set(re.findall(r"[a-z0-9]+", text.lower())))


def weight(n: Column | np.ndarray, length: Column | np.ndarray, average: float) -> Column | np.ndarray:
    """What a document gets from a term before its rarity."""
    return n * (K1 + 1) / (n + K1 * (1 - B + B * length / (average or 1.0)))


def rarity(documents: int, holders: int) -> float:
    return math.log(1 + (documents - holders + 0.5) / (holders + 0.5))


@dataclass(frozen=True)
class Index:
    """Postings under a folder; how many documents there are, and how many terms they have on average."""

    spark: SparkSession
    path: str
    documents: int
    average: float

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def rarities(self, terms: Sequence[str]) -> dict[str, float]:
        """Of the terms that some document has."""
        rows = self.blocks.where(F.col("term").isin(list(terms))).groupBy("term").agg(F.sum("documents").alias("n")).collect()
        return {r.term: rarity(self.documents, r.n) for r in rows}


@dataclass(frozen=True)
class Found:
    """id and score, best first; blocks of the query's terms, and how many of them were scored."""

    rows: DataFrame
    blocks: int
    read: int


def _lengths(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and terms of each batch of texts."""
    for f in frames:
        yield pa.RecordBatch.from_arrays([pa.array([f.num_rows], pa.int64()), pa.array([sum(len(_TERM.findall(x.as_py())) for x in f["t"])], pa.int64())], ["documents", "terms"])


def _blocks(average: float, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of texts that come segment by segment, by id; some segments are held at a time, of ``HELD`` postings or one."""

    def flat(docs: list[tuple], terms: list[str], counts: list[int]) -> pa.RecordBatch:
        ids, segments, sizes, lengths = zip(*docs, strict=True)
        coded = pa.array(terms, pa.string()).dictionary_encode()
        doc, n = np.repeat(np.arange(len(docs)), sizes), np.array(counts, np.int32)
        key = np.array(segments, np.int64)[doc] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # a block's postings stay by id
        key, doc, n = key[order], doc[order], n[order]
        length = np.array(lengths, np.int32)[doc]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        offsets = pa.array(np.append(begins, len(key)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(ids, schema.field("id").type.value_type).take(pa.array(doc)), pa.array(n), pa.array(length))]
        first = pa.array(order[begins])
        impacts = np.maximum.reduceat(weight(n, length, average), begins)
        told = [coded.take(first).cast(pa.string()), pa.array(np.array(segments, np.int32)[doc[begins]]), pa.array(impacts), pa.array(np.diff(np.append(begins, len(key))).astype(np.int32))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((*told, *lists), schema, strict=True)], schema=schema)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, terms, counts = [], [], []
        for f in frames:
            for segment, id, text in zip(f["segment"].to_pylist(), f["id"].to_pylist(), f["t"], strict=True):
                if len(terms) > HELD and segment != docs[-1][1]:
                    yield flat(docs, terms, counts)
                    docs, terms, counts = [], [], []
                words = _TERM.findall(text.as_py())
                if words:
                    own = Counter(words)
                    terms += own
                    counts += own.values()
                    docs.append((id, segment, len(own), len(words)))
        if docs:
            yield flat(docs, terms, counts)

    return run


def build(texts: DataFrame, path: str, id: str = "id", text: str = "text", segment: int = SEGMENT) -> Index:
    """Writes the postings of ``texts`` under ``path``."""
    spark = texts.sparkSession
    docs = texts.select(F.col(id).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    n, terms = docs.select("t").mapInArrow(_lengths, "documents long, terms long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms"))).first()
    average = terms / n if n else 0.0
    segments = max(1, math.ceil(n / segment))
    parts = max(1, min(segments, max(spark.sparkContext.defaultParallelism, math.ceil(terms / PART_TERMS))))
    dealt = docs.withColumn("segment", F.pmod(F.xxhash64("id"), F.lit(segments)).cast("int")).repartition(parts, "segment").sortWithinPartitions("segment", "id")
    kind = docs.schema["id"].dataType
    fields = [("term", T.StringType()), ("segment", T.IntegerType()), ("impact", T.DoubleType()), ("documents", T.IntegerType()), ("id", T.ArrayType(kind)), ("n", T.ArrayType(T.IntegerType())), ("length", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    blocks = dealt.mapInArrow(_blocks(average, to_arrow_schema(schema)), schema)
    blocks.sortWithinPartitions("term", "segment").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(n, average)], "documents long, average double").write.mode("overwrite").parquet(f"{path}/numbers")
    return Index(spark, path, n, average)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark, path, *spark.read.parquet(f"{path}/numbers").first())


def _scored(index: Index, rare: dict[str, float], blocks: DataFrame) -> DataFrame:
    """id and score of the documents of some blocks."""
    each = blocks.select("term", F.inline(F.arrays_zip("id", "n", "length")))
    own = F.create_map(*(F.lit(x) for pair in rare.items() for x in pair))[F.col("term")]
    return each.groupBy("id").agg(F.sum(own * weight(F.col("n"), F.col("length"), index.average)).alias("score"))


def search(index: Index, query: str, k: int, first: int = FIRST) -> Found:
    """The ``k`` documents with the best scores."""
    rare = index.rarities(terms_of(query))
    mine = index.blocks.where(F.col("term").isin(list(rare)))
    if not rare:
        return Found(index.blocks.select(F.explode("id").alias("id"), F.lit(0.0).alias("score")).limit(0), 0, 0)
    own = F.create_map(*(F.lit(x) for pair in rare.items() for x in pair))[F.col("term")]
    bounds = mine.groupBy("segment").agg(F.sum(own * F.col("impact")).alias("bound"), F.count(F.lit(1)).alias("blocks"))
    best = [r.segment for r in bounds.orderBy(F.desc("bound"), "segment").limit(first).collect()]
    tops = _scored(index, rare, mine.where(F.col("segment").isin(best))).orderBy(F.desc("score"), "id").limit(k).collect()
    least = tops[-1].score * (1 - 1e-9) if len(tops) == k else 0.0  # sums may differ in their last bits
    kept = bounds.where(F.col("bound") >= least)
    total, read = bounds.agg(F.sum("blocks"), F.sum(F.when(F.col("bound") >= least, F.col("blocks")))).first()
    rows = _scored(index, rare, mine.join(kept.select("segment"), "segment", "left_semi"))
    return Found(rows.orderBy(F.desc("score"), "id").limit(k), total, read or 0)


@dataclass(frozen=True)
class Bm25Reranker:
    """Scores of texts with the rarities and the average length of an index."""

    rare: dict[str, float]
    average: float

    def scores(self, query: str, texts: list[str]) -> list[float]:
        out, asked = [], terms_of(query)
        for text in texts:
            words = re.findall(r"[a-z0-9]+", text.lower())
            long = 1 - B + B * len(words) / (self.average or 1.0)
            counts = Counter(words)
            out.append(sum(self.rare[t] * n * (K1 + 1) / (n + K1 * long) for t in asked if t in self.rare and (n := counts[t])))
        return out


def use(spark: SparkSession, name: str | None, query: str) -> str | None:
    """Makes ``bm25:<path of an index>`` known as a reranker for a query, whose terms' rarities are looked up; other names are left alone. Returns the name to rerank with."""
    if not name or not name.startswith(PREFIX):
        return name
    index = load(spark, name.removeprefix(PREFIX))
    model = Bm25Reranker(index.rarities(terms_of(query)), index.average)
    own = f"{name}#{query}"
    models.RERANKERS[own] = lambda: model
    return own
