"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers; a component is a term, its non-zero values are the term's postings. Queries and
candidates are dealt to blocks; in each pair of blocks every query scatters its weighted postings, term by term, into a dense
array of scores, a partition selects the best, and the blocks' best are merged by rank. Every query meets every
candidate once; no block holds more than ``QUERIES`` or ``CANDIDATES`` vectors (give or take the hash), whatever the size of the tables.

Vectors that are null, or hold null or non-finite components, and rows without id take no part; nor do vectors
of d components with one whose scaled magnitude is 2**31 / sqrt(2 * d) or more: sums of the others are exact in 64 bits. Of rows that repeat an id
the least vector stands for it. Vectors of different lengths meet in their common components. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

QUERIES, CANDIDATES = 4096, 4096
RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and ``q``: floor(scale * component) of every vector that takes part."""
    most = F.lit(2.0**31) / F.sqrt(2.0 * F.greatest(F.size(vector), F.lit(1)))  # then no product of two overflows; infinity is beyond
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) < most))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).where(good)
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    return rows.select(F.col(id).cast("long").alias("vec_id"), q.alias("q")).groupBy("vec_id").agg(F.min("q").alias("q"))


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values, ends = column.flatten().to_numpy().astype(np.int64), np.cumsum(column.value_lengths().to_numpy())
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    return out


def best_of_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The ``k`` best candidates of a block for each query of a block; ties go to smaller ids."""
    ids = candidates.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, dense = ids[order], _dense(candidates.column("q"))[order]
    postings = []
    for t in range(dense.shape[1]):
        at = np.flatnonzero(dense[:, t])
        postings.append((at, dense[at, t]))
    del dense
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    asked = queries.column("vec_id").to_numpy()
    for me, row in zip(asked.tolist(), _dense(queries.column("q")), strict=True):
        scores = np.zeros(len(ids), np.int64)
        for t in np.flatnonzero(row[: len(postings)]):
            at, weight = postings[t]
            scores[at] += row[t] * weight
        others = np.flatnonzero(ids != me)
        own = scores[others]
        if len(others) > k:
            least = np.partition(own, len(own) - k)[len(own) - k]
            above, equal = np.flatnonzero(own > least), np.flatnonzero(own == least)
            picked = np.concatenate([above, equal[: k - len(above)]])
        else:
            picked = np.arange(len(others))
        found.append((np.full(len(picked), me), ids[others[picked]], own[picked]))
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=to_arrow_schema(RESULT))


def top_k(vectors: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best ``vectors`` for each row of ``asked`` (both: vec_id, q)."""
    vectors, asked = written(vectors, "topk-vectors"), written(asked, "topk-queries")
    blocks = lambda df, size: max(1, math.ceil(df.count() / size))
    n, m = blocks(vectors, CANDIDATES), blocks(asked, QUERIES)
    of = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.withColumn("b", of(m, 1)).withColumn("c", each(n))
    right = vectors.withColumn("c", of(n, 2)).withColumn("b", each(m))
    cell = lambda q, c: best_of_block(q, c, k)
    pairs = left.select("b", F.col("c").cast("long").alias("c"), "vec_id", "q").groupBy("b", "c").cogroup(
        right.select(F.col("b").cast("long").alias("b"), "c", "vec_id", "q").groupBy("b", "c")
    ).applyInArrow(cell, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the registered query.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(q) AS w, generate_subscripts(q, 1) AS i FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.w * b.w) AS BIGINT) AS score
      FROM t a JOIN t b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
