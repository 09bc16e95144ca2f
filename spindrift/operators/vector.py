"""Vector operators: exact cosine top-k, pooling of chunk hits, merging of collections."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Weights of a changelist's two scores when both collections find it.
METADATA_WEIGHT, DIFF_WEIGHT = 0.6, 0.4


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine likeness, clamped to 0..1; 0 where a vector has no length."""
    norms = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id: str = "id", vector: str = "embedding") -> DataFrame:
    """id and score of the ``k`` vectors nearest to ``query``; ties by id.

    A pass over the vectors with numpy on Arrow batches that keeps each batch's own best rows, then one sort of those: the
    shuffle is k rows a batch, whatever the table's size. Rows without a vector score 0.
    """
    q = np.asarray(query, np.float64)
    schema = T.StructType([vectors.schema[id], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    length = float(np.sqrt((q * q).sum()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            sizes = column.fill_null([]).value_lengths().to_numpy()
            if len(sizes) and (sizes == len(q)).all() and len(q):
                m = column.flatten().to_numpy().astype(np.float64).reshape(-1, len(q))
            else:  # vectors of other lengths count as far as they go
                m = np.zeros((len(sizes), len(q)))
                for i, v in enumerate(column.to_pylist()):
                    m[i, : len(v or [])] = (v or [])[: len(q)]
            norms = np.sqrt((m * m).sum(axis=1)) * length
            score = np.clip(np.divide((m * q).sum(axis=1), norms, out=np.zeros(len(m)), where=norms > 0), 0, 1)
            # more than k rows only where the last place is tied; the sort below settles ties by id
            best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
            at = pa.array(best)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(score[best])], schema=arrow)

    near = vectors.select(id, vector).mapInArrow(run, schema)
    return near.orderBy(F.desc("score"), id).limit(k)


def top_k_native(vectors: DataFrame, query: Sequence[float], k: int, id: str = "id", vector: str = "embedding") -> DataFrame:
    """The same as one expression, for small tables: no Python worker, TakeOrderedAndProject."""
    return vectors.select(id, cosine(F.col(vector), literal(query)).alias("score")).orderBy(F.desc("score"), id).limit(k)


def parent_of_diff(id: Column) -> Column:
    """The changelist of a diff chunk's vector: what stands before the first ``_chunk_``."""
    return F.split_part(id, F.lit("_chunk_"), F.lit(1))


def parent_of_file(id: Column) -> Column:
    """The file of a file chunk's vector, with its prefix: what stands before the first ``:chunk_``."""
    return F.split_part(id, F.lit(":chunk_"), F.lit(1))


def pooled(hits: DataFrame) -> DataFrame:
    """The best chunk of each result: result_id, score, vector_id. Of equal scores the smaller vector_id, as the scan ranks it."""
    best = F.max(F.struct("score", (-F.col("rank")).alias("r"), "vector_id"))
    ranked = hits if "rank" in hits.columns else hits.withColumn("rank", F.row_number().over(Window.partitionBy("result_id").orderBy(F.desc("score"), "vector_id")))
    return ranked.groupBy("result_id").agg(best.alias("b")).select("result_id", "b.score", "b.vector_id")


def merged(metadata: DataFrame, diffs: DataFrame, w_metadata: float = METADATA_WEIGHT, w_diff: float = DIFF_WEIGHT) -> DataFrame:
    """Scores of changelists from both collections: the weighted sum where both found one, else its only score.

    source and vector_id come from the side with the higher score; metadata on ties, and its hits have no vector_id.
    """
    m = metadata.select("result_id", F.col("score").alias("m"))
    d = diffs.select("result_id", F.col("score").alias("d"), "vector_id")
    both = m.join(d, "result_id", "full_outer")
    by_diff = F.col("m").isNull() | (F.col("d") > F.col("m"))
    score = F.when(F.col("m").isNotNull() & F.col("d").isNotNull(), w_metadata * F.col("m") + w_diff * F.col("d")).otherwise(F.coalesce("m", "d"))
    return both.select(
        "result_id",
        score.alias("score"),
        F.when(by_diff, "diff").otherwise("metadata").alias("source"),
        F.when(by_diff, F.col("vector_id")).alias("vector_id"),
    )


def file_scores(hits: DataFrame, pooling: str = "last") -> DataFrame:
    """One score for each file: of its chunks' hits the last and so least (``last``), or the best (``max``)."""
    if pooling not in ("last", "max"):
        raise ValueError(f"unknown pooling {pooling!r}")
    # the scan ranks by falling score, then by rising id
    ranked = hits if "rank" in hits.columns else hits.withColumn("rank", F.row_number().over(Window.partitionBy("result_id").orderBy(F.desc("score"), "vector_id")))
    row = F.struct("score", "vector_id")
    pick = F.max_by(row, "rank") if pooling == "last" else F.min_by(row, "rank")
    return ranked.groupBy("result_id").agg(pick.alias("b")).select("result_id", "b.score", "b.vector_id")
