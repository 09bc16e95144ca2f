"""An approximate index of a collection's vectors, kept as tables of the store.

The collection's unit vectors are dealt to cells by their nearest centre, and what is left of each (its residual) is written as product-quantised codes: one byte for
each of ``PARTS`` parts of the vector. A search reads the cells nearest to the query from files ordered by cell, ranks their codes by table look-ups,
takes the best ``refine`` * k of them, looks their vectors up and scores those exactly. Centres and code books are learned from a bounded sample;
every vector of the collection is in the index. ``maintain`` brings the codes after a transaction's writes, so inserts, changes and tombstones are visible
together with the vectors. The exact scan (``operators.vector.top_k``) stays and is the default.

Vectors without a length (null, empty, all zero) and those of another length than the centres are in cell -1, which every search reads; they are scored exactly
as the scan does, after all others: they have no direction, so they rank behind any likeness above 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.operators import vector
from spindrift.operators.store import FILE_ROWS, Snapshot, Store, Transaction

#: Vectors that centres are learned from, most cells, parts of a code, centres of a part, rounds of learning.
SAMPLE, MOST_CELLS, PARTS, CENTRES, ROUNDS = 65_536, 4096, 16, 256, 10
#: Codes of so many times k are looked up and scored exactly.
REFINE = 10
ENCODED = T.StructType([T.StructField("id", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())])


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have ``d`` components and a length, and where those rows are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == d)
    values = column.take(pa.array(fit)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
    length = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return (values[good] / length[good, None]).astype(np.float32), fit[good]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre with the least distance for each row."""
    half, out = (centres * centres).sum(axis=1) / 2, np.empty(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (x[lo : lo + 4096] @ centres.T - half).argmax(axis=1)
    return out


def _learn(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """At most ``n`` centres of the rows (Lloyd's rounds); a centre that nobody is nearest to takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(n, len(x))]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(counts == 0)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
        if len(empty):
            far = ((x - centres[at]) ** 2).sum(axis=1)
            centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]][: len(empty)]
    return centres


@dataclass(frozen=True)
class Codec:
    """Centres of the cells, and of the parts of residuals."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    @staticmethod
    def learn(sample: np.ndarray, cells: int, parts: int = PARTS, seed: int = 7) -> Codec:
        centres = _learn(sample, cells, seed)
        rest = sample - centres[_nearest(sample, centres)]
        return Codec(centres, [_learn(np.ascontiguousarray(p), CENTRES, seed + i) for i, p in enumerate(np.array_split(rest, min(parts, sample.shape[1]), axis=1), 1)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (a byte for each part) of unit vectors."""
        cells = _nearest(x, self.centres)
        rest = np.array_split(x - self.centres[cells], len(self.books), axis=1)
        return cells, np.stack([_nearest(p, b) for p, b in zip(rest, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of a unit query with every cell's centre, and with every centre of every part."""
        parts = np.array_split(q, len(self.books))
        own = np.zeros((len(self.books), CENTRES), np.float32)
        for i, (p, b) in enumerate(zip(parts, self.books, strict=True)):
            own[i, : len(b)] = b @ p
        return self.centres @ q, own


def _encoded(vectors: DataFrame, codec: Codec) -> DataFrame:
    """ENCODED rows of (id, embedding)."""
    arrow = to_arrow_schema(ENCODED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, codes = np.full(len(b), -1, np.int32), [None] * len(b)
            x, at = _matrix(b.column(1), codec.dimension)
            if len(at):
                cells[at], own = codec.encode(x)
                for i, c in zip(at.tolist(), own, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells), pa.array(codes, pa.binary())], schema=arrow)

    return vectors.select("id", "embedding").mapInArrow(run, ENCODED)


def _sampled(vectors: DataFrame, n: int, sample: int) -> np.ndarray:
    """Unit vectors of at most about ``sample`` rows, chosen by hash of their ids; those of the most frequent length."""
    every = max(1, math.ceil(n / sample))
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * sample)
    size = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return _matrix(rows.select("embedding").toArrow().column(0), size.d)[0] if size else np.zeros((0, 0), np.float32)


def build(store: Store, collection: str, cells: int | None = None, parts: int = PARTS, sample: int = SAMPLE, seed: int = 7, file_rows: int = FILE_ROWS) -> int:
    """Learns and writes the index of a collection anew; returns its number of cells (0: there is nothing to learn from). ``cells``: by default the root of the number of vectors."""
    with store.transaction() as t:
        vectors = t.table("vectors").where(F.col("collection") == collection).select("id", "embedding")
        n = vectors.count()
        x = _sampled(vectors, n, sample)
        for table in ("vector_cells", "vector_books"):
            t.delete(table, F.col("collection") == collection)
        if not len(x):
            t.delete("vector_codes", F.col("collection") == collection)
            return 0
        codec = Codec.learn(x, cells or max(1, min(MOST_CELLS, round(math.sqrt(n)))), parts, seed)
        own = lambda rows, schema: store.spark.createDataFrame(rows, schema)
        t.upsert("vector_cells", own([(collection, i, c.tolist()) for i, c in enumerate(codec.centres)], "collection string, cell int, centre array<float>"))
        t.upsert("vector_books", own([(collection, i, b.tolist()) for i, b in enumerate(codec.books)], "collection string, part int, centres array<array<float>>"))
        old = t.table("vector_codes").where(F.col("collection") == collection).select("collection", "id")
        t.delete("vector_codes", old.join(vectors.select("id"), "id", "left_anti").select("collection", "id"))
        t.upsert("vector_codes", _encoded(vectors, codec).withColumn("collection", F.lit(collection)))
        t.compact("vector_codes", file_rows=file_rows)
        return len(codec.centres)


def load(at: Snapshot, collection: str) -> Codec | None:
    """The collection's codec, if it has an index."""
    cells = at.lookup("vector_cells", "collection", [collection]).orderBy("cell").select("centre").toArrow()
    if not cells.num_rows:
        return None
    books = at.lookup("vector_books", "collection", [collection]).orderBy("part").collect()
    return Codec(np.array(cells.column(0).to_pylist(), np.float32), [np.array(r.centres, np.float32) for r in books])


def maintain(t: Transaction, number: int) -> None:
    """Codes of the vectors that a transaction has written under ``number``, for the collections that have an index."""
    if not t.holds("vector_cells"):
        return
    known = [r.collection for r in t.table("vector_cells").select("collection").distinct().collect()]
    for collection in known:
        new = t.log("vectors").where((F.col("batch_seq") == number) & ~F.col("deleted") & (F.col("collection") == collection))
        t.upsert("vector_codes", _encoded(new.select("id", "embedding"), load(t, collection)).withColumn("collection", F.lit(collection)), number)


def candidates(at: Snapshot, codec: Codec, collection: str, query: Sequence[float], n: int, probes: int) -> DataFrame:
    """id and approximate score of the ``n`` best codes of the ``probes`` cells nearest to the query."""
    q = np.asarray(query, np.float32)
    q = q / max(float(np.sqrt((q * q).sum())), 1e-30)
    cell_scores, tables = codec.tables(q)
    read = np.argsort(-cell_scores, kind="stable")[:probes].tolist()
    parts = np.arange(len(codec.books))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.FloatType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(1).to_numpy()
            score = np.full(len(b), -2, np.float32)
            at = np.flatnonzero(cells >= 0)
            if len(at):
                codes = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                score[at] = cell_scores[cells[at]] + tables[parts, codes].sum(axis=1)
            best = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n]) if len(score) > n else np.arange(len(score))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(best)), pa.array(score[best])], schema=arrow)

    codes = at.lookup("vector_codes", "cell", [-1, *read]).where(F.col("collection") == collection)
    return codes.select("id", "cell", "code").mapInArrow(run, schema).orderBy(F.desc("score"), "id").limit(n)


def top_k(at: Snapshot, collection: str, query: Sequence[float], k: int, probes: int, refine: int = REFINE, codec: Codec | None = None) -> DataFrame:
    """id and exact score of (nearly) the ``k`` vectors nearest to ``query``; ties by id. Without an index, or for a query of another length or none, the exact scan."""
    codec = codec or load(at, collection)
    if codec is None or len(query) != codec.dimension or not any(query):
        return vector.top_k(at.table("vectors").where(F.col("collection") == collection).select("id", "embedding"), query, k)
    ids = [r.id for r in candidates(at, codec, collection, query, refine * k, probes).collect()]
    rows = at.lookup("vectors", "id", ids).where(F.col("collection") == collection)
    return vector.top_k(rows.select("id", "embedding"), query, k)
