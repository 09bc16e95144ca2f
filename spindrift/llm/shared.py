"""Which keys stand in more than one place: the screen that the text operators share; and word hashes.

Mappers pack their keys into blocks by ranges of the key, combine equal keys within a block (only the first of them
travels to the key's bucket, the rest is known to repeat and passes), and each bucket finds the keys that came from
several blocks. A key that stands everywhere costs one entry a block, never a row for each place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import flat, give_back, mix, released, row_chunks, text_bytes

#: Entries of a block, entries of a bucket, bytes of texts that are worked on at a time.
BLOCK_KEYS, BUCKET_KEYS, PIECE_BYTES = 1 << 19, 1 << 19, 1 << 20

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys (uint64), doc_ids (int64), places (int64)

_U = np.uint64
_BASE = 0x9E6C63D0876A9A99 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """The bytes of an array, compressed for their way: shuffles' own compression leaves packed integers nearly as they are.

    Integers go byte plane by byte plane, so that the zeros of their high bytes meet; ``rising`` ones as the steps between them.
    """
    import zstandard

    if rising and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    if values.itemsize > 1:
        values = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.compress(values.tobytes(), 1)


def unsqueezed(parts: Iterable[pa.Scalar], dtype: type | np.dtype, rising: bool = False) -> np.ndarray:
    """The arrays of a column, one after the other."""
    import zstandard

    size, out = np.dtype(dtype).itemsize, []
    for v in parts:
        raw = np.frombuffer(zstandard.decompress(v.as_py()), np.uint8)
        if size > 1:
            raw = np.ascontiguousarray(raw.reshape(size, -1).T)
        values = raw.reshape(-1).view(dtype)
        out.append(np.cumsum(values, dtype=dtype) if rising else values)
    return np.concatenate(out) if out else np.zeros(0, dtype)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = []
            for base in (_BASE, _INVERSE):
                x = np.full(max(n, 1 << 16), base, _U)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            self.up, self.down = both
        return self.up, self.down


_powers = _Powers()


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of ``values`` (unsigned integers), the same for equal slices wherever they stand."""
    up, down = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, _U)
    total[0] = 0
    np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words of the texts; first[i] is the number of words before text i."""
    space = _SPACES[raw]
    n = len(raw)
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pieces(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of pieces of the batches, cut by the binary column."""
    for b in batches:
        raw, offsets = flat(b.column(column))
        for lo, hi in row_chunks(offsets, PIECE_BYTES):
            yield b.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text). A text longer than a piece is read in parts that end with a word."""
    if len(offsets) == 2 and len(raw) > 2 * PIECE_BYTES:
        parts, lo = [], 0
        while lo < len(raw):
            hi = min(lo + PIECE_BYTES, len(raw))
            while hi < len(raw) and not _SPACES[raw[hi]]:
                ahead = np.flatnonzero(_SPACES[raw[hi : hi + PIECE_BYTES]])
                hi = hi + int(ahead[0]) if len(ahead) else min(hi + PIECE_BYTES, len(raw))
            parts.append(_word_hashes(raw[lo:hi], np.array([0, hi - lo]), lower)[0])
            lo = hi
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    return _word_hashes(raw, offsets, lower)


def _word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(raw, offsets)
    return rolling(_LOWER[raw] if lower else raw, starts, ends), first


def unique_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(main, rest): doc_id and text (bytes). main has every doc_id once, none null; rest has the other rows, None if there are none.

    Of rows that repeat a doc_id the one with the least text is in main.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if again.isEmpty():
        return rows, None
    named = rows.where("doc_id is not null").withColumn("again", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    rest = named.where("again > 1").drop("again").unionByName(rows.where("doc_id is null"))
    return named.where("again = 1").drop("again"), rest


def buckets_for(docs: DataFrame, bytes_per_key: float) -> int:
    """How many buckets the keys of all texts need."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -int(-total / bytes_per_key // BUCKET_KEYS))


BLOCKS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("known", T.BooleanType()), *(T.StructField(c, T.BinaryType()) for c in ("keys", "many", "docs", "places"))]
)
PLACES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType())])


#: Keys only sift, so their low bits can stay at home: at 10 ** 13 keys still some four of a hundred are taken for another.
_SENT = _U(~((1 << 16) - 1) & (1 << 64) - 1)


def _block(entries: list[Entries], buckets: int) -> pa.RecordBatch:
    keys, docs, places = (np.concatenate([e[i] for e in entries]) for i in range(3))
    keys = keys & _SENT
    order = np.argsort(keys)
    keys, docs, places = keys[order], docs[order], places[order]
    first = np.append(True, keys[1:] != keys[:-1])
    many = np.append(~first[1:], False)
    rows: list[list] = [[], [], [], [], [], []]
    for known, mask in ((False, first), (True, ~first)):
        k, m, d, p = keys[mask], many[mask], docs[mask], places[mask]
        if known:  # without keys: in the order that packs best
            by = np.lexsort((p, d))
            d, p = d[by], p[by]
        edges = [-(-(i << 64) // buckets) for i in range(1, buckets)]
        cuts = np.concatenate([[0], np.searchsorted(k, np.array(edges, _U)), [len(k)]]) if not known else np.linspace(0, len(k), buckets + 1).astype(int)
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if hi > lo:
                values = (i, known, squeezed(k[lo : 0 if known else hi], rising=True), squeezed(m[lo : 0 if known else hi]), squeezed(d[lo:hi], rising=known), squeezed(p[lo:hi]))
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
    schema = to_arrow_schema(BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


def repeated_places(docs: DataFrame, keys: Callable[[Iterable[pa.RecordBatch]], Iterator[Entries]], buckets: int) -> DataFrame:
    """doc_id and place of every key that stands in another place as well. ``docs``: doc_id, text (bytes)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for entry in keys(batches):
            held.append(entry)
            n += len(entry[0])
            if n >= BLOCK_KEYS:
                yield _block(held, buckets)
                held, n = [], 0
        if n:
            yield _block(held, buckets)

    def find(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        join = lambda c, mask, t, rising=False: unsqueezed(table.column(c).filter(pa.array(mask)), t, rising)
        k, many = join("keys", ~known, _U, True), join("many", ~known, bool)
        order = np.argsort(k)
        s = k[order]
        equal = s[1:] == s[:-1]
        again = np.zeros(len(k), bool)
        again[order] = np.append(equal, False) | np.append(False, equal)
        again |= many
        docs_, places = (np.concatenate([join(c, ~known, np.int64)[again], join(c, known, np.int64, c == "docs")]) for c in ("docs", "places"))
        out = pa.table([pa.array(docs_), pa.array(places)], schema=to_arrow_schema(PLACES))
        del k, many, order, s, equal, again
        give_back()
        return out

    return docs.mapInArrow(released(pack), BLOCKS).groupBy("bucket").applyInArrow(find, PLACES)
