"""Line deduplication with a sharded minimal perfect hash.

Documents send the 128-bit hashes of their lines' keys, packed and counted by blocks, to shards dealt by hash. Each shard builds a
minimal perfect hash over its distinct line hashes, which indexes three compact arrays: fingerprints (64 bits), counts of documents,
and the largest doc_id; the counts are made in the arrays. Documents then send their lines' hashes, packed by shard, and probe the
arrays; no line text and no single line is joined. Lines that stand in more than one of ``HOT`` of all places (so fewer than ``HOT`` of
them, read from the arrays too) are told to the documents' own tasks instead, so no shard is asked for one line by all documents.

Null and empty texts are one empty line. Every row is a document; rows that share a doc_id share its fate (all keep the line if that
doc_id is the largest). A null doc_id is smaller than any other. Lines with short keys always stay. Extra columns pass through
``dedup`` unless they are named like an added column. doc_id is an integer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, map_arrow, mix, partitions, released, text_bytes, unused, written
from .shared import squeezed, unsqueezed

MIN_CHARS, MIN_DOCS = 20, 3
#: Line hashes of a shard and of a block, and bits of the perfect hash for each key of a level.
SHARD_KEYS, BLOCK_KEYS, GAMMA = 1 << 17, 1 << 19, 2
#: A line that has more than this share of all line hashes is hot.
HOT = 16384


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bits, each set where exactly one key fell."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        parts, sizes = [], []
        level = 0
        while len(keys):
            size = -(-GAMMA * len(keys) // 64) * 64
            at = PerfectHash._at(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
            level += 1
            if level > 100:
                raise ValueError("the keys of a perfect hash must be distinct")
        return PerfectHash(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key: 0 to n - 1 for the keys it was built with, anything or -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            bit = base + self._at(keys[open_], level, size)
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            w = self.words[word]
            hit = (w >> shift) & np.uint64(1) == 1
            low = np.bitwise_count(w & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[word] + low)[hit]
            open_ = open_[~hit]
            base += size
        return out


def _key(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    """What the perfect hash of a shard tells hashes apart by; the shard itself comes from h1 alone."""
    return h1 ^ mix(h2 + np.uint64(salt))


def _hashes(lines: list[bytes], min_chars: int) -> list[bytes]:
    """The 128-bit hashes of the distinct long keys of the lines."""
    import xxhash

    digest, strip = xxhash.xxh3_128_digest, bytes.strip
    keys = {k.lower() for k in map(strip, lines) if len(k) >= min_chars}
    return [digest(k) for k in keys if k.isascii() or len(k.decode("utf-8", "replace")) >= min_chars]


def line_hashes(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and ``hashes``: the 128-bit hashes of the document's distinct keys, in one binary."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("hashes", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [b"".join(_hashes(v.as_py().split(b"\n"), min_chars)) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], schema=arrow)

    return docs.select("doc_id", text_bytes(text).alias("text")).mapInArrow(run, schema)


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(h1, h2, doc_ids, whether null) of blocks of doc_id, hashes; null doc_ids are the least number."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for b in batches:
        rows = b.column(1).to_pylist()
        sizes = np.array([len(r) // 16 for r in rows], np.int64)
        pairs = np.frombuffer(b"".join(rows), np.uint64).reshape(-1, 2)
        ids = b.column(0).cast(pa.int64())
        null = np.repeat(ids.is_null().to_numpy(zero_copy_only=False), sizes)
        held.append((pairs[:, 0], pairs[:, 1], np.repeat(ids.fill_null(_LEAST).to_numpy(zero_copy_only=False), sizes), null))
        n += len(pairs)
        if n >= BLOCK_KEYS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


_LEAST = -(1 << 63)


def _cuts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new combination of the arrays begins."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


ARRAYS = ("words", "sizes", "prints", "counts", "lasts")
INDEX = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("salt", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ARRAYS), T.StructField("hot", T.BinaryType())])


def build_index(hashes: DataFrame, shards: int, total: int) -> DataFrame:
    """INDEX rows, one for each shard with lines; ``hot``: h1, h2, count and last of the lines with more than a share of 1 / HOT of ``total`` hashes."""
    sent = T.StructType([T.StructField("shard", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("h1", "h2", "counts", "lasts"))])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, ids, _ in _read(batches):
            shard = _shard(h1, shards)
            order = np.lexsort((h2, h1, shard))
            h1, h2, ids, shard = h1[order], h2[order], ids[order], shard[order]
            at = _cuts(h1, h2)
            columns = h1[at], h2[at], np.diff(np.append(at, len(h1))).astype(np.uint32), np.maximum.reduceat(ids, at)
            own = _cuts(shard[at])
            parts = [[squeezed(c[lo:hi]) for lo, hi in zip(own.tolist(), [*own[1:].tolist(), len(at)], strict=True)] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(shard[at][own].astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)], schema=to_arrow_schema(sent))

    def build(table: pa.Table) -> pa.Table:
        h1, h2, n, last = (unsqueezed(table.column(c), t) for c, t in (("h1", np.uint64), ("h2", np.uint64), ("counts", np.uint32), ("lasts", np.int64)))
        order = np.lexsort((h2, h1))
        distinct = order[_cuts(h1[order], h2[order])]
        salt = 0
        while len(np.unique(key := _key(h1[distinct], h2[distinct], salt))) < len(distinct):
            salt += 1  # two hashes with one key: other keys
        function = PerfectHash.build(key)
        at = function.index(_key(h1, h2, salt))
        prints, counts, lasts = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.int64), np.full(len(distinct), _LEAST)
        prints[at] = h2
        np.add.at(counts, at, n)
        np.maximum.at(lasts, at, last)
        hot = distinct[counts[at[distinct]] * HOT > total]
        told = np.stack([h1[hot].view(np.int64), h2[hot].view(np.int64), counts[at[hot]], lasts[at[hot]]], axis=1) if len(hot) else np.zeros((0, 4), np.int64)
        arrays = (function.words, function.sizes, prints, np.minimum(counts, 0xFFFFFFFF).astype(np.uint32), lasts, told)
        return pa.table([table.column("shard").slice(0, 1), pa.array([salt], pa.int64()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays)], schema=to_arrow_schema(INDEX))

    return hashes.mapInArrow(deal, sent).groupBy("shard").applyInArrow(build, INDEX)


def _dropped(ids: np.ndarray, null: np.ndarray, h1: np.ndarray, h2: np.ndarray, drop: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
    """doc_id and the hashes that its document has to drop; the input is in order of documents."""
    ids, null = ids[drop], null[drop]
    raw = np.stack([h1[drop], h2[drop]], axis=1).tobytes()
    cuts = _cuts(ids, null)
    parts = [raw[lo:hi] for lo, hi in zip((cuts * 16).tolist(), (np.append(cuts[1:], len(ids)) * 16)[: len(cuts)].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids[cuts], mask=null[cuts]).cast(id_type), pa.array(parts, pa.binary())], names=["doc_id", "dropped"])


def probe(hashes: DataFrame, index: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and ``dropped`` (hashes in one binary) for documents and shards with lines that the document has to drop."""
    found = [np.frombuffer(r.hot, np.int64).reshape(-1, 4) for r in index.where(F.octet_length("hot") > 0).select("hot").collect()]  # fewer than HOT lines
    hot = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    hot = hot[np.argsort(hot[:, 0].view(np.uint64), kind="stable")]
    out = T.StructType([T.StructField("doc_id", hashes.schema["doc_id"].dataType), T.StructField("dropped", T.BinaryType())])
    id_type = to_arrow_schema(out).field(0).type
    packed = T.StructType([T.StructField("shard", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("h1", "h2", "docs", "null"))])

    def is_hot(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each hash among the hot ones, -1 where it is none."""
        at = np.full(len(h1), -1)
        keys = np.ascontiguousarray(hot[:, 0]).view(np.uint64)
        lo, hi = np.searchsorted(keys, h1, side="left"), np.searchsorted(keys, h1, side="right")
        for i in np.flatnonzero(hi > lo) if (hi - lo).max(initial=0) > 1 else ():  # hot lines that share half of their hashes
            at[i] = next((k for k in range(lo[i], hi[i]) if np.uint64(hot[k, 1] & 0xFFFFFFFFFFFFFFFF) == h2[i]), -1)
        if (hi - lo).max(initial=0) <= 1 and len(keys):
            same = (hi > lo) & (hot[np.minimum(lo, len(keys) - 1), 1].view(np.uint64) == h2)
            at[same] = lo[same]
        return at

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, ids, null in _read(batches):
            at = is_hot(h1, h2)
            drop = (at >= 0) & (hot[np.maximum(at, 0), 2] >= min_docs) & (hot[np.maximum(at, 0), 3] != ids) if len(hot) else np.zeros(len(h1), bool)
            yield _dropped(ids, null, h1, h2, drop, id_type)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, ids, null in _read(batches):
            rest = np.flatnonzero(is_hot(h1, h2) < 0)
            shard = _shard(h1[rest], shards)
            order = rest[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            own = _cuts(shard)
            ends = [*own[1:].tolist(), len(shard)][: len(own)]
            parts = [[squeezed(c[order[lo:hi]]) for lo, hi in zip(own.tolist(), ends, strict=True)] for c in (h1, h2, ids, null)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[own].astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)], schema=to_arrow_schema(packed))

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    asked = hashes.mapInArrow(deal, packed).select("shard", F.lit(1).alias("kind"), "h1", "h2", "docs", "null", F.lit(0).cast("long").alias("salt"), *none(*ARRAYS))
    blobs = index.select("shard", F.lit(0).alias("kind"), *none("h1", "h2", "docs", "null"), "salt", *ARRAYS)
    tasks = max(partitions(hashes.sparkSession), min(shards, 1 << 15))
    both = blobs.unionByName(asked).repartition(tasks, "shard").sortWithinPartitions("shard", "kind")

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, salt, function, prints, counts, lasts = None, 0, None, None, None, None
        for b in batches:
            for i, (shard, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                one = lambda c, i=i, b=b: b.column(b.schema.get_field_index(c))[i]
                if kind == 0:
                    words, sizes, prints, counts, lasts = (np.frombuffer(one(c).as_py(), t) for c, t in zip(ARRAYS, (np.uint64, np.int64, np.uint64, np.uint32, np.int64), strict=True))
                    held, salt, function = shard, one("salt").as_py(), PerfectHash(words, sizes)
                elif held == shard:
                    h1, h2, ids, null = (unsqueezed([one(c)], t) for c, t in (("h1", np.uint64), ("h2", np.uint64), ("docs", np.int64), ("null", bool)))
                    at = function.index(_key(h1, h2, salt))
                    safe = np.maximum(at, 0)
                    drop = (at >= 0) & (prints[safe] == h2) & (counts[safe] >= min_docs) & (lasts[safe] != ids)
                    yield _dropped(ids, null, h1, h2, drop, id_type)

    answers = both.mapInArrow(answer, out)
    return answers.union(hashes.mapInArrow(tell, out)) if len(hot) else answers


def dedup(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines dropped from ``text`` (bytes that are kept, as string), and n_lines and n_dropped."""
    hashes = written(line_hashes(docs, text, min_chars).where(F.octet_length("hashes") > 0), "line-hashes")
    total = (hashes.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 16
    shards = max(1, -(-total // SHARD_KEYS))
    index = written(build_index(hashes, shards, total), "line-index")
    # rows that share a doc_id ask for the same, so a set of the answers
    found = probe(hashes, index, shards, min_docs).groupBy("doc_id").agg(F.collect_set("dropped").alias("dropped"))
    keep = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    raw, asked, gone = unused(docs.columns, "raw", "asked", "gone")
    kept = [column(c) for c in keep]
    both = docs.select(*kept, text_bytes(text).alias(raw)).join(found.toDF(asked, gone), F.col("doc_id").eqNullSafe(F.col(asked)), "left").select(*kept, raw, gone)
    added = [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            texts, lines, gone = [], [], []
            for value, drop in zip(b.column(len(keep)), b.column(len(keep) + 1), strict=True):
                raw, dropped = value.as_py(), drop.as_py()
                parts = raw.split(b"\n")
                lines.append(len(parts))
                if dropped:
                    hashes_ = {d[i : i + 16] for d in dropped for i in range(0, len(d), 16)}
                    parts = [p for p in parts if len(k := p.strip()) < min_chars or digest(k.lower()) not in hashes_]
                    raw = b"\n".join(parts)
                gone.append(lines[-1] - len(parts))
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], schema=arrow)

    return map_arrow(both, released(run), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    kept = dedup(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for ``digests``.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),  -- every row is a document
lines AS (
  SELECT r, doc_id, i, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i
        FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM docs))),
keys AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
marked AS (SELECT d.r, d.doc_id, i, l, k.k IS NOT NULL AND d.doc_id IS DISTINCT FROM k.last AS gone FROM lines d LEFT JOIN keys k ON d.k = k.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
