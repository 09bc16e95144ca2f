"""Substring deduplication on bytes with a logarithmic family of suffix arrays.

``Family`` takes batches of text. A new batch is sorted into a suffix array (suffixes are ordered by their first
``depth`` bytes, all that a match of that length asks for), and its suffixes are searched for in the order of each existing level;
what the batch has new becomes a level. Levels of one size are merged, order into order, into one of twice the size,
so there are never more than a logarithm of the batches.

For a corpus, windows of 100 bytes are anchored at that of the 48-byte strings in them whose hash is least.
Anchors that stand in one place only rule out their windows; the other windows are dealt to buckets in runs that share the least 16-byte
string, and each bucket feeds its runs, in order of documents, to a family of its
own. What is a repeat is decided by the bytes alone (``repeats``).

``Index`` keeps the levels of all buckets as tables, and takes new documents batch by batch.

Null and empty texts have no bytes. For null and repeated doc_ids see ``repeats``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import mix
from .repeats import COVERED, HOT_WINDOWS, MADE, Runs, Scheme, blocks_of, covered_rows, cut_runs, finished, known_spans, read_runs, slices, windows_found, without_repeats
from .shared import PIECE_BYTES, unique_documents

WINDOW = 100
#: Bytes of an anchor that is looked for elsewhere, and of one by which windows are dealt.
GRAM, TRAVEL_GRAM = 48, 16
#: Windows of the runs that make a batch.
BATCH_WINDOWS = 1 << 18

_U = np.uint64
#: The low bits of a hash, which give way to its place in a piece.
_PLACE = _U((1 << 21) - 1)


def _heads(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as they compare."""
    return np.ndarray(shape=(max(0, len(text) - 7),), dtype=">u8", buffer=np.ascontiguousarray(text), strides=(1,)) if len(text) > 7 else np.zeros(0, ">u8")


def _offsets(depth: int) -> list[int]:
    """Where the words of eight bytes begin that make up ``depth`` bytes, 8 or more."""
    return [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal): ``starts`` in order of their first ``depth`` bytes, ties as they were; whether each equals the one before.

    Sorts by eight bytes at a time, and from the second time on only what is still tied. depth is 8 or more.
    """
    heads = _heads(text)
    word = lambda at: heads[at].astype(_U)
    first = word(starts)
    order = np.argsort(first, kind="stable")
    equal = np.append(False, first[order][1:] == first[order][:-1])[: len(order)]
    for offset in _offsets(depth)[1:]:
        tied = equal | np.append(equal[1:], False)
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        group = np.cumsum(~equal[slots])
        own = order[slots]
        value = word(starts[own] + offset)
        by = np.lexsort((value, group))
        order[slots] = own[by]
        equal[slots] = np.append(False, (np.diff(group[by]) == 0) & (np.diff(value[by]) == 0))
    return order, equal


class Level:
    """Distinct suffixes of a text, in order of their first ``depth`` bytes."""

    def __init__(self, text: np.ndarray, suffixes: np.ndarray, rank: int):
        self.text, self.suffixes, self.rank = text, suffixes, rank
        self.heads = _heads(text)

    def word(self, at: np.ndarray, offset: int) -> np.ndarray:
        """Eight bytes of the suffixes at the places ``at`` of the order."""
        return self.heads[self.suffixes[at] + offset].astype(_U)

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, offset: int, right: bool) -> np.ndarray:
        """In each range [lo, hi) of the order, whose words at ``offset`` rise, the place of ``value``."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            word = self.word(mid, offset)
            up = word <= value[open_] if right else word < value[open_]
            lo[open_[up]] = mid[up] + 1
            hi[open_[~up]] = mid[~up]
        return lo

    def locate(self, text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(how many suffixes are less than each of ``starts``, whether one is equal): by binary search, eight bytes at a time."""
        heads = _heads(text)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.suffixes))
        first = self.word(np.arange(len(self.suffixes)), 0)
        for offset in _offsets(depth):
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            value = heads[starts[open_] + offset].astype(_U)
            if offset:
                a, b = lo[open_], hi[open_]
                lo[open_], hi[open_] = self._bisect(a, b, value, offset, False), self._bisect(a, b, value, offset, True)
            else:
                lo[open_], hi[open_] = np.searchsorted(first, value, side="left"), np.searchsorted(first, value, side="right")
        return lo, lo < hi


class Family:
    def __init__(self, depth: int = WINDOW, levels: list[Level] | None = None):
        self.depth, self.levels = depth, levels or []

    def add(self, text: np.ndarray, starts: np.ndarray, merge: bool = True) -> np.ndarray:
        """Whether the ``depth`` bytes at each start stand in an earlier batch, or at an earlier one of ``starts``.

        The batch's new suffixes become a level; then levels of one size are merged, if not left for later.
        """
        order, equal = suffix_order(text, starts, self.depth)
        group = np.cumsum(~equal) - 1
        suffixes = starts[order[~equal]]  # the earliest of each group of equals
        old = np.zeros(len(suffixes), bool)
        for level in self.levels:
            fresh = np.flatnonzero(~old)
            old[fresh] = level.locate(text, suffixes[fresh], self.depth)[1]
        again = np.zeros(len(starts), bool)
        again[order] = equal | old[group]
        self.levels.append(Level(text, suffixes[~old], 0))
        while merge and len(self.levels) > 1 and self.levels[-2].rank == self.levels[-1].rank:
            self.levels[-2:] = [merged(*self.levels[-2:], self.depth)]
        return again


def merged(one: Level, two: Level, depth: int) -> Level:
    """One level of the next rank: the second's suffixes are put into the first's order."""
    less, _ = one.locate(two.text, two.suffixes, depth)
    both = np.empty(len(one.suffixes) + len(two.suffixes), np.int64)
    place = less + np.arange(len(less))
    rest = np.ones(len(both), bool)
    rest[place] = False
    both[place], both[rest] = two.suffixes + len(one.text), one.suffixes
    return Level(np.concatenate([one.text, two.text]), both, max(one.rank, two.rank) + 1)


def _grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a multiple of eight) at each place."""
    words = np.array(np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=np.ascontiguousarray(raw), strides=(1,)))
    n = len(raw) - size + 1
    h = words[:n] * _U(0x9E3779B97F4A7C15)
    for k in range(8, size, 8):
        h ^= h >> _U(29)
        h += words[k : k + n]
        h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


class Bytes(Scheme):
    short = 8

    def __init__(self, window: int = WINDOW):
        self.window, self.bytes_per_unit, self.bytes_per_anchor = window, 1.0, (window - GRAM + 2) / 2

    def runs(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[Runs, Callable[[], tuple[np.ndarray, None]]]:
        return self._anchored(raw, self._inside(raw, offsets), GRAM, offsets), lambda: (raw, None)

    def _inside(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the window at each place lies in one text."""
        n = max(len(raw) - self.window + 1, 0)
        crossed = np.zeros(n + 1, np.int64)  # how many ends of texts it crosses
        np.add.at(crossed, np.clip(offsets[1:-1] - self.window + 1, 0, n), 1)
        np.add.at(crossed, np.clip(offsets[1:-1], 0, n), -1)
        return np.cumsum(crossed[:-1]) == 0

    def unmerged(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[Runs, None]:
        return self._anchored(raw, self._inside(raw, offsets), TRAVEL_GRAM, offsets, merge=False), None

    def _anchored(self, raw: np.ndarray, valid: np.ndarray, gram: int, offsets: np.ndarray, merge: bool = True) -> Runs:
        """The runs of the valid windows, anchored at that of their strings of ``gram`` bytes whose hash is least."""
        none = np.zeros(0, np.int64)
        if not valid.any():
            return Runs(none, none, none, np.zeros(0, _U), offsets)
        h, n = _grams(raw, gram), len(valid)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=_U)  # of equal hashes the leftmost
        span, wide = self.window - gram + 1, 1
        while 2 * wide <= span:
            least = np.minimum(least[: len(least) - wide], least[wide:])
            wide *= 2
        least = np.minimum(least[:n], least[span - wide : span - wide + n])
        place = (least & _PLACE).astype(np.int64)
        new = valid & np.append(True, (place[1:] != place[:-1]) | ~valid[:-1])
        start = np.flatnonzero(new)
        upto = np.append(0, np.cumsum(valid))
        length = upto[np.append(start[1:], n)] - upto[start]
        place = place[start]
        return Runs(start, length, place * 4, mix(h[place]), offsets, merge)

    def travelling(self, runs: Runs, at: np.ndarray, raw: np.ndarray) -> tuple[Runs, np.ndarray]:
        """The same windows anchored at shorter strings: their runs are longer, and so share more of the bytes they take along."""
        edges = np.zeros(max(len(raw) - self.window + 1, 0) + 1, np.int64)
        np.add.at(edges, runs.start[at], 1)
        np.add.at(edges, runs.start[at] + runs.length[at], -1)
        made = self._anchored(raw, np.cumsum(edges[:-1]) > 0, TRAVEL_GRAM, runs.first)
        return made, np.arange(len(made.key))

    def segments(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for lo in range(0, max(1, len(raw) - self.window + 1), PIECE_BYTES):
            yield lo, min(len(raw), lo + PIECE_BYTES + self.window - 1), lo

    def repeated(self, lengths: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        family, found = Family(self.window), []
        begins, total = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(lengths))
        lo = 0
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BATCH_WINDOWS, side="right")) - 1)
            found.append(family.add(values[begins[lo] : begins[hi]], slices(np.arange(begins[hi] - begins[lo]), begins[lo:hi] - begins[lo], lengths[lo:hi])))
            lo = hi
        return np.concatenate(found) if found else np.zeros(0, bool)


def _output(digest: bool) -> tuple[T.StructType, Callable[[bytes, np.ndarray], tuple]]:
    last = T.StructField("kept_sha256", T.StringType()) if digest else T.StructField("kept", T.BinaryType())

    def finish(text: bytes, gone: np.ndarray) -> tuple:
        parts, at = [], 0
        for lo, hi in gone.tolist():
            parts.append(text[at:lo])
            at = hi
        parts.append(text[at:])
        kept = b"".join(parts)
        return len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest() if digest else kept

    return T.StructType([*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), last]), finish


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes), or its SHA-256 as kept_sha256. window: GRAM or more."""
    return without_repeats(docs, Bytes(window), *_output(digest), hot_windows)


KEPT = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("span", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("suffixes", T.BinaryType())]
)


class Index:
    """A family whose levels are tables under ``folder``, a row for each bucket of anchors; it takes documents batch by batch.

    Every run of a batch is kept (other than for ``dedup``, later batches may repeat any), so the index takes several times the
    room of its texts. A batch writes one table; tables of one rank are merged into one of the next, so a run is rewritten a
    logarithm of the batches often. A batch counts from when its state is complete: one that failed leaves only unused tables.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, window: int = WINDOW):
        self.spark, self.folder, self.buckets, self.scheme = spark, folder.rstrip("/"), buckets, Bytes(window)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def state(self) -> tuple[int, list[tuple[int, str]]]:
        """(number of the newest complete state, its levels as (rank, table), the largest first)."""
        path, fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [int(n[6:]) for n in names if n.startswith("state-") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        if not done:
            return 0, []
        rows = self.spark.read.parquet(f"{self.folder}/state-{max(done)}").orderBy("place").collect()
        return max(done), [(r.rank, r.table) for r in rows]

    def _level(self, table: str) -> DataFrame:
        return self.spark.read.schema(KEPT).parquet(f"{self.folder}/{table}").where("span is null")

    def _write(self, rows: DataFrame) -> str:
        table = f"level-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{table}")
        return table

    def add(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """The columns of ``dedup`` for a new batch; a window counts if it stands in an earlier batch, or earlier in this one."""
        number, levels = self.state()
        main, rest = unique_documents(docs)
        scheme, buckets, window = self.scheme, self.buckets, self.scheme.window

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from blocks_of(((ids, runs, data, base, np.arange(len(runs.key))) for _, ids, runs, data, base in cut_runs(batches, scheme)), scheme, buckets)

        def judge(batch: pa.Table, kept: pa.Table) -> pa.Table:
            spans = [*known_spans(batch, window)]
            ids, starts, lengths, sizes, data = read_runs(batch)
            level = []
            if len(ids):
                family = Family(window, [Level(np.frombuffer(r["text"], np.uint8), np.frombuffer(r["suffixes"], np.int64), 0) for r in kept.to_pylist()])
                found = family.add(data, slices(np.arange(len(data)), np.cumsum(sizes) - sizes, lengths), merge=False)
                spans.append(covered_rows(*windows_found(ids, starts, lengths, found), window))
                level = [family.levels[-1]]
            told = pa.Table.from_batches(spans, schema=to_arrow_schema(COVERED))
            none = pa.nulls(len(told), pa.binary())
            bucket = batch.column("bucket")[0].as_py() if len(batch) else None
            one = pa.table([pa.array([bucket] * len(told), pa.int32()), told.column("doc_id"), told.column("span"), none, none], schema=to_arrow_schema(KEPT))
            made = [[bucket], [None], [None], *([getattr(x, c).tobytes() for x in level] for c in ("text", "suffixes"))] if level else [[]] * 5
            return pa.concat_tables([one, pa.table([pa.array(v, f.type) for v, f in zip(made, to_arrow_schema(KEPT), strict=True)], schema=to_arrow_schema(KEPT))])

        kept = self.spark.createDataFrame([], KEPT)
        for _, table in levels:
            kept = kept.union(self._level(table))
        made = main.mapInArrow(pack, MADE)
        batch = self._write(made.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(judge, KEPT))
        levels.append((0, batch))
        while len(levels) > 1 and levels[-2][0] == levels[-1][0]:
            (rank, one), (_, two) = levels[-2:]
            levels[-2:] = [(rank + 1, self._merged(one, two))]
        places = [(i, rank, table) for i, (rank, table) in enumerate(levels)]
        self.spark.createDataFrame(places, "place int, rank int, table string").coalesce(1).write.parquet(f"{self.folder}/state-{number + 1}")
        covered = self.spark.read.schema(KEPT).parquet(f"{self.folder}/{batch}").where("span is not null").select("doc_id", "span")
        return finished(main, rest, covered, *_output(digest))

    def _merged(self, one: str, two: str) -> str:
        depth = self.scheme.window

        def join(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return a if len(a) else b
            read = lambda t: Level(np.frombuffer(t.column("text")[0].as_py(), np.uint8), np.frombuffer(t.column("suffixes")[0].as_py(), np.int64), 0)
            both = merged(read(a), read(b), depth)
            made = [[a.column("bucket")[0].as_py()], [None], [None], [both.text.tobytes()], [both.suffixes.tobytes()]]
            return pa.table([pa.array(v, f.type) for v, f in zip(made, to_arrow_schema(KEPT), strict=True)], schema=to_arrow_schema(KEPT))

        return self._write(self._level(one).groupBy("bucket").cogroup(self._level(two).groupBy("bucket")).applyInArrow(join, KEPT))


#: DuckDB SQL for ``dedup`` with digests.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x, unnest(range(length(h) // 2)) AS i, length(h) // 2 AS n FROM d),
k AS (SELECT doc_id, x, i, CASE WHEN i + 100 <= n THEN string_agg(x, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) END AS key FROM b),
r AS (SELECT doc_id, x, i, key IS NOT NULL AND row_number() OVER (PARTITION BY md5(key) ORDER BY doc_id, i) > 1 AS again FROM k),
g AS (SELECT doc_id, x, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
p AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM p GROUP BY 1)
SELECT d.doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
