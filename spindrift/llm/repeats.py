"""Long repeats of whole texts: what the substring operators have in common.

A scheme cuts texts into units (words or bytes) and gives every window of ``window`` units an anchor that depends on
the window's content alone, so equal windows have equal anchors at equal places. Neighbouring windows with one anchor's key
are a run. Then:

1. Anchors that stand in more than one place are found by their keys (``shared.repeated_places``); a window whose
   anchor stands nowhere else has no equal, so most of the text is done with.
2. The runs of the remaining windows travel as bytes to the bucket of their anchor's key; of equal runs in a block only the
   earliest does. Runs are found equal by hash and length, and compared byte by byte before they count as equal.
3. Buckets whose windows are more than fit a task, round an anchor of very many texts, are dealt anew: their runs are cut into short ones,
   keyed by the content that all windows of a short run share, so that only windows that nearly agree stay together.
4. Each bucket takes equal runs for one, as the blocks do, and finds, among all windows of the runs that are left, those whose content starts earlier in the order of (doc_id, start). It compares
   contents, not hashes.
5. The intervals they cover come back to their documents. Texts move twice: to their repeated anchors and to their intervals.

Hashes only choose what is compared. Texts longer than a piece are worked on in segments that overlap by a window.

``finish`` makes the result of a document from its bytes and the covered intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import mix, released, row_chunks
from .shared import BUCKET_KEYS, PIECE_BYTES, Entries, buckets_for, pieces, repeated_places, rolling, squeezed, unique_documents, unsqueezed

#: Windows of a bucket if every window were a candidate, and from how many on it is dealt anew.
BUCKET_WINDOWS, HOT_WINDOWS = 4 << 20, 8 << 20
#: Runs' windows and bytes of texts of a block; bytes that are compared at a time.
BLOCK_WINDOWS, BLOCK_BYTES, COMPARED = 1 << 19, 32 << 20, 2 << 20

_U = np.uint64


class Runs:
    """Runs of windows of one piece of texts; positions are units of the piece.

    Neighbouring runs with one key (of periodic text) are one. ``twice`` tells which runs hold several anchors.
    """

    def __init__(self, start: np.ndarray, length: np.ndarray, place: np.ndarray, key: np.ndarray, first: np.ndarray, merge: bool = True):
        """Runs in order of their starts; place: four times that of the anchor, and a tier, in the piece; first: units before each text."""
        doc = np.searchsorted(first, start, side="right") - 1
        if not merge:
            self.start, self.length, self.place, self.key, self.doc, self.first, self.twice = start, length, place, key, doc, first, np.zeros(len(start), bool)
            return
        new = np.append(True, (start[1:] != start[:-1] + length[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(start)]
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(start))
        self.start, self.key, self.doc, self.first = start[at], key[at], doc[at], first
        self.length = np.add.reduceat(length, at) if len(at) else length
        self.place, self.twice = place[at], ends - at > 1

    @classmethod
    def of_windows(cls, windows: np.ndarray, anchors: np.ndarray, keys: np.ndarray, first: np.ndarray, merge: bool = True) -> Runs:
        """From sorted windows, with the place of each one's anchor."""
        doc = np.searchsorted(first, windows, side="right")
        new = np.append(True, (np.diff(anchors) != 0) | (np.diff(windows) != 1) | (np.diff(doc) != 0))[: len(windows)]
        at = np.flatnonzero(new)
        return cls(windows[at], np.diff(np.append(at, len(windows))), anchors[at], keys[at], first, merge)


class Scheme:
    window: int
    #: Bytes of text for each window that a bucket has room for, and for each anchor.
    bytes_per_unit: float
    bytes_per_anchor: float
    #: Windows of a short run.
    short: int

    def runs(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[Runs, Callable[[], tuple[np.ndarray, np.ndarray | None]]]:
        """(runs, data): data() gives the bytes that stand for the units, and the offset of each unit in them (None: a byte each)."""
        raise NotImplementedError

    def travelling(self, runs: Runs, at: np.ndarray, raw: np.ndarray) -> tuple[Runs, np.ndarray]:
        """The runs that take the windows of the runs at ``at`` to their buckets."""
        return runs, at

    def unmerged(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[Runs, np.ndarray | None]:
        """(the travelling runs of all windows, one for each anchor, the offset of each unit)."""
        raise NotImplementedError

    def segments(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first byte, end, number of the first unit) of the segments of a long text; two segments share ``window`` - 1 units."""
        raise NotImplementedError

    def repeated(self, lengths: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For runs (windows, bytes) in order of (doc, start): which of their windows, all in one row, starts earlier with equal content."""
        raise NotImplementedError


def slices(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``values`` one after the other."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return values[at]


def equal_slices(values: np.ndarray, one: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the slices at ``one`` equal those at ``other``, byte by byte; none is empty."""
    out, total, lo = np.ones(len(sizes), bool), np.append(0, np.cumsum(sizes)), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + COMPARED, side="right")) - 1)
        differ = slices(values, one[lo:hi], sizes[lo:hi]) != slices(values, other[lo:hi], sizes[lo:hi])
        out[lo:hi] = ~np.logical_or.reduceat(differ, total[lo:hi] - total[lo])
        lo = hi
    return out


MADE = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("known", T.BooleanType()), T.StructField("windows", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("docs", "starts", "lengths", "sizes", "data"))])
#: A covered interval [lo, hi) of a document; span is lo * 2**32 + hi, which takes least room in lists.
COVERED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("span", T.LongType())])


def covered_rows(docs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> pa.RecordBatch:
    """Rows of COVERED for stretches of ``lengths`` windows."""
    span = (starts << 32) | (starts + lengths - 1 + window)
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(span)], schema=to_arrow_schema(COVERED))


def cut_runs(batches: Iterable[pa.RecordBatch], scheme: Scheme) -> Iterator[tuple]:
    """(rows, their doc_ids, runs, data, base) of pieces of the batches (doc_id, text): base is the number of the first unit of a long text's segment."""
    for rows, raw, offsets in pieces(batches, 1):
        ids = rows.column(0).to_numpy()
        if len(raw) <= PIECE_BYTES:
            yield rows, ids, *scheme.runs(raw, offsets), 0
        else:
            for lo, hi, base in scheme.segments(raw):
                yield rows, ids, *scheme.runs(raw[lo:hi], np.array([0, hi - lo])), base


def run_keys(batches: Iterable[pa.RecordBatch], scheme: Scheme) -> Iterator[Entries]:
    """Key, doc_id and place of every run; those with several anchors twice, as their windows may equal one another."""
    for _, ids, runs, _, base in cut_runs(batches, scheme):
        if len(runs.key):
            place = (runs.place - 4 * runs.first[runs.doc] + 4 * base).astype(np.int64)
            at = np.concatenate([np.arange(len(runs.key)), np.flatnonzero(runs.twice)])
            yield runs.key[at], ids[runs.doc][at], place[at]


def run_hashes(sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A hash of each run of ``data``, some at a time."""
    offsets, out = np.append(0, np.cumsum(sizes)), np.zeros(len(sizes), _U)
    for lo, hi in row_chunks(offsets, COMPARED):
        own = offsets[lo : hi + 1] - offsets[lo]
        out[lo:hi] = rolling(data[offsets[lo] : offsets[hi]], own[:-1], own[1:])
    return out


def equal_runs(order: np.ndarray, prints: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether the run at each place of ``order`` (by hash, length, size) is the same, byte by byte, as the first that has its hash."""
    same = np.append(False, (np.diff(prints[order]) == 0) & (np.diff(lengths[order]) == 0) & (np.diff(sizes[order]) == 0))[: len(order)]
    leader = order[np.flatnonzero(~same)][np.cumsum(~same) - 1]
    own = np.flatnonzero(same)
    same[own] = equal_slices(data, at[order[own]], at[leader[own]], sizes[order[own]])
    return same


def packed_runs(held: list[tuple], buckets: int, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """MADE rows of a block: its runs by bucket (numbered from ``shift`` on), and those known to repeat without their bytes."""
    made = to_arrow_schema(MADE)
    ids, starts, lengths, keys, prints, at, sizes = (np.concatenate([h[i] for h in held]) for i in range(7))
    data = np.concatenate([h[7] for h in held])
    before = np.cumsum([0, *(len(h[7]) for h in held[:-1])])
    at = at + np.repeat(before, [len(h[5]) for h in held])
    order = np.lexsort((starts, ids, sizes, lengths, prints))
    same = equal_runs(order, prints, lengths, sizes, at, data)
    known, sent = order[same], order[~same]
    columns: list[list] = [[] for _ in made]

    def add(bucket: int, own: np.ndarray, known: bool) -> None:
        parts = (squeezed(x[own]) for x in (ids, starts, lengths))
        rest = (None, None) if known else (squeezed(sizes[own]), squeezed(slices(data, at[own], sizes[own])))
        for column, v in zip(columns, (bucket + shift, known, int(lengths[own].sum()), *parts, *rest), strict=True):
            column.append(v)

    for i, own in enumerate(np.array_split(known, -(-len(known) // BLOCK_WINDOWS)) if len(known) else ()):
        add(int((int(ids[own[0]]) + i) % buckets), own, True)
    edges = np.array([-(-(i << 64) // buckets) for i in range(1, buckets)], _U)
    bucket = np.searchsorted(edges, keys[sent], side="right")
    sent = sent[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    cuts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)[: len(bucket)])
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sent)][: len(cuts)], strict=True):
        add(int(bucket[lo]), sent[lo:hi], False)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)


def blocks_of(pieces_: Iterable[tuple], scheme: Scheme, buckets: int) -> Iterator[pa.RecordBatch]:
    """MADE rows of pieces (doc_ids, runs, data, base, places in runs that are wanted)."""

    def cut() -> Iterator[tuple]:
        for ids, runs, data, base, at in pieces_:
            if len(at):
                raw, unit = data()
                runs, at = scheme.travelling(runs, at, raw)
                start, length = runs.start[at], runs.length[at]
                lo, hi = start, start + length + scheme.window - 1
                lo, hi = (lo, hi) if unit is None else (unit[lo], unit[hi])
                yield ids[runs.doc[at]], start - runs.first[runs.doc[at]] + base, length, runs.key[at], rolling(raw, lo, hi), lo, hi - lo, raw

    return packed(cut(), buckets)


def packed(pieces_: Iterable[tuple], buckets: int, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """MADE rows of runs: (doc_ids, starts, lengths, keys, hashes, offsets and sizes of their bytes, the bytes)."""
    held: list[tuple] = []
    n = m = 0
    for piece in pieces_:
        held.append(piece)
        n, m = n + int(piece[2].sum()), m + len(piece[7])
        if n > BLOCK_WINDOWS or m > BLOCK_BYTES:
            yield from packed_runs(held, buckets, shift)
            held, n, m = [], 0, 0
    if held:
        yield from packed_runs(held, buckets, shift)


def shortened(scheme: Scheme, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """The runs cut into short ones, for ``packed``.

    A window is told by how far its anchor lies behind its start; windows of ``short`` neighbouring distances share
    all units but ``short`` - 1, and what they share is their key. Equal windows have their anchors at equal distances, so equal keys.
    """
    offsets, step = np.append(0, np.cumsum(sizes)), scheme.short
    for lo, hi in row_chunks(offsets, PIECE_BYTES):
        raw = data[offsets[lo] : offsets[hi]]
        runs, unit = scheme.unmerged(raw, offsets[lo : hi + 1] - offsets[lo])
        place = runs.place >> 2
        far = place - runs.start
        near = far - runs.length + 1
        n = far // step - near // step + 1
        r = np.repeat(np.arange(len(n)), n)
        j = (far // step)[r] - (np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n))
        top, low = np.minimum(j * step + step - 1, far[r]), np.maximum(j * step, near[r])
        first, count, shared = place[r] - top, top - low + 1, place[r] - j * step
        byte = (lambda x: x) if unit is None else unit.__getitem__
        key = mix(rolling(raw, byte(shared), byte(shared - step + 1 + scheme.window)) + j.astype(_U))
        begin, end = byte(first), byte(first + count - 1 + scheme.window)
        doc = runs.doc[r]
        yield ids[lo + doc], starts[lo + doc] + first - runs.first[doc], count, key, rolling(raw, begin, end), begin, end - begin, raw


def dealt_anew(batches: Iterable[pa.RecordBatch], scheme: Scheme, buckets: int) -> Iterator[pa.RecordBatch]:
    """MADE rows in short runs, to buckets of their own."""

    def runs() -> Iterator[tuple]:
        for b in batches:
            for row in b.select(["docs", "starts", "sizes", "data"]).to_pylist():
                read = lambda c, t, row=row: unsqueezed([pa.scalar(row[c], pa.binary())], t)
                yield from shortened(scheme, read("docs", np.int64), read("starts", np.int64), read("sizes", np.int64), read("data", np.uint8))

    return packed(runs(), buckets, buckets)


def read_runs(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, starts, lengths, sizes, data) of MADE rows that aren't known, in order of (doc, start)."""
    sent = table.filter(pa.compute.invert(table.column("known")))
    ids, starts, lengths, sizes = (unsqueezed(sent.column(c), np.int64) for c in ("docs", "starts", "lengths", "sizes"))
    data = unsqueezed(sent.column("data"), np.uint8)
    at = np.cumsum(sizes) - sizes
    order = np.lexsort((starts, ids))
    return ids[order], starts[order], lengths[order], sizes[order], slices(data, at[order], sizes[order])


def without_repeats(docs: DataFrame, scheme: Scheme, out: T.StructType, finish: Callable[[bytes, np.ndarray], tuple], hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """doc_id and the columns ``out`` of every row; ``finish(text, intervals)`` gives their values.

    intervals: an array (n, 2) of units [lo, hi), sorted and apart. Of rows that repeat a doc_id one takes part (see
    ``unique_documents``); the others, and rows with null doc_id, are finished with nothing covered.
    """
    docs, rest = unique_documents(docs)
    size = scheme.window
    places = repeated_places(docs, lambda batches: run_keys(batches, scheme), buckets_for(docs, scheme.bytes_per_anchor))
    hits = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    joined = docs.join(hits, "doc_id").select("doc_id", "text", "places")
    buckets = max(1, buckets_for(docs, scheme.bytes_per_unit * BUCKET_WINDOWS / BUCKET_KEYS))

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = lambda d, p: (d.astype(np.int64) << 40) | p.astype(np.int64)

        def wanted() -> Iterator[tuple]:
            for rows, ids, runs, data, base in cut_runs(batches, scheme):
                counts = rows.column(2).value_lengths().to_numpy()
                asked = pair(np.repeat(np.arange(len(ids)), counts), rows.column(2).flatten().to_numpy())
                place = runs.place - 4 * runs.first[runs.doc] + 4 * base
                yield ids, runs, data, base, np.flatnonzero(np.isin(pair(runs.doc, place), asked))

        yield from blocks_of(wanted(), scheme, buckets)

    def judge(group: pa.Table) -> pa.Table:
        batches = [*known_spans(group, size)]
        ids, starts, lengths, sizes, data = read_runs(group)
        if len(ids):
            at = np.cumsum(sizes) - sizes
            prints = run_hashes(sizes, data)
            order = np.lexsort((np.arange(len(ids)), sizes, lengths, prints))
            again = np.zeros(len(ids), bool)
            again[order] = equal_runs(order, prints, lengths, sizes, at, data)
            batches.append(covered_rows(ids[again], starts[again], lengths[again], size))
            own = np.flatnonzero(~again)  # of equal runs the first; its windows may still stand in others
            found = scheme.repeated(lengths[own], sizes[own], slices(data, at[own], sizes[own]))
            batches.append(covered_rows(*windows_found(ids[own], starts[own], lengths[own], found), size))
        return pa.Table.from_batches(batches, schema=to_arrow_schema(COVERED))

    made = joined.mapInArrow(released(sift), MADE)
    large = made.where("not known").groupBy("bucket").agg(F.sum("windows").alias("windows")).where(F.col("windows") > hot_windows)
    # broadcast: a number for every HOT_WINDOWS windows at most. Where there is none, adaptive execution leaves both joins out
    large = F.broadcast(large.select(F.col("bucket").alias("large")))
    here = (F.col("bucket") == F.col("large")) & ~F.col("known")
    cold, hot = made.join(large, here, "left_anti"), made.join(large, here, "left_semi")
    short = hot.mapInArrow(lambda batches: dealt_anew(batches, scheme, buckets), MADE)
    judged = cold.unionByName(short).groupBy("bucket").applyInArrow(judge, COVERED)
    return finished(docs, rest, judged, out, finish)


def known_spans(group: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of COVERED of the runs that their block knows to repeat."""
    for row in group.filter(group.column("known")).select(["docs", "starts", "lengths"]).to_pylist():
        yield covered_rows(*(unsqueezed([pa.scalar(row[c], pa.binary())], np.int64) for c in ("docs", "starts", "lengths")), window)


def finished(docs: DataFrame, rest: DataFrame | None, covered: DataFrame, out: T.StructType, finish: Callable[[bytes, np.ndarray], tuple]) -> DataFrame:
    """doc_id and the columns ``out`` of every document, from the intervals that are covered."""
    gone = covered.groupBy("doc_id").agg(F.collect_list("span").alias("gone"))
    told = docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    fields = T.StructType([T.StructField("doc_id", T.LongType()), *out.fields])
    arrow = to_arrow_schema(fields)

    def end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                pairs = np.zeros((0, 2), np.int64)
                if spans.is_valid:
                    v = spans.values.to_numpy()
                    pairs = _union(np.stack([v >> 32, v & 0xFFFFFFFF], axis=1))
                results.append(finish(text.as_py(), pairs))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in results], f.type) for i, f in enumerate(to_arrow_schema(out)))], schema=arrow)

    result = told.mapInArrow(released(end), fields)
    if rest is not None:
        result = result.union(rest.withColumn("gone", F.lit(None).cast("array<bigint>")).mapInArrow(end, fields))
    return result


def windows_found(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first starts, lengths) of the stretches of found windows of runs."""
    run = np.repeat(np.arange(len(ids)), lengths)[found]
    start = np.arange(len(found))[found] - (np.cumsum(lengths) - lengths)[run] + starts[run]
    own = ids[run]
    new = np.append(True, (np.diff(own) != 0) | (np.diff(start) != 1))[: len(own)]
    at = np.flatnonzero(new)
    return own[at], start[at], np.diff(np.append(at, len(own)))


def _union(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint intervals that cover the same; touching ones become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]], axis=1)
