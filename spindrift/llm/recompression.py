"""Substring deduplication by recompression.

Words are symbols. A round first names runs of one symbol (symbol, length), then splits the alphabet in two by a bit of
each symbol's name and names every pair (left, right) whose words are few enough. Names are hashes of what they stand for, so all
texts agree on them without asking each other, and a symbol depends only on the words in its reach: equal
stretches of text get equal symbols, but for a margin. After ``ROUNDS`` rounds a window is anchored at the
symbol that lies in it with its whole reach, the longest of them, of these the one with the least name; a window without such a
symbol (inside a very long run) is its own anchor. Symbols that several places share reveal where texts may repeat. The words
there travel to their symbol's bucket, where the windows are verified: words, then pairs of names for 1, 2, 4, ... words, are named
by what they are, so two windows have one name only if they are the same words.

Null and empty texts have no words. For null and repeated doc_ids see ``repeats``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mix
from .repeats import HOT_WINDOWS, Runs, Scheme, slices, without_repeats
from .shared import PIECE_BYTES, rolling, word_spans

WINDOW = 20
ROUNDS, MOST_WORDS = 4, 8

_U = np.uint64


class Symbols:
    """The symbols of a piece of texts: names, word ranges, and the words they depend on (reach)."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n = len(words)
        self.name, self.start, self.end = words, np.arange(n), np.arange(1, n + 1)
        self.left, self.right = self.start.copy(), self.end.copy()
        self.doc = np.searchsorted(first, self.start, side="right") - 1
        self.first = first

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is there a next symbol in the text, reach of the one before, of the one after); outside a text nothing can reach."""
        joined = np.append(self.doc[1:] == self.doc[:-1], False) if len(self.doc) else np.zeros(0, bool)
        before = np.where(np.append(False, joined[:-1]), np.append(0, self.left[:-1]), self.first[self.doc] - 1)
        after = np.where(joined, np.append(self.right[1:], 0), self.first[self.doc + 1] + 1)
        return joined, before, after

    def _take(self, at: np.ndarray, last: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.name, self.left, self.right = name, left, right
        self.start, self.end, self.doc = self.start[at], self.end[last], self.doc[at]

    def runs(self) -> None:
        """Names maximal runs; whether a symbol ends one depends on its neighbours."""
        joined, before, after = self._beside()
        same = np.append(False, joined[:-1] & (self.name[1:] == self.name[:-1]))
        at = np.flatnonzero(~same)
        last = np.append(at[1:], len(same)) - 1
        times = (last - at + 1).astype(_U)
        name = np.where(times > 1, mix(self.name[at] + times * _U(0xA24BAED4963EE407)), self.name[at])
        self._take(at, last, name, before[at], after[last])

    def pairs(self, round_: int) -> None:
        """Names pairs of a left and a right symbol; a pair depends on its two symbols, a single one on the neighbour it could have met."""
        joined, before, after = self._beside()
        right_ = (mix(self.name ^ _U(0x632BE59BD9B4E019 * (round_ + 1) & 0xFFFFFFFFFFFFFFFF)) & _U(1)).astype(bool)
        words = self.end - self.start
        opens = joined & ~right_ & np.append(right_[1:], False) & (words + np.append(words[1:], 0) <= MOST_WORDS)
        closed = np.append(False, opens[:-1])
        at = np.flatnonzero(~closed)
        two = opens[at]
        last = at + two
        name = np.where(two, mix(mix(self.name[at]) + self.name[last] * _U(0x9FB21C651E98DF25)), self.name[at])
        left = np.where(two | ~right_[at], self.left[at], before[at])
        right = np.where(two, self.right[last], np.where(right_[at], self.right[at], after[at]))
        self._take(at, last, name, left, right)


class Words(Scheme):
    short = 4

    def __init__(self, window: int = WINDOW):
        self.window, self.bytes_per_unit, self.bytes_per_anchor = window, 1.0, 24.0

    def runs(self, raw: np.ndarray, offsets: np.ndarray, merge: bool = True) -> tuple[Runs, Callable[[], tuple[np.ndarray, np.ndarray]]]:
        begin, end, first = word_spans(raw, offsets)
        words = rolling(raw, begin, end)
        s = Symbols(words, first)
        if len(words):
            s.runs()
            for r in range(ROUNDS):
                s.pairs(r)
        counts = np.diff(first)
        fits = np.maximum(counts - self.window + 1, 0)
        windows = np.arange(int(fits.sum())) + np.repeat(first[:-1] - (np.cumsum(fits) - fits), fits)
        lo, hi = np.searchsorted(s.left, windows, side="left"), np.searchsorted(s.right, windows + self.window, side="right")
        anchors, keys = windows * 4, np.zeros(len(windows), _U)
        found = np.flatnonzero(hi > lo)
        if len(found):
            best = _least(((MOST_WORDS - np.minimum(s.end - s.start, MOST_WORDS)).astype(_U) << _U(60)) | (mix(s.name) >> _U(4)), lo[found], hi[found])
            anchors[found], keys[found] = s.start[best] * 4 + 1, s.name[best]
        alone = np.flatnonzero(hi <= lo)
        if len(alone):
            keys[alone] = rolling(words, windows[alone], windows[alone] + self.window)

        def data() -> tuple[np.ndarray, np.ndarray]:
            """The words, a space after each."""
            sizes = end - begin + 1
            ends = np.cumsum(sizes)
            spaced = slices(np.append(raw, np.uint8(32)), begin, sizes)
            spaced[ends - 1] = 32
            return spaced, np.append(0, ends)

        return Runs.of_windows(windows, anchors, keys, first, merge), data

    def unmerged(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[Runs, np.ndarray]:
        """Words have a space after each here, so their offsets are those of the bytes."""
        runs, data = self.runs(raw, offsets, merge=False)
        return runs, data()[1]

    def segments(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        begin, _, _ = word_spans(raw, np.array([0, len(raw)]))
        at = 0
        while at == 0 or at + self.window <= len(begin):
            after = max(at + 1, int(np.searchsorted(begin, begin[at] + PIECE_BYTES))) if len(begin) else 1
            last = after + self.window - 1
            yield int(begin[at]) if len(begin) else 0, int(begin[last]) if last < len(begin) else len(raw), at
            at = after

    def repeated(self, lengths: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Words, then pairs of names of 1, 2, 4, ... words are named by what they are, until windows have names."""
        ends = np.flatnonzero(values == 32)
        cuts = np.append(-1, ends)
        offsets = pa.py_buffer((cuts + 1).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])
        name, wide = words.dictionary_encode().indices.to_numpy().astype(np.int64), 1
        n = lengths + self.window - 1
        windows = slices(np.arange(len(ends)), np.cumsum(n) - n, lengths)
        whole, covered, left = None, 0, self.window
        while True:
            if left & wide:  # the window is made of powers of two, the least first
                part = name[windows + covered]
                whole = part if whole is None else np.unique(whole * (len(ends) + 1) + part, return_inverse=True)[1]
                covered += wide
            if 2 * wide > left:
                break
            name = np.unique(name[: len(name) - wide] * (len(ends) + 1) + name[wide:], return_inverse=True)[1]
            wide *= 2
        order = np.argsort(whole, kind="stable")
        again = np.zeros(len(whole), bool)
        again[order] = np.append(False, whole[order][1:] == whole[order][:-1])[: len(whole)]
        return again


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The leftmost place of the least value in each range [lo, hi), none empty: by minima over ranges of powers of two."""
    best = np.arange(len(values))
    out = np.zeros(len(lo), np.int64)
    level = np.frexp((hi - lo).astype(float))[1] - 1
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            a, b = best[: len(best) - half], best[half:]
            best = np.where(values[b] < values[a], b, a)
        own = np.flatnonzero(level == k)
        a, b = best[lo[own]], best[hi[own] - (1 << k)]
        out[own] = np.where(values[b] < values[a], b, a)
    return out


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the kept words joined by one space), or its SHA-256 as kept_sha256."""
    name = "kept_sha256" if digest else "kept"
    out = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(name, T.StringType())])

    def finish(text: bytes, gone: np.ndarray) -> tuple:
        words = text.split()
        kept, at = [], 0
        for lo, hi in gone.tolist():
            kept += words[at:lo]
            at = hi
        kept += words[at:]
        joined = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace")

    return without_repeats(docs, Words(window), out, finish, hot_windows)


#: DuckDB SQL for ``dedup`` with digests.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
k AS (SELECT doc_id, word, i, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS key FROM w),
r AS (SELECT doc_id, word, i, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS again FROM k),
g AS (SELECT doc_id, word, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
