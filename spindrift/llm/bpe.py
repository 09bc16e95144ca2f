"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a block of documents are laid out once in one linked array of symbols. An inverted
index from a merge's rank (the token pair's id) to the positions where the pair stands drives the replay:
the lowest rank is applied at all its positions, and only the two neighbours of a merged position are
looked up again. Documents then take their words' ids from the replayed vocabulary. Nothing is shuffled;
memory is bounded by the cache of replayed words (``CACHE_BYTES``), which is emptied when full.

Null and empty texts give no ids. Rows with repeated or null doc_id are encoded one by one. Extra columns pass through
unless they are named like an output column, which then replaces them.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, flat, map_arrow, released, row_chunks, text_bytes

#: Bytes of words whose ids a worker remembers.
CACHE_BYTES = 48 << 20
#: Bytes of documents, or of ids, that are worked on at a time.
PIECE_BYTES = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Replays the merges of a rank table over many words at once.

    A merge can create a pair of a lower rank than its own; the few words where that happens are replayed
    alone, lowest rank and leftmost place first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        found = [
            (ranks[t[:i]] << 32 | ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        self.keys, self.merged = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = a << 32 | b
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers. A word that is a token is that token."""
        whole = self.ranks.get
        out = [b"" if (r := whole(w)) is None else r.to_bytes(4, "little") for w in words]
        split = [i for i, w in enumerate(words) if w and not out[i]]
        if not split:
            return out
        size = np.fromiter((len(words[i]) for i in split), np.int64, len(split))
        ids = self.byte[np.frombuffer(b"".join([words[i] for i in split]), np.uint8)]
        n, ends = len(ids), np.cumsum(size)
        ids = np.append(ids, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - size] = n
        now = np.full(n + 1, -1)  # the rank of the pair that starts at each place
        first = np.flatnonzero(after[:n] < n)
        now[first] = self._rank(ids[first], ids[first + 1])
        where: dict[int, list[np.ndarray]] = {}
        order: list[int] = []
        odd: list[np.ndarray] = []

        def note(places: np.ndarray) -> None:
            places = places[now[places] >= 0]
            by = places[np.argsort(now[places], kind="stable")]
            cuts = np.flatnonzero(np.diff(now[by], prepend=-1))
            for r, part in zip(now[by[cuts]].tolist(), np.split(by, cuts[1:]), strict=True) if len(by) else ():
                if r in where:
                    where[r].append(part)
                else:
                    where[r] = [part]
                    heappush(order, r)

        note(first)
        while order:
            r = heappop(order)
            p = np.unique(np.concatenate(where.pop(r)))
            p = p[now[p] == r]
            if len(p) > 1:  # of overlapping places every second one, from the left
                run = np.flatnonzero(np.append(True, after[p[:-1]] != p[1:]))
                at = np.arange(len(p))
                p = p[(at - run[np.searchsorted(run, at, side="right") - 1]) % 2 == 0]
            if not len(p):
                continue
            q = after[p]
            z = after[q]
            ids[p] = r
            after[p] = z
            before[z] = p
            ids[q] = now[q] = -1
            y = before[p]
            touched = np.concatenate([p, y[y < n]])
            nexts = after[touched]
            new = np.where(nexts < n, self._rank(ids[touched], ids[nexts]), -1)
            now[touched] = new
            if (low := (new >= 0) & (new < r)).any():
                odd.append(touched[low])
            note(touched)
        alive = np.flatnonzero(ids[:n] >= 0)
        packed, stops = ids[alive].astype("<u4").tobytes(), 4 * np.searchsorted(alive, ends)
        lo = 0
        for i, hi in zip(split, stops.tolist(), strict=True):
            out[i] = packed[lo:hi]
            lo = hi
        for k in set(np.searchsorted(ends, np.concatenate(odd), side="right").tolist()) if odd else ():
            out[split[k]] = np.array(self.encode_alone(words[split[k]]), "<u4").tobytes()
        return out

    def encode_alone(self, word: bytes) -> list[int]:
        """The same for one word, one merge after the other."""
        rank = lambda a, b: self.ranks.get(self.token[a] + self.token[b], -1)
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, p) for p in range(n - 1) if (r := rank(ids[p], ids[p + 1])) >= 0]
        heapify(heap)
        while heap:
            r, p = heappop(heap)
            q = after[p]
            if ids[p] < 0 or q >= n or rank(ids[p], ids[q]) != r:
                continue
            ids[p], ids[q] = r, -1
            after[p] = z = after[q]
            if z < n:
                before[z] = p
                if (x := rank(r, ids[z])) >= 0:
                    heappush(heap, (x, p))
            if (y := before[p]) >= 0 and (x := rank(ids[y], r)) >= 0:
                heappush(heap, (x, y))
        return [i for i in ids if i >= 0]


class _Words(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def narrow(pattern: str, below: int = 0x250) -> re.Pattern:
    r"""``pattern`` for texts whose code points are all under ``below``: \p{L}, \p{N}, \s, \S written out as ranges."""
    import regex

    def ranges(escape: str) -> str:
        out, cs = [], [c for c in range(below) if regex.match(escape, chr(c))]
        for c in cs:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)

    for escape in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = re.sub(rf"(\[[^\]]*){re.escape(escape)}", lambda m, e=escape: m[1] + ranges(e), pattern)
        pattern = pattern.replace(escape, f"[{ranges(escape)}]")
    return re.compile(pattern.replace(r"\S", rf"[^{ranges(r'\s')}]"))


def _pieces(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut to about PIECE_BYTES of the binary column ``name``, with that column."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        for lo, hi in row_chunks(flat(column)[1], PIECE_BYTES):
            yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo)


def _made(batch: pa.RecordBatch, keep: list[str], values: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], schema=schema)


def _encoder(ranks: dict[bytes, int], pattern: str, text: str, keep: list[str], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        wide, near, only_near = regex.compile(pattern).findall, narrow(pattern).findall, re.compile("[\x00-\u024f]*").fullmatch
        replay, known, ids, held = MergeReplay(ranks), _Words(), [], 0
        for batch, texts in _pieces(batches, text):
            if held > CACHE_BYTES:
                known, ids, held = _Words(), [], 0
            rows = []
            for value in texts:
                s = value.as_py().decode("utf-8", "replace")
                rows.append(array("I", map(known.__getitem__, (near if only_near(s) else wide)(s))))
            raw = [w.encode() for w in islice(known, len(ids), None)]
            ids += replay.encode(raw)
            held += sum(map(len, raw)) + 250 * len(raw)
            look = ids.__getitem__
            yield _made(batch, keep, [b"".join(map(look, row)) for row in rows], schema)

    return run


def _decoder(ranks: dict[bytes, int], ids: str, keep: list[str], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = {i: t for t, i in ranks.items()}.__getitem__
        for batch, column in _pieces(batches, ids):
            yield _made(batch, keep, [b"".join(map(look, np.frombuffer(v.as_py(), "<u4").tolist())) for v in column], schema)

    return run


def _schemas(df: DataFrame, drop: set[str], added: str) -> tuple[list[str], T.StructType, pa.Schema]:
    keep = [c for c in df.columns if c not in drop]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(added, T.BinaryType())])
    return keep, schema, to_arrow_schema(schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replaces ``text`` by ``ids``: the token ids as little-endian unsigned 32-bit integers in one binary."""
    keep, schema, arrow = _schemas(docs, {text, ids}, ids)
    return map_arrow(docs.select(*map(column, keep), text_bytes(text).alias(text)), released(_encoder(ranks, pattern, text, keep, arrow)), schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: the bytes that the ids stand for."""
    keep, schema, arrow = _schemas(encoded, {text}, text)
    return map_arrow(encoded.select(*(text_bytes(c).alias(c) if c == ids else column(c) for c in keep)), released(_decoder(ranks, ids, keep, arrow)), schema)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the documents: replaces ``text`` by ids and decoded."""
    keep, schema, arrow = _schemas(docs, {text, "ids", "decoded"}, "ids")
    both = T.StructType([*schema.fields, T.StructField("decoded", T.BinaryType())])
    first = _encoder(ranks, pattern, text, keep, arrow)
    second = _decoder(ranks, "ids", [*keep, "ids"], to_arrow_schema(both))
    return map_arrow(docs.select(*map(column, keep), text_bytes(text).alias(text)), released(lambda batches: second(first(batches))), both)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, by an encoding and a decoding of the ids."""
    return round_trip(docs.select("doc_id", "text"), ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
