"""WARC archives as seekable Zstandard bundles, written and read by Spark.

A bundle is a file of the .warc.zst kind: WARC/1.1 records in independent Zstandard frames of some ``FRAME_BYTES`` (a record never spans two), then a
skippable frame with the seek table of the Zstandard seekable format (sizes and checksums of the frames, read from the file's end). With it
goes a map from record identifiers to (frame, offset inside the frame, length), so that one record costs the decompression of one frame.
Bundles are rows of a table: ``content`` is the file's bytes, ``records`` the map; Spark's committer makes a lost task's retry safe, the map is read without the
contents (column pruning), and ``export`` puts the bundles down as files.

Each page is a record whose payload is its html in UTF-8 (null: empty). Of equal payloads of at least ``LEAST_BYTES`` the one with the
smallest page_id is a response, the others revisit it and hold no payload again.

Defined cases: a page without page_id is always a response and none revisits it; of rows that repeat a page_id, all that have the smallest one are
responses; a null url gives a record without WARC-Target-URI, bytes outside printable ASCII in one are percent-encoded. Empty tables give empty archives. Extra
columns are ignored. WARC-Date, which pages don't have, is a parameter. A payload may have up to 2 GB, as one row of Spark does.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import released, written

#: Payloads under this aren't deduplicated. Text of a frame and of a bundle, at which the next one begins.
LEAST_BYTES, FRAME_BYTES, BUNDLE_BYTES, LEVEL = 100, 1 << 18, 1 << 24, 3

# Fixed values of the formats: the seekable Zstandard format's marks, and names of WARC/1.1 and HTTP.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"

PLACE = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
BUNDLE = T.StructType([T.StructField("bundle_id", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("records", T.ArrayType(PLACE))])
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("refers_to_id", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


class ArchiveError(ValueError):
    """A bundle that isn't what its tables say."""


def record_uri(page: Column) -> Column:
    """The identifier of a page's record."""
    return F.concat(F.lit("urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")))


def page_of(uri: Column) -> Column:
    """The page_id of an identifier."""
    return F.nullif(F.substring_index(uri, ":", -1), F.lit("")).cast("long")


def originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: it is a response) of every page.

    Digests are counted before they are joined, and only those of several pages are; rows of one digest can be split by the planner.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    known = rows.where((F.octet_length("payload") >= LEAST_BYTES) & F.col("page_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def render(record_id: str, url: str | None, payload: bytes, digest: str, refers_to_id: str | None, date: str) -> bytes:
    """A WARC record."""
    revisit = refers_to_id is not None
    block = HTTP.format(n=len(payload)).encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {quote(url, safe=_SAFE)}"] if url is not None else []
    head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{refers_to_id}>"] if revisit else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Printable ASCII, which a header keeps as it is.
_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def parse(record: bytes) -> dict:
    """A record's fields as RECORD has them; the digest is that of the payload read, for a revisit the one it names."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ArchiveError("no WARC record at this place")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ArchiveError("a record's length isn't what its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit, said = fields["warc-type"] == "revisit", fields["warc-payload-digest"].partition(":")[2]
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = said if revisit else hashlib.sha256(payload).hexdigest()
    if digest != said or not revisit and size != len(payload):
        raise ArchiveError(f"{fields['warc-record-id']}: the payload isn't what was written")
    bare = lambda x: x and x.strip("<>")
    return {
        "record_id": bare(fields["warc-record-id"]), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to_id": bare(fields.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


class BundleWriter:
    """Collects records into frames; ``close`` gives the file's bytes with the seek table."""

    def __init__(self, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        self.packed, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.done, self.sizes, self.open, self.held, self.total, self.places = [], [], [], 0, 0, []

    def add(self, record_id: str, record: bytes) -> None:
        if self.held and self.held + len(record) > self.frame_bytes:
            self._flush()
        self.places.append((record_id, len(self.sizes), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        self.total += len(record)

    def _flush(self) -> None:
        text = b"".join(self.open)
        frame = self.packed.compress(text)
        self.done.append(frame)
        self.sizes.append((len(frame), len(text), xxhash.xxh64_intdigest(text) & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def close(self) -> bytes:
        if self.open:
            self._flush()
        table = b"".join(struct.pack("<III", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), CHECKSUMS, SEEKABLE)
        return b"".join(self.done) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Reads frames of a bundle by its seek table; holds one frame's text."""

    def __init__(self, content: bytes | memoryview):
        self.content, end = memoryview(content), len(content)
        n, flags, mark = struct.unpack("<IBI", self.content[end - 9 :]) if end >= 17 else (0, 0, 0)
        width = 12 if flags & CHECKSUMS else 8
        if mark != SEEKABLE or end < 17 + n * width:
            raise ArchiveError("no seek table at the bundle's end")
        self.frames, at, start = [], 0, end - 9 - n * width
        for i in range(n):
            entry = struct.unpack_from("<III" if width == 12 else "<II", self.content, start + i * width)
            self.frames.append((at, *entry))
            at += entry[0]
        self.unpacked, self.now, self.text = zstandard.ZstdDecompressor(), -1, b""

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.now:
            at, size, full, *check = self.frames[frame]
            self.text, self.now = self.unpacked.decompress(self.content[at : at + size], max_output_size=full), frame
            if len(self.text) != full or check and xxhash.xxh64_intdigest(self.text) & 0xFFFFFFFF != check[0]:
                raise ArchiveError(f"frame {frame} isn't what was written")
        return self.text[offset : offset + length]


def bundles(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """BUNDLE rows of ``pages`` (page_id, url, html): a task cuts its rows into bundles as they come and holds one."""
    rows = originals(pages).select(record_uri(F.col("page_id")).alias("id"), "url", "payload", "digest", F.when(F.col("refers_to").isNotNull(), record_uri(F.col("refers_to"))).alias("refers"))
    arrow = to_arrow_schema(BUNDLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            content = own.close()
            places = [dict(zip(PLACE.fieldNames(), x, strict=True)) for x in own.places]
            return pa.RecordBatch.from_pylist([{"bundle_id": hashlib.sha256(content).hexdigest()[:32], "content": content, "records": places}], schema=arrow)

        own = BundleWriter(level, frame_bytes)
        for batch in batches:
            for i in range(len(batch)):
                id, url, payload, digest, refers = (c[i].as_py() for c in batch.columns)
                own.add(id, render(id, url, payload, digest, refers, date))
                if own.total >= bundle_bytes:
                    yield made()
                    own = BundleWriter(level, frame_bytes)
        if own.total:
            yield made()

    return rows.mapInArrow(released(run), BUNDLE)


def write(pages: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """The archive of ``pages`` as a table of bundles under ``path`` (none: in the shared folder), read again. ``options``: those of ``bundles``."""
    made = bundles(pages, **options)
    large = {"compression": "none", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}  # rows are whole files
    if path is None:
        return written(made, "warc", **large)
    made.write.mode("overwrite").options(**large).parquet(path)
    return pages.sparkSession.read.schema(BUNDLE).parquet(path)


def record_map(archive: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset, length of every record; reads no contents."""
    return archive.select("bundle_id", F.explode("records").alias("r")).select("r.record_id", "bundle_id", "r.frame", "r.offset", "r.length")


def _read(archive: DataFrame) -> DataFrame:
    """RECORD rows at the places that the column ``records`` lists."""
    arrow = to_arrow_schema(RECORD)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                reader, places = BundleReader(batch.column("content")[i].as_buffer()), batch.column("records")[i].as_py()
                rows, held = [], 0
                for p in sorted(places or [], key=lambda p: (p["frame"], p["offset"])):
                    row = parse(reader.record(p["frame"], p["offset"], p["length"]))
                    if row["record_id"] != p["record_id"]:
                        raise ArchiveError(f"{p['record_id']} isn't where the map has it")
                    rows.append(row)
                    held += p["length"]
                    if held >= FRAME_BYTES << 3:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archive.select("content", "records").mapInArrow(released(run), RECORD)


def read(archive: DataFrame) -> DataFrame:
    """RECORD rows of all records; ArchiveError where bytes, lengths or digests aren't what the tables say."""
    return _read(archive)


def fetch(archive: DataFrame, ids: DataFrame) -> DataFrame:
    """RECORD rows of the records whose record_id is in ``ids``: the map chooses bundles, and of those only frames that hold one are decompressed."""
    wanted = record_map(archive).join(ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle_id").agg(F.collect_set(F.struct("record_id", "frame", "offset", "length")).alias("records"))
    # bundles of the same bytes have the same name: one of them is read, and only those that are wanted are compared
    return _read(archive.select("bundle_id", "content").join(places, "bundle_id").dropDuplicates(["bundle_id"]))


def export(archive: DataFrame, folder: str) -> DataFrame:
    """Puts each bundle down as ``<bundle_id>.warc.zst`` under ``folder`` (a URI that pyarrow's file systems reach from all machines) when the
    result, file and bytes, is evaluated. A file is complete under its name or isn't there; a retry writes the same bytes."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for i in range(len(batch)):
                name, content = f"{batch.column('bundle_id')[i].as_py()}.warc.zst", batch.column("content")[i].as_buffer()
                part = posixpath.join(base, f".{name}.{uuid.uuid4().hex}")
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, posixpath.join(base, name))
                out.append({"file": name, "bytes": len(content)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return archive.select("bundle_id", "content").mapInArrow(run, schema)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archive that it was written to."""
    records = read(write(pages)).drop("payload", "target_uri")
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to_id")).alias("refers_to"))


#: DuckDB SQL for the registered query.
ORACLE = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 AND page_id IS NOT NULL GROUP BY 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
