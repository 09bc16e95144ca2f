"""Byte-compatible compression of diffs (zlib, level 6, UTF-8). Own tables rely on Parquet's codec instead."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Rows of an Arrow batch that are changed at a time.
SLICE_ROWS = 256


class CodecError(ValueError):
    """The bytes are no compressed UTF-8 text."""


def compress_text(text: str) -> bytes:
    return zlib.compress(text.encode("utf-8"), 6)


def decompress_text(raw: bytes) -> str:
    try:
        return zlib.decompress(raw).decode("utf-8")
    except (zlib.error, UnicodeDecodeError) as e:
        raise CodecError(str(e)) from e


@F.arrow_udf(BinaryType())
def compress(texts: pa.Array) -> pa.Array:
    return _each(texts, compress_text, pa.binary())


@F.arrow_udf(StringType())
def decompress(raws: pa.Array) -> pa.Array:
    return _each(raws, decompress_text, pa.string())


def _each(values: pa.Array, change: Callable, kind: pa.DataType) -> pa.Array:
    """Some rows at a time: of a batch only these are Python's objects."""
    parts = (values.slice(at, SLICE_ROWS).to_pylist() for at in range(0, len(values), SLICE_ROWS))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([None if v is None else change(v) for v in p], kind) for p in parts)])
