"""Helpers that several operators share: tables in the shared folder, Arrow columns as numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these bytes.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset (tests, local runs) a temporary folder of this machine, which does only
    if the executors are here too."""
    _smaller_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Paths of the tables that ``written`` made and nobody dropped yet.
_WRITTEN: list[str] = []


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spindrift/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def marked() -> int:
    """How many tables there are now, for ``drop_written``."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the tables written after the mark ``since``, but for the last ``but`` of them; results that read them must be done with."""
    gone = _WRITTEN[since : len(_WRITTEN) - but]
    del _WRITTEN[since : len(_WRITTEN) - but]
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a batch that goes to Python, where the session has Spark's own setting: several batches are held at once, and rows are whole texts.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _smaller_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH).strip("bB") == str(64 << 20):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _smaller_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _smaller_batches(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(column(name).cast("binary"), F.lit(b""))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column is called so (in any case of letters)."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its name, whatever marks the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow``, also with column names that have dots or other marks (Spark looks its own up by name); ``run`` sees and gives the names as they are."""
    names, out = df.columns, [f"r{i}" for i in range(len(schema.fields))]

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(names) for x in batches):
            yield b.rename_columns(out)

    plain = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(out, schema.fields, strict=True)])
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, plain).toDF(*schema.fieldNames())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> Column:
    """crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def give_back() -> None:
    """Gives the worker's free memory back to the machine: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as (bytes, offsets); no copy. Nulls must have been replaced."""
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(array) + 1 + array.offset)[array.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are the consecutive slices of ``values`` that end at ``ends``."""
    at = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _MUL
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
