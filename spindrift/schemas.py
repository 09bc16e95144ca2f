"""Schemas of the engine's tables. Embeddings live in their own table; lists are arrays, times are UTC timestamps."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


def _table(**columns: object) -> StructType:
    return StructType([StructField(name, kind() if isinstance(kind, type) else kind) for name, kind in columns.items()])


STRINGS = ArrayType(StringType())

CHANGELISTS = _table(
    id=StringType, expert_name=StringType, ts=TimestampType, author=StringType, message=StringType, diff=StringType,
    files=STRINGS, review_comments=StringType,
)
CHANGELIST_FILES = _table(changelist_id=StringType, file_path=StringType)
FILE_CONTENTS = _table(
    file_path=StringType, expert_name=StringType, revision_id=StringType, file_size=LongType, content_bytes=LongType,
    chunk_count=IntegerType, last_indexed_at=TimestampType,
)
FILE_CHUNKS = _table(
    id=StringType, file_path=StringType, chunk_index=IntegerType, content=StringType, line_start=IntegerType, line_end=IntegerType, revision_id=StringType,
)
VECTORS = _table(collection=StringType, id=StringType, embedding=ArrayType(FloatType()))
#: An index of vectors: the centres of a collection's cells, the centres of the parts of what is left, and every vector's cell and code.
VECTOR_CELLS = _table(collection=StringType, cell=IntegerType, centre=ArrayType(FloatType()))
VECTOR_BOOKS = _table(collection=StringType, part=IntegerType, centres=ArrayType(ArrayType(FloatType())))
VECTOR_CODES = _table(collection=StringType, id=StringType, cell=IntegerType, code=BinaryType)
PROMPT_CACHE = _table(id=StringType, prompt=StringType)
EXPERTS = _table(
    name=StringType, workspace_path=StringType, subdirs=STRINGS, vcs_type=StringType, created_at=TimestampType,
    last_indexed_at=TimestampType, last_processed=StringType, first_processed=StringType, first_batch_last=StringType,
    max_commits=IntegerType, embed_diffs=BooleanType, embed_metadata=BooleanType, embedder=StringType,
    frontier=STRINGS, target=StringType, listed=LongType, place=LongType,
)

#: Collections of vectors, which partition their table.
METADATA, DIFFS, FILES = "metadata", "diffs", "files"

#: Key columns of each table: a later row with the same key replaces an earlier one.
KEYS: dict[str, tuple[str, ...]] = {
    "changelists": ("id",),
    "changelist_files": ("changelist_id", "file_path"),
    "file_contents": ("file_path",),
    "file_chunks": ("id",),
    "vectors": ("collection", "id"),
    "prompt_cache": ("id",),
    "experts": ("name",),
    "vector_cells": ("collection", "cell"),
    "vector_books": ("collection", "part"),
    "vector_codes": ("collection", "id"),
}
TABLES: dict[str, StructType] = {
    "changelists": CHANGELISTS,
    "changelist_files": CHANGELIST_FILES,
    "file_contents": FILE_CONTENTS,
    "file_chunks": FILE_CHUNKS,
    "vectors": VECTORS,
    "prompt_cache": PROMPT_CACHE,
    "experts": EXPERTS,
    "vector_cells": VECTOR_CELLS,
    "vector_books": VECTOR_BOOKS,
    "vector_codes": VECTOR_CODES,
}
SEARCH_HITS = _table(result_id=StringType, score=DoubleType, source=StringType, vector_id=StringType)
