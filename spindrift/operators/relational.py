"""Lookups, joins and set operators over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(df: DataFrame, value: str, id: str = "id") -> DataFrame:
    return df.where(F.col(id) == value)


def by_ids(df: DataFrame, ids: Sequence[str] | DataFrame, id: str = "id") -> DataFrame:
    """Rows with one of the ids: a list of the caller's, or a table with a column ``id``. Duplicates count once, unknown ids not at all."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id)).distinct(), id, "left_semi")
    return df.where(F.col(id).isin(*ids)) if ids else df.where(F.lit(False))


def ids_by_author(changelists: DataFrame, author: str) -> DataFrame:
    return changelists.where(F.col("author") == author).select("id")


def ids_by_files(changelist_files: DataFrame, paths: Sequence[str]) -> DataFrame:
    """The distinct changelists that touch one of the paths."""
    return changelist_files.where(F.col("file_path").isin(*paths)).select("changelist_id").distinct()


def chunks_with_contents(chunks: DataFrame, contents: DataFrame, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Chunks with their files' columns, by path and line."""
    some = chunks if ids is None else by_ids(chunks, ids)
    extra = [c for c in contents.columns if c == "file_path" or c not in chunks.columns]
    return some.join(contents.select(*extra), "file_path").orderBy("file_path", "line_start")


def chunk_ids(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).select("id")


def touched_files(changelists: DataFrame) -> DataFrame:
    """The distinct paths of the changelists."""
    return changelists.select(F.explode("files").alias("file_path")).distinct()


def split_by_tracked(touched: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched paths that are tracked, those that aren't)."""
    return touched.join(tracked, "file_path", "left_semi"), touched.join(tracked, "file_path", "left_anti")


def file_summaries(chunks: DataFrame) -> DataFrame:
    """file_path, chunk_count, file_size (bytes of the first chunk), content_bytes (of all)."""
    size = F.octet_length("content").cast("long")
    return chunks.groupBy("file_path").agg(
        F.count(F.lit(1)).cast("int").alias("chunk_count"), F.min_by(size, "chunk_index").alias("file_size"), F.sum(size).alias("content_bytes")
    )


def collection_sizes(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def page_after(feed: DataFrame, after: str | None, n: int, id: str = "id", order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """The next ``n`` rows of an ordered feed after the one with id ``after`` (from the start if None); none after an unknown id."""
    rows = feed if after is None else feed.join(F.broadcast(feed.where(F.col(id) == after).agg(F.min(order[0]).alias("__at"))), F.col(order[0]) > F.col("__at")).drop("__at")
    return rows.orderBy(*order).limit(n)


def newest_page(feed: DataFrame, page: int, size: int, order: str = "ts", tie: str = "id") -> DataFrame:
    return feed.orderBy(F.desc(order), F.desc(tie)).offset(page * size).limit(size)


def remaining(limit: int, total: int, indexed: int) -> int:
    """How many rows may still be indexed."""
    return max(0, min(limit, total) - indexed)


def expert_listing(experts: DataFrame, changelists: DataFrame) -> DataFrame:
    """Experts by name with their number of changelists."""
    n = changelists.groupBy(F.col("expert_name").alias("name")).agg(F.count(F.lit(1)).alias("commit_count"))
    return experts.join(n, "name", "left").withColumn("commit_count", F.coalesce("commit_count", F.lit(0))).orderBy("name")


def numeric_changelists(df: DataFrame, cl: str = "cl") -> DataFrame:
    """Distinct changelist numbers in numeric order."""
    return df.select(F.col(cl).cast("long").alias(cl)).distinct().orderBy(cl)


def commit_count(changelists: DataFrame) -> DataFrame:
    """One row n: how many changelists."""
    return changelists.agg(F.count(F.lit(1)).alias("n"))


def latest_time(changelists: DataFrame, ts: str = "ts") -> DataFrame:
    """One row ``ts``: the latest time."""
    return changelists.agg(F.max(ts).alias(ts))


def cached_prompt(cache: DataFrame, id: str) -> DataFrame:
    """The prompt kept for a changelist."""
    return cache.where(F.col("id") == id).select("prompt")


def cursor_of(experts: DataFrame, name: str) -> DataFrame:
    """The last changelist that an index has processed."""
    return experts.where(F.col("name") == name).select("last_processed")
