"""Filters, thresholds and the final order of search results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_users(df: DataFrame, users: Sequence[str] | None, author: str = "author") -> DataFrame:
    """Changelists by one of the authors, exactly."""
    return df.where(F.col(author).isin(*users)) if users else df


def touching_files(df: DataFrame, files: Sequence[str] | None, paths: str = "files") -> DataFrame:
    """Changelists with one of the paths, exactly."""
    return df.where(F.arrays_overlap(paths, F.array(*map(F.lit, files)))) if files else df


def in_files(df: DataFrame, parts: Sequence[str] | None, path: str = "file_path") -> DataFrame:
    """Chunks whose path holds one of the strings."""
    if not parts:
        return df
    any_: Column = F.lit(False)
    for p in parts:
        any_ = any_ | F.contains(F.col(path), F.lit(p))
    return df.where(any_)


def min_score(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= least)


def relative_threshold(df: DataFrame, share: float, score: str = "score") -> DataFrame:
    """Rows within ``share`` of the range under the top score; a range counts as 1 at least. 1.0 or more keeps all.

    The range is a one-row aggregate joined back, so rows stay where they are.
    """
    if share >= 1.0:
        return df
    ends = df.agg(F.max(score).alias("__top"), F.min(score).alias("__low"))
    cutoff = F.col("__top") - F.greatest(F.lit(1.0), F.col("__top") - F.col("__low")) * share
    return df.crossJoin(F.broadcast(ends)).where(F.col(score) >= cutoff).drop("__top", "__low")


def best(df: DataFrame, n: int, score: str = "score", tie: str = "result_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(n)


def combined(commits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both kinds of results by falling score; changelists first on ties, then by id. Columns of one kind are null in the other."""
    both = commits.withColumn("kind", F.lit(0)).unionByName(chunks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.orderBy(F.desc("score"), "kind", "result_id").drop("kind")


def distinct_results(df: DataFrame) -> DataFrame:
    """One row for each result and source."""
    return df.dropDuplicates(["result_id", "source"])
