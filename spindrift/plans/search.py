"""Search: three vector scans, pooling and merging, hydration, filters, thresholds, reranking, one ordered result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.models import EMBEDDERS, RERANKERS, create, rerank
from spindrift.functions.text import metadata_text
from spindrift.operators import rank, vector
from spindrift.operators.store import Store
from spindrift.plans import learned, lexical, vector_index
from spindrift.schemas import DIFFS, FILES, METADATA

SCOPES = {"all": (True, True, True), "metadata": (True, False, False), "diffs": (False, True, False), "files": (False, False, True)}
OVERFETCH = 3


@dataclass(frozen=True)
class QueryParams:
    """A query; ValueError for values out of range."""

    prompt: str
    max_changes: int = 10
    max_file_chunks: int = 10
    users: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    scope: str = "all"
    min_score: float = 0.1
    relative_threshold: float = 0.8
    reranker: str | None = "lexical"
    file_pooling: str = "last"
    prefilter: bool = False
    probes: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "prompt", self.prompt.strip())
        if not self.prompt:
            raise ValueError("the prompt is empty")
        for name in ("max_changes", "max_file_chunks"):
            if not 1 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be from 1 to 100")
        if self.probes < 0:
            raise ValueError("probes must be 0 (the exact scan) or more")
        if self.scope not in SCOPES:
            raise ValueError(f"scope must be one of {', '.join(SCOPES)}")


#: Another way to the nearest vectors: id and score of the k best of a collection.
Near = Callable[[str, list[float], int], DataFrame]


def _scan(vectors: DataFrame, collection: str, query: list[float], k: int, near: Near | None = None) -> DataFrame:
    """vector_id and score of the nearest vectors of a collection, with their rank."""
    hits = near(collection, query, k) if near else vector.top_k(vectors.where(F.col("collection") == collection).select("id", "embedding"), query, k)
    return hits.select(F.col("id").alias("vector_id"), "score")


def commit_scores(vectors: DataFrame, query: list[float], k: int, metadata: bool = True, diffs: bool = True, near: Near | None = None) -> DataFrame:
    """result_id, score, source, vector_id of changelists."""
    none = vectors.sparkSession.createDataFrame([], "vector_id string, score double")
    m = _scan(vectors, METADATA, query, k, near) if metadata else none
    d = _scan(vectors, DIFFS, query, k, near) if diffs else none
    pooled = vector.pooled(d.withColumn("result_id", vector.parent_of_diff(F.col("vector_id"))))
    return vector.merged(m.select(F.col("vector_id").alias("result_id"), "score"), pooled)


def chunk_scores(vectors: DataFrame, query: list[float], k: int, pooling: str = "last", near: Near | None = None) -> DataFrame:
    """result_id (a chunk's vector id), score, source, vector_id: one chunk for each file."""
    hits = _scan(vectors, FILES, query, k, near)
    files = vector.file_scores(hits.withColumn("result_id", vector.parent_of_file(F.col("vector_id"))), pooling)
    return files.select(F.col("vector_id").alias("result_id"), "score", F.lit("file").alias("source"), "vector_id")


def _finish(found: DataFrame, p: QueryParams, text: Column, limit: int) -> DataFrame:
    """Both thresholds on cosine scores; then, with a reranker, its scores and the relative threshold again."""
    found = rank.relative_threshold(rank.min_score(found, p.min_score), p.relative_threshold).withColumn("search_score", F.col("score"))
    if p.reranker:
        scored = rerank(found.withColumn("__text", text), p.prompt, "result_id", "__text", p.reranker)
        found = found.drop("score").join(scored.withColumnRenamed("rerank_score", "score"), "result_id")
        found = rank.relative_threshold(found, p.relative_threshold)
    return rank.best(found, limit)


#: How rows of a table come to the results: the results with an id column, the table's name -> the rows with these ids.
Rows = Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]


def search(store_tables: dict[str, DataFrame], query: list[float], p: QueryParams, near: Near | None = None, rows: Rows | None = None) -> DataFrame:
    """One plan from the tables (changelists, file_chunks, vectors) to ordered results of both kinds.

    ``near`` replaces the scan of vectors, ``rows`` the join with whole tables; a prefilter needs both tables and scan. Columns: result_type, result_id, score,
    search_score, source, vector_id, and those of changelists or chunks.
    """
    metadata, diffs, files = SCOPES[p.scope]
    times = OVERFETCH if p.reranker else 1
    vectors, commits, chunks = store_tables["vectors"], store_tables["changelists"], store_tables["file_chunks"]
    if p.prefilter:  # opt-in: the filters choose among all vectors, not among the nearest
        vectors, near = prefiltered(vectors, commits, chunks, p), None
    rows = rows or (lambda found, table: (found, store_tables[table]))
    sides = []
    if metadata or diffs:
        found, own = rows(rank.best(commit_scores(vectors, query, p.max_changes * times, metadata, diffs, near), p.max_changes * times), "changelists")
        found = found.join(own.withColumnRenamed("id", "result_id"), "result_id")
        found = rank.touching_files(rank.by_users(found, p.users), p.files)
        text = metadata_text(F.col("message"), F.col("files"), F.col("review_comments"))
        sides.append(_finish(found, p, text, p.max_changes).withColumn("result_type", F.lit("commit")))
    if files:
        found, own = rows(rank.best(chunk_scores(vectors, query, p.max_file_chunks * times, p.file_pooling, near), p.max_file_chunks * times), "file_chunks")
        found = rank.in_files(found.join(own.withColumnRenamed("id", "result_id"), "result_id"), p.files)
        sides.append(_finish(found, p, F.col("content"), p.max_file_chunks).withColumn("result_type", F.lit("file_chunk")))
    if len(sides) == 2:
        return rank.combined(*sides)
    return sides[0].orderBy(F.desc("score"), "result_id")


def prefiltered(vectors: DataFrame, commits: DataFrame, chunks: DataFrame, p: QueryParams) -> DataFrame:
    """The vectors of the changelists and chunks that pass the filters."""
    own = rank.touching_files(rank.by_users(commits, p.users), p.files).select("id")
    parent = vectors.where(F.col("collection") != FILES).withColumn("__id", vector.parent_of_diff(F.col("id")))
    kept = parent.join(own.withColumnRenamed("id", "__id"), "__id", "left_semi").drop("__id")
    return kept.unionByName(vectors.where(F.col("collection") == FILES).join(rank.in_files(chunks, p.files).select("id"), "id", "left_semi").select(*vectors.columns))


class Engine:
    """An index under ``root`` and the models to search it with."""

    def __init__(self, spark: SparkSession, root: str, embedder: str = "hashing"):
        self.spark, self.store, self.embedder = spark, Store(spark, root), learned.use(spark, embedder)

    def embed(self, text: str) -> list[float]:
        return create(EMBEDDERS, self.embedder).embed_batch([text])[0]

    def search(self, params: QueryParams) -> DataFrame:
        """The results in the store's newest version. The best rows of each side (300 at most) come to the driver, and theirs alone are looked up."""
        at = self.store.snapshot()
        given, params = params.reranker, replace(params, reranker=lexical.use(self.spark, params.reranker, params.prompt))

        def rows(found: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
            best = found.collect()
            return self.spark.createDataFrame(best, found.schema), at.lookup(table, "id", [r.result_id for r in best])

        near = (lambda collection, query, k: vector_index.top_k(at, collection, query, k, params.probes)) if params.probes else None
        tables = {t: at.table(t) for t in ("changelists", "file_chunks", "vectors")}
        try:
            return search(tables, self.embed(params.prompt), params, near, rows)
        finally:
            if params.reranker != given:  # it was for this query alone
                RERANKERS.pop(params.reranker, None)


def table_rows(results: DataFrame, debug: bool = False) -> DataFrame:
    """Results as text for a terminal: short id, source, author or place, preview, scores with three places, time."""
    commit = F.col("result_type") == "commit"
    name = F.element_at(F.split(F.col("file_path"), "/", -1), -1)
    place = F.concat(F.col("file_path"), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    text = F.when(commit, F.col("message")).otherwise(F.col("content"))
    short = F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text)
    columns = [
        F.substring(F.when(commit, F.col("result_id")).otherwise(name), 1, 16).alias("id"), F.col("source"),
        F.coalesce(F.col("author"), F.when(~commit, place), F.lit("N/A")).alias("author"), short.alias("message"),
        F.format_string("%.3f", "score").alias("score"),
        F.when(commit, F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))).otherwise("HEAD (indexed)").alias("timestamp"),
    ]
    if debug:
        columns += [F.coalesce("vector_id", F.lit("N/A")).alias("vector_id"), F.format_string("%.3f", "search_score").alias("search")]
    return results.select(*columns)


# The names of the exported fields, and the words and marks of the renderings below.


def json_rows(results: DataFrame) -> DataFrame:
    """One JSON object a row, in two shapes by type."""
    commit = F.struct(F.col("result_id").alias("id"), F.col("result_type").alias("type"), "author", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "message", "files", "diff", F.col("score").alias("similarity_score"), "source")
    chunk = F.struct(F.col("result_id").alias("id"), F.col("result_type").alias("type"), "file_path", F.array("line_start", "line_end").alias("line_range"), "content", "revision_id", F.col("score").alias("similarity_score"), "source")
    return results.select("result_type", "result_id", F.when(F.col("result_type") == "commit", F.to_json(commit)).otherwise(F.to_json(chunk)).alias("json"))


def export(results: DataFrame, query: str, expert: str, users: tuple[str, ...] = (), files: tuple[str, ...] = ()) -> dict:
    """A query's results as one document."""
    import json

    rows = [json.loads(r.json) for r in json_rows(results).collect()]
    return {"query": query, "expert": expert, "filters": {"users": list(users) or None, "files": list(files) or None}, "results": rows}


def markdown(results: DataFrame, query: str, most: int = 5000) -> str:
    """A query's results as Markdown."""
    rows = results.collect()
    if not rows:
        return f"No matching commits found for query: {query}"
    cut = lambda s: s if len(s) <= most else f"{s[:most]}\n... (truncated, {len(s)} total chars)"
    out = [f"# Query Results: {query}\n", f"Found {len(rows)} matching commits\n"]
    for i, r in enumerate(rows, 1):
        if r.result_type == "commit":
            ts = r.ts.isoformat() if isinstance(r.ts, datetime) else ""
            out += [f"## {i}. Commit {r.result_id[:12]} (Score: {r.score:.3f})", f"**Author**: {r.author}", f"**Date**: {ts}", f"**Files**: {', '.join(r.files)}", f"\n**Message**:\n```\n{r.message}\n```"]
            out += [f"\n**Diff**:\n```diff\n{cut(r.diff)}\n```"] if r.diff else []
        else:
            name = r.file_path.rsplit("/", 1)[-1]
            lang = name.rsplit(".", 1)[1] if "." in name.lstrip(".") else ""
            out += [f"## {i}. File {r.file_path} (Score: {r.score:.3f})", f"**Lines**: {r.line_start}-{r.line_end}", f"**Revision**: {(r.revision_id or '')[:12]}", f"\n**Content**:\n```{lang}\n{cut(r.content)}\n```"]
        out.append("\n---\n")
    return "\n".join(out)
