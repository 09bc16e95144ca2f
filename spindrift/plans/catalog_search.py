"""Registered queries of whole searches, result renderings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.models import rerank
from spindrift.operators import rank, relational
from spindrift.operators.store import Store
from spindrift.plans import conversation, lexical
from spindrift.plans import derived as d
from spindrift.plans import search as s
from spindrift.plans.catalog import _CHUNKS, _LISTED, _chunks
from spindrift.plans.registry import literal_rows, query, rounded
from spindrift.plans.scratch import folder

# --- searches: the engine's plan over derived tables


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """changelists, file_chunks and vectors; a file's chunk holds the document of its vector's number."""
    v = d.vectors(spark, sf_dir)
    commits = d.changelists(spark, sf_dir).withColumn("diff", F.lit("")).withColumn("review_comments", F.lit(None).cast("string"))
    docs = d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("content"))
    path = F.concat((F.col("vec_id") % 100).cast("string"), F.lit(".md"))
    chunks = v.where("collection = 'files'").select("vec_id", "id").join(docs, "vec_id").withColumn("file_path", path)
    chunks = chunks.select("id", "file_path", "content", F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.lit("r1").alias("revision_id"))
    return {"vectors": v.drop("vec_id"), "changelists": commits, "file_chunks": chunks}


_QUERY = "the urgent O license and Brand 2 ring de"
_WORDS = "['the', 'urgent', 'o', 'license', 'and', 'brand', '2', 'ring', 'de']"
_SHARE = f"len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9]+'), lambda w: w <> '')), {_WORDS})) / 9.0"


def _near(name: str, collection: str, k: int) -> str:
    return f"{name} AS (SELECT id, score FROM s WHERE collection = '{collection}' ORDER BY score DESC, id LIMIT {k})"


def _thresholds(name: str, of: str, least: float = 0.1, share: float = 0.8, score: str = "score") -> str:
    low = f"WHERE {score} >= {least}" if least else ""
    return f"{name}0 AS (SELECT * FROM {of} {low}), {name} AS (SELECT {name}0.* FROM {name}0, (SELECT max({score}) AS hi, min({score}) AS lo FROM {name}0) WHERE {score} >= hi - greatest(1, hi - lo) * {share})"


def _commit_side(k: int, metadata: bool = True, diffs: bool = True) -> str:
    none = "WHERE false"
    return (
        f"{_near('mh', 'metadata', k)}, {_near('dh', 'diffs', k)}, dp AS (SELECT split_part(id, '_chunk_', 1) AS result_id, max(score) AS score FROM dh {'' if diffs else none} GROUP BY 1), "
        f"mm AS (SELECT id AS result_id, score FROM mh {'' if metadata else none}), mg AS (SELECT coalesce(m.result_id, p.result_id) AS result_id, "
        "CASE WHEN m.score IS NOT NULL AND p.score IS NOT NULL THEN 0.6 * m.score + 0.4 * p.score ELSE coalesce(m.score, p.score) END AS score, "
        "CASE WHEN m.score IS NULL OR p.score > m.score THEN 'diff' ELSE 'metadata' END AS source FROM mm m FULL JOIN dp p USING (result_id)), "
        f"best AS (SELECT * FROM mg ORDER BY score DESC, result_id LIMIT {k}), found AS (SELECT 'commit' AS result_type, best.*, m.author, m.message, m.files FROM best JOIN m ON m.id = best.result_id)"
    )


_FILE_CHUNKS = "fc AS (SELECT v.id, (vec_id % 100) || '.md' AS file_path, coalesce(text, '') AS content FROM v JOIN documents ON doc_id = vec_id WHERE collection = 'files')"


def _file_side(k: int) -> str:
    return (
        f"{_near('fh', 'files', k)}, fs AS (SELECT arg_min(id, score) AS result_id, min(score) AS score FROM fh GROUP BY split_part(id, ':chunk_', 1)), {_FILE_CHUNKS}, "
        f"fbest AS (SELECT * FROM fs ORDER BY score DESC, result_id LIMIT {k}), ffound AS (SELECT 'file_chunk' AS result_type, fbest.result_id, score, 'file' AS source, file_path, content FROM fbest JOIN fc ON fc.id = result_id)"
    )


_TOLD = "'Commit Message: ' || message || chr(10) || 'Files: ' || array_to_string(files, ', ')"
_PARTS = "list_transform(range(greatest(1, CAST(ceil(length(content) / 2000.0) AS BIGINT))), lambda i: substr(content, i * 2000 + 1, 2000))"


def _found(spark: SparkSession, sf_dir: str, p: s.QueryParams) -> DataFrame:
    return s.search(_tables(spark, sf_dir), d.query_vector(spark, sf_dir), p)


@query(
    f"WITH {d.VECTORS_SQL}, {_LISTED}, {_commit_side(30)}, {_file_side(30)}, {_thresholds('c', 'found')}, "
    f"cr AS (SELECT result_type, result_id, source, score AS search_score, {_SHARE.format(_TOLD)} AS score FROM c), {_thresholds('ct', 'cr', 0)}, cl10 AS (SELECT * FROM ct ORDER BY score DESC, result_id LIMIT 10), "
    f"{_thresholds('f', 'ffound')}, fr AS (SELECT result_type, result_id, source, score AS search_score, list_max(list_transform({_PARTS}, lambda t: {_SHARE.format('t')})) AS score FROM f), "
    f"{_thresholds('ft', 'fr', 0)}, f10 AS (SELECT * FROM ft ORDER BY score DESC, result_id LIMIT 10) "
    "SELECT result_type, result_id, source, round(search_score, 6) AS search_score, round(score, 6) AS score FROM (SELECT * FROM cl10 UNION ALL SELECT * FROM f10)"
)
def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search: three scans, over-fetch, pooling, merging, hydration, thresholds, reranker, threshold again, limits."""
    found = _found(spark, sf_dir, s.QueryParams(_QUERY))
    return rounded(found.select("result_type", "result_id", "source", "search_score", "score"), "search_score", "score")


def _scope_sql(side: str, columns: str = "result_type, result_id, source") -> str:
    of = "ffound" if side == "files" else "found"
    plan = _file_side(10) if side == "files" else _commit_side(10, side == "metadata", side == "diffs")
    return f"WITH {d.VECTORS_SQL}, {_LISTED}, {plan}, {_thresholds('c', of)} SELECT {columns}, round(score, 6) AS score FROM c ORDER BY c.score DESC, result_id LIMIT 10"


def _scope(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    found = _found(spark, sf_dir, s.QueryParams("x", scope=scope, reranker=None))
    return rounded(found.select("result_type", "result_id", "source", "score"), "score")


@query(_scope_sql("metadata"))
def search_scope_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope(spark, sf_dir, "metadata")


@query(_scope_sql("diffs"))
def search_scope_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope(spark, sf_dir, "diffs")


@query(_scope_sql("files"))
def search_scope_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope(spark, sf_dir, "files")


@query(
    f"WITH {d.VECTORS_SQL}, {_LISTED}, {_FILE_CHUNKS}, own AS (SELECT id FROM m WHERE author IN (SELECT author FROM m WHERE id IN ('1', '4', '7'))), "
    "near AS (SELECT collection, id, score, row_number() OVER (PARTITION BY collection ORDER BY score DESC, id) AS n FROM s WHERE (collection = 'metadata' AND id IN (SELECT id FROM own)) OR "
    "(collection = 'diffs' AND split_part(id, '_chunk_', 1) IN (SELECT id FROM own))), dp AS (SELECT split_part(id, '_chunk_', 1) AS result_id, max(score) AS d FROM near WHERE collection = 'diffs' AND n <= 10 GROUP BY 1), "
    "mm AS (SELECT id AS result_id, score AS m FROM near WHERE collection = 'metadata' AND n <= 10), mg AS (SELECT result_id, CASE WHEN m IS NOT NULL AND d IS NOT NULL THEN 0.6 * m + 0.4 * d ELSE coalesce(m, d) END AS score "
    "FROM mm FULL JOIN dp USING (result_id)), best AS (SELECT * FROM mg ORDER BY score DESC, result_id LIMIT 10) SELECT result_id, round(score, 6) AS score FROM best JOIN m ON m.id = result_id"
)
def search_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search among the changelists of some authors: the filter chooses among all vectors."""
    tables = _tables(spark, sf_dir)
    users = [r.author for r in relational.by_ids(tables["changelists"], ["1", "4", "7"]).select("author").distinct().collect()]
    p = s.QueryParams("x", users=tuple(users), scope="all", min_score=0.0, relative_threshold=1.0, reranker=None, prefilter=True)
    return rounded(s.search(tables, d.query_vector(spark, sf_dir), p).where("result_type = 'commit'").select("result_id", "score"), "score")


_BM25 = """WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
a AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
t AS (SELECT doc_id, len(w) AS length, term, count(*) AS n FROM (SELECT doc_id, w, unnest(w) AS term FROM d) JOIN q USING (term) GROUP BY doc_id, w, term),
f AS (SELECT term, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS rare FROM t, a GROUP BY term),
s AS (SELECT doc_id, sum(rare * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM t JOIN f USING (term), a GROUP BY doc_id)"""


def _question(spark: SparkSession, sf_dir: str) -> str:
    return d.table(spark, sf_dir, "benchmark").orderBy("item_id").first().text


def _postings(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build(d.table(spark, sf_dir, "documents"), folder(spark, "postings"), "doc_id", segment=64)


@query(f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that say most of a benchmark item, by BM25; segments that can't hold one are skipped."""
    found = lexical.search(_postings(spark, sf_dir), _question(spark, sf_dir), 20, first=4).rows
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"{_BM25} SELECT d.doc_id, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN s USING (doc_id)")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored by the reranker of a lexical index."""
    asked, index = _question(spark, sf_dir), _postings(spark, sf_dir)
    name = lexical.use(spark, f"{lexical.PREFIX}{index.path}", asked)
    scored = rerank(d.table(spark, sf_dir, "documents"), asked, "doc_id", "text", name, slice_chars=1 << 30)
    return scored.select("doc_id", F.round("rerank_score", 6).alias("score"))


@query("SELECT DISTINCT event_type AS result_id, CAST(user_id % 5 AS VARCHAR) AS source FROM events")
def distinct_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.table(spark, sf_dir, "events").select(F.col("event_type").alias("result_id"), (F.col("user_id") % 5).cast("string").alias("source"), "value")
    return rank.distinct_results(rows).select("result_id", "source")


@query(literal_rows({"settings": "VARCHAR", "fails": "BOOLEAN"}, [("empty prompt", True), ("no changes", True), ("101 chunks", True), ("unknown scope", True), ("good", False)]), fixed=True)
def query_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = {"empty prompt": {"prompt": " "}, "no changes": {"prompt": "x", "max_changes": 0}, "101 chunks": {"prompt": "x", "max_file_chunks": 101}, "unknown scope": {"prompt": "x", "scope": "y"}, "good": {"prompt": " x "}}
    rows = []
    for name, settings in tried.items():
        try:
            rows.append((name, s.QueryParams(**settings).prompt != "x"))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "settings string, fails boolean")


# --- results


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every changelist as a result, and every chunk of a document."""
    null = F.lit(None)
    c = d.changelists(spark, sf_dir)
    commits = c.select(
        F.lit("commit").alias("result_type"), F.col("id").alias("result_id"), "author", "ts", "message", "files", F.lit("").alias("diff"), (F.col("id").cast("int") / 7).alias("score"), F.lit("metadata").alias("source"),
        null.cast("string").alias("file_path"), null.cast("int").alias("line_start"), null.cast("int").alias("line_end"), null.cast("string").alias("content"), null.cast("string").alias("revision_id"),
    )
    chunks = _chunks(spark, sf_dir).select(
        F.lit("file_chunk").alias("result_type"), F.col("id").alias("result_id"), null.cast("string").alias("author"), null.cast(c.schema["ts"].dataType).alias("ts"), null.cast("string").alias("message"),
        null.cast("array<string>").alias("files"), null.cast("string").alias("diff"), F.lit(0.25).alias("score"), F.lit("file").alias("source"), "file_path", "line_start", (F.col("line_start") + 1).alias("line_end"), "content",
        F.lit("r1").alias("revision_id"),
    )
    return commits.unionByName(chunks)


@query(
    f"WITH {d.CHANGELISTS_SQL}, {_CHUNKS} SELECT substr(id, 1, 16) AS id, 'metadata' AS source, author, CASE WHEN length(message) > 60 THEN substr(message, 1, 57) || '...' ELSE message END AS message, "
    "printf('%.3f', id::INTEGER / 7) AS score, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM cl UNION ALL "
    "SELECT substr(split_part(file_path, '/', -1), 1, 16), 'file', file_path || ':' || (chunk_index + 1) || '-' || (chunk_index + 2), CASE WHEN length(content) > 60 THEN substr(content, 1, 57) || '...' ELSE content END, "
    "'0.250', 'HEAD (indexed)' FROM ck"
)
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table_rows(_results(spark, sf_dir))


@query(
    f"WITH {d.CHANGELISTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY id::INTEGER) AS n FROM cl WHERE id IN ('1', '2', '3')) SELECT '# Query Results: x' || chr(10) || chr(10) || 'Found ' || count(*) || ' matching commits' || chr(10) || chr(10) || "
    "string_agg('## ' || n || '. Commit ' || id || ' (Score: ' || printf('%.3f', id::INTEGER / 7) || ')' || chr(10) || '**Author**: ' || author || chr(10) || '**Date**: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(10) || "
    "'**Files**: a, b' || chr(10) || chr(10) || '**Message**:' || chr(10) || '```' || chr(10) || message || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY n) AS markdown FROM r"
)
def result_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = relational.by_ids(_results(spark, sf_dir), ["1", "2", "3"], "result_id").withColumn("files", F.array(F.lit("a"), F.lit("b")))
    return spark.createDataFrame([(s.markdown(some.orderBy(F.col("result_id").cast("int")), "x"),)], "markdown string")


@query(f"WITH {d.CHANGELISTS_SQL}, {_CHUNKS} SELECT 'commit' AS kind, count(*) AS n FROM cl UNION ALL SELECT 'file_chunk', count(*) FROM ck")
def result_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, chunks = conversation.split_results(_results(spark, sf_dir))
    both = commits.select(F.lit("commit").alias("kind")).union(chunks.select(F.lit("file_chunk")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- conversations

_FILES_TOLD = "array_to_string(files[1:10], ', ') || CASE WHEN len(files) > 10 THEN ' (and ' || (len(files) - 10) || ' more)' ELSE '' END"
_SAID = f"'Commit: ' || message || chr(10) || 'Files: ' || {_FILES_TOLD} || chr(10) || 'Changes:' || chr(10) || substr(author, 1, 5) || chr(10) || chr(10) || '[... diff truncated for brevity ...]'"
_STATE = (
    "st AS (SELECT '=== CURRENT CODEBASE STATE (HEAD) ===' || chr(10) || chr(10) || string_agg('File: ' || file_path || ' (lines 1-2)' || chr(10) || '```markdown' || chr(10) || content || chr(10) || '```' || chr(10), "
    "chr(10) ORDER BY encode(file_path)) || chr(10) || '=== END CURRENT STATE ===' AS content FROM ffound)"
)


def _found_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the ten best files of a search: what a conversation tells as the files' state."""
    tables = _tables(spark, sf_dir)
    best = rank.best(s.chunk_scores(tables["vectors"], d.query_vector(spark, sf_dir), 10), 10).select(F.col("result_id").alias("id"))
    return tables["file_chunks"].join(best, "id")


@query(f"WITH {d.VECTORS_SQL}, {_file_side(10)}, {_STATE} SELECT content FROM st")
def current_state_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.state_message(_found_chunks(spark, sf_dir))


@query(
    f"WITH {_LISTED}, {d.VECTORS_SQL}, {_file_side(10)}, {_STATE} SELECT 0 AS section, ts, id, 1 AS seq, 'user' AS role, {_SAID} AS content FROM m UNION ALL "
    "SELECT 1, NULL, '', 0, 'user', content FROM st UNION ALL SELECT 2, NULL, '', 0, 'user', 'why?'"
)
def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = d.changelists(spark, sf_dir).withColumn("diff", F.col("author")).withColumn("ts", F.col("ts").cast("timestamp"))
    return conversation.messages(commits, "why?", _found_chunks(spark, sf_dir), most=5).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_REQUEST = f"'Commit Message: ' || message || chr(10) || 'Files Changed: ' || {_FILES_TOLD} || chr(10) || chr(10) || 'Code Changes:' || chr(10) || substr(author, 1, 8) || chr(10) || '[... truncated for brevity ...]'"


@query(f"WITH {_LISTED} SELECT id, {_REQUEST} AS request FROM m")
def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.changelists(spark, sf_dir).select("id", conversation.prompt_request(F.col("message"), F.col("files"), F.col("author"), 8).alias("request"))


@query(f"WITH {_LISTED} SELECT id, CASE WHEN id::INTEGER % 3 = 0 THEN 'kept ' || id ELSE trim(substr({_REQUEST}, 1, 200)) END AS prompt, id::INTEGER % 3 = 0 AS hit FROM m")
def generated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from a cache that has every third, the others by the generator that repeats its request."""
    commits = d.changelists(spark, sf_dir).withColumn("diff", F.col("author"))
    cache = commits.where(F.col("id").cast("int") % 3 == 0).select("id", F.concat(F.lit("kept "), "id").alias("prompt"))
    return conversation.generated_prompts(commits, cache, "echo", 8)


@query(f"WITH {_LISTED} SELECT id, CASE WHEN id::INTEGER % 3 = 0 THEN 'kept ' || id ELSE trim(substr({_REQUEST}, 1, 200)) END AS prompt FROM m")
def kept_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in a store, whose cache grows round by round; equal requests are asked once."""
    commits, own = d.changelists(spark, sf_dir).withColumn("diff", F.col("author")), Store(spark, folder(spark, "prompts"))
    own.create()
    own.upsert("prompt_cache", commits.where(F.col("id").cast("int") % 3 == 0).select("id", F.concat(F.lit("kept "), "id").alias("prompt")))
    conversation.keep_prompts(own, commits, "echo", 8, round_size=4000)
    return own.table("prompt_cache")


@query(
    f"WITH {_LISTED} SELECT 0 AS seq, id, 'user' AS role, 'ask ' || id AS content FROM m UNION ALL SELECT 1, id, 'assistant', {_SAID} FROM m UNION ALL SELECT 0, '', 'user', 'why?'"
)
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each changelist as the answer to a prompt."""
    commits = d.changelists(spark, sf_dir).withColumn("diff", F.col("author")).withColumn("generated_prompt", F.concat(F.lit("ask "), "id"))
    return conversation.messages(commits, "why?", paired=True, most=5).select("seq", "id", "role", "content")


@query(literal_rows({"mode": "VARCHAR", "starts": "VARCHAR", "playful": "BOOLEAN"}, [("normal", "You advise developers", False), ("playful", "You advise developers", True)]), fixed=True)
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(mode, (t := conversation.system_prompt(mode == "playful"))[:21], "saboteur" in t) for mode in ("normal", "playful")]
    return spark.createDataFrame(rows, "mode string, starts string, playful boolean")
