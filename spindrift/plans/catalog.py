"""The engine's registered queries on vectors, stored tables, texts and results; the other catalogs are loaded at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import models, text
from spindrift.operators import rank, relational, store, vector
from spindrift.plans import conversation, packing
from spindrift.plans import derived as d
from spindrift.plans import search as s
from spindrift.plans.registry import ORACLES, QUERIES, query
from spindrift.plans.registry import rounded as _rounded

__all__ = ["ORACLES", "QUERIES"]


# --- vectors and ranking


@query(f"WITH {d.VECTORS_SQL} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vector.top_k(d.vectors(spark, sf_dir), d.query_vector(spark, sf_dir), 10, "vec_id"), "score")


@query(f"WITH {d.VECTORS_SQL} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def cosine_topk_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vector.top_k_native(d.vectors(spark, sf_dir), d.query_vector(spark, sf_dir), 10, "vec_id"), "score")


@query(f"WITH {d.VECTORS_SQL} SELECT id, round(score, 6) AS score FROM s WHERE collection = 'metadata' ORDER BY s.score DESC, id LIMIT 10")
def metadata_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d.vectors(spark, sf_dir).where("collection = 'metadata'")
    return _rounded(vector.top_k(v, d.query_vector(spark, sf_dir), 10), "score")


_DIFF_HITS = "dh AS (SELECT id, score, split_part(id, '_chunk_', 1) AS result_id FROM s WHERE collection = 'diffs' ORDER BY score DESC, id LIMIT 60)"
_POOLED = f"{_DIFF_HITS}, dp AS (SELECT result_id, max(score) AS score, arg_max(id, score) AS vector_id FROM dh GROUP BY 1)"


@query(f"WITH {d.VECTORS_SQL}, {_POOLED} SELECT result_id, round(score, 6) AS score, vector_id FROM dp")
def diff_topk_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s._scan(d.vectors(spark, sf_dir), "diffs", d.query_vector(spark, sf_dir), 60)
    return _rounded(vector.pooled(hits.withColumn("result_id", vector.parent_of_diff(F.col("vector_id")))), "score")


_FILE_HITS = "fh AS (SELECT id, score, split_part(id, ':chunk_', 1) AS result_id FROM s WHERE collection = 'files' ORDER BY score DESC, id LIMIT 60)"


@query(f"WITH {d.VECTORS_SQL}, {_FILE_HITS} SELECT result_id, round(min(score), 6) AS score, arg_min(id, score) AS vector_id FROM fh GROUP BY 1")
def file_scores_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s._scan(d.vectors(spark, sf_dir), "files", d.query_vector(spark, sf_dir), 60)
    return _rounded(vector.file_scores(hits.withColumn("result_id", vector.parent_of_file(F.col("vector_id")))), "score")


@query(f"WITH {d.VECTORS_SQL}, {_FILE_HITS} SELECT result_id, round(max(score), 6) AS score, arg_max(id, score) AS vector_id FROM fh GROUP BY 1")
def file_scores_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s._scan(d.vectors(spark, sf_dir), "files", d.query_vector(spark, sf_dir), 60)
    return _rounded(vector.file_scores(hits.withColumn("result_id", vector.parent_of_file(F.col("vector_id"))), "max"), "score")


_MERGED = (
    f"{_POOLED}, mh AS (SELECT CAST(vec_id % 100 AS VARCHAR) AS result_id, max(score) AS score FROM (SELECT * FROM s WHERE collection = 'metadata' ORDER BY score DESC, id LIMIT 60) GROUP BY 1), "
    "mg AS (SELECT coalesce(mh.result_id, dp.result_id) AS result_id, CASE WHEN mh.score IS NOT NULL AND dp.score IS NOT NULL THEN 0.6 * mh.score + 0.4 * dp.score "
    "ELSE coalesce(mh.score, dp.score) END AS score, CASE WHEN mh.score IS NULL OR dp.score > mh.score THEN 'diff' ELSE 'metadata' END AS source, "
    "CASE WHEN mh.score IS NULL OR dp.score > mh.score THEN dp.vector_id END AS vector_id FROM mh FULL JOIN dp ON mh.result_id = dp.result_id)"
)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = d.vectors(spark, sf_dir), d.query_vector(spark, sf_dir)
    m = s._scan(v, "metadata", q, 60).groupBy((F.col("vector_id").cast("long") % 100).cast("string").alias("result_id")).agg(F.max("score").alias("score"))
    hits = s._scan(v, "diffs", q, 60).withColumn("result_id", vector.parent_of_diff(F.col("vector_id")))
    return vector.merged(m, vector.pooled(hits))


@query(f"WITH {d.VECTORS_SQL}, {_MERGED} SELECT result_id, round(score, 6) AS score, source, vector_id FROM mg")
def merge_commit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_merged(spark, sf_dir), "score")


@query(f"WITH {d.VECTORS_SQL} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.1")
def min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d.vectors(spark, sf_dir)
    n = vector.cosine(F.col("embedding"), vector.literal(d.query_vector(spark, sf_dir)))
    return _rounded(rank.min_score(v.select("vec_id", n.alias("score")), 0.1), "score")


@query(
    f"WITH {d.VECTORS_SQL}, m AS (SELECT max(score) AS hi, min(score) AS lo FROM s WHERE score >= 0.1) "
    "SELECT vec_id, round(score, 6) AS score FROM s, m WHERE score >= 0.1 AND score >= hi - greatest(1, hi - lo) * 0.8"
)
def relative_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d.vectors(spark, sf_dir)
    n = vector.cosine(F.col("embedding"), vector.literal(d.query_vector(spark, sf_dir)))
    return _rounded(rank.relative_threshold(rank.min_score(v.select("vec_id", n.alias("score")), 0.1), 0.8), "score")


_USERS = ("Customer#000000001", "Customer#000000003", "Customer#000000011")


@query(f"WITH {d.CHANGELISTS_SQL} SELECT id, author FROM cl WHERE author IN {_USERS}")
def user_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.by_users(d.changelists(spark, sf_dir, files=False), _USERS).select("id", "author")


_PATHS = ("Brand#2/small ring", "Brand#17/red widget")


@query(f"WITH {d.FILES_SQL}, a AS (SELECT changelist_id AS id, array_agg(file_path ORDER BY file_path) AS files FROM cf GROUP BY 1) SELECT id, len(files) AS n FROM a WHERE list_has_any(files, {list(_PATHS)})")
def file_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.touching_files(d.changelists(spark, sf_dir), _PATHS).select("id", F.size("files").cast("long").alias("n"))


@query(f"WITH {d.DOCUMENTS_SQL} SELECT doc_id, file_path FROM d WHERE contains(file_path, 'src1/') OR contains(file_path, '/fr/')")
def file_filter_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.in_files(d.documents(spark, sf_dir), ("src1/", "/fr/")).select("doc_id", "file_path")


@query(
    f"WITH {d.VECTORS_SQL}, {_MERGED}, {_FILE_HITS}, fs AS (SELECT arg_min(id, score) AS result_id, min(score) AS score FROM fh GROUP BY fh.result_id), "
    f"{d.CHANGELISTS_SQL}, c AS (SELECT 'commit' AS result_type, 0 AS k, mg.result_id, mg.score, mg.source, cl.author AS place FROM (SELECT * FROM mg ORDER BY score DESC, result_id LIMIT 30) mg JOIN cl ON cl.id = mg.result_id WHERE mg.score >= 0.1), "
    "ct AS (SELECT c.* FROM c, (SELECT max(score) hi, min(score) lo FROM c) WHERE score >= hi - greatest(1, hi - lo) * 0.8 ORDER BY score DESC, result_id LIMIT 10), "
    "f AS (SELECT 'file_chunk' AS result_type, 1 AS k, result_id, score, 'file' AS source, split_part(result_id, ':', 2) AS place FROM (SELECT * FROM fs ORDER BY score DESC, result_id LIMIT 30) WHERE score >= 0.1), "
    "ft AS (SELECT f.* FROM f, (SELECT max(score) hi, min(score) lo FROM f) WHERE score >= hi - greatest(1, hi - lo) * 0.8 ORDER BY score DESC, result_id LIMIT 10) "
    "SELECT result_type, result_id, round(score, 6) AS score, source, place FROM (SELECT * FROM ct UNION ALL SELECT * FROM ft)"
)
def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search plan on derived tables: both kinds, thresholds, no reranker."""
    p = s.QueryParams("vector 0", reranker=None)
    v, q = d.vectors(spark, sf_dir), d.query_vector(spark, sf_dir)
    commits = rank.best(_merged(spark, sf_dir), 30).join(d.changelists(spark, sf_dir, files=False).withColumnRenamed("id", "result_id"), "result_id")
    commits = s._finish(commits, p, F.col("message"), p.max_changes).select(F.lit("commit").alias("result_type"), "result_id", "score", "source", F.col("author").alias("place"))
    chunks = rank.best(s.chunk_scores(v, q, 60), 30).withColumn("place", F.split_part("result_id", F.lit(":"), F.lit(2)))
    chunks = s._finish(chunks, p, F.col("place"), p.max_file_chunks).select(F.lit("file_chunk").alias("result_type"), "result_id", "score", "source", "place")
    return _rounded(rank.combined(commits, chunks), "score")


_BASE_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(
    "WITH p AS (SELECT doc_id, i, substr(text, i * 2000 + 1, 2000) AS text FROM (SELECT doc_id, coalesce(text, '') AS text, "
    "unnest(range(greatest(1, CAST(ceil(length(coalesce(text, '')) / 2000.0) AS BIGINT)))) AS i FROM documents)) "
    f"SELECT doc_id, max(len(list_intersect({_BASE_WORDS}, ['the', 'and', 'license', 'de'])) / 4.0) AS score FROM p GROUP BY doc_id"
)
def rerank_lexical_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.rerank(d.table(spark, sf_dir, "documents"), "the and License de", "doc_id", "text").withColumnRenamed("rerank_score", "score")


# --- stored tables


@query(f"WITH {d.FILES_SQL} SELECT DISTINCT changelist_id FROM cf WHERE file_path IN {_PATHS}")
def changelists_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ids_by_files(d.changelist_files(spark, sf_dir), _PATHS)


@query(f"WITH {d.CHANGELISTS_SQL} SELECT id FROM cl WHERE author = 'Customer#000000001'")
def changelists_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ids_by_author(d.changelists(spark, sf_dir, files=False), "Customer#000000001")


@query(f"WITH {d.CHANGELISTS_SQL} SELECT id, author, message FROM cl WHERE id IN ('1', '7', '32', '404404404')")
def changelists_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.by_ids(d.changelists(spark, sf_dir, files=False), ["32", "7", "1", "7", "404404404"]).select("id", "author", "message")


@query(f"WITH {d.CHANGELISTS_SQL} SELECT id, author, message FROM cl WHERE id = '42'")
def changelist_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.by_id(d.changelists(spark, sf_dir, files=False), "42").select("id", "author", "message")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = d.documents(spark, sf_dir)
    part = docs.select("file_path", F.posexplode(text.chunk_fixed(F.col("text"), 1000)).alias("chunk_index", "content"))
    return part.select(text.chunk_id(F.col("file_path"), F.col("chunk_index")).alias("id"), "file_path", "chunk_index", "content", (F.col("chunk_index") + 1).alias("line_start"))


_CHUNKS = (
    f"{d.DOCUMENTS_SQL}, ck AS (SELECT 'file:' || file_path || ':chunk_' || i AS id, file_path, i AS chunk_index, substr(text, i * 1000 + 1, 1000) AS content "
    "FROM (SELECT file_path, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM d))"
)


@query(f"WITH {_CHUNKS} SELECT id, file_path, CAST(chunk_index AS INTEGER) AS chunk_index, content FROM ck")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).drop("line_start")


@query(f"WITH {_CHUNKS} SELECT ck.id, file_path, CAST(chunk_index + 1 AS INTEGER) AS line_start, length(d.text) AS size FROM ck JOIN d USING (file_path)")
def chunks_with_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = d.documents(spark, sf_dir).select("file_path", F.length("text").cast("long").alias("size"))
    return relational.chunks_with_contents(_chunks(spark, sf_dir), contents).select("id", "file_path", "line_start", "size")


@query(f"WITH {_CHUNKS} SELECT file_path, count(*)::INTEGER AS chunk_count, arg_min(octet_length(encode(content)), chunk_index) AS file_size, sum(octet_length(encode(content)))::BIGINT AS content_bytes FROM ck GROUP BY 1")
def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.file_summaries(_chunks(spark, sf_dir))


@query("SELECT count(*) AS n FROM orders")
def commit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.commit_count(d.table(spark, sf_dir, "orders"))


@query("SELECT max(o_orderdate) AS ts FROM orders")
def latest_commit_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_time(d.table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "ts"))


@query(f"WITH {d.VECTORS_SQL} SELECT collection, count(*) AS n FROM v GROUP BY 1")
def collection_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.collection_sizes(d.vectors(spark, sf_dir))


def _touched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths of the returned lines of all orders, and of the open ones."""
    lines = d.table(spark, sf_dir, "lineitem").select("*", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("file_path"))
    return lines.where("l_returnflag = 'R'").select("file_path").distinct(), lines.where("l_linestatus = 'O'").select("file_path").distinct()


_TOUCHED = "a AS (SELECT l_orderkey || '/' || l_partkey AS file_path FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey || '/' || l_partkey AS file_path FROM lineitem WHERE l_linestatus = 'O')"


@query(f"WITH {_TOUCHED} SELECT file_path FROM a INTERSECT SELECT file_path FROM b")
def touched_and_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.split_by_tracked(*_touched(spark, sf_dir))[0]


@query(f"WITH {_TOUCHED} SELECT file_path FROM a EXCEPT SELECT file_path FROM b")
def touched_minus_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.split_by_tracked(*_touched(spark, sf_dir))[1]


@query(f"WITH {d.FILES_SQL} SELECT DISTINCT file_path FROM cf")
def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.touched_files(d.changelists(spark, sf_dir))


@query("SELECT user_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = d.table(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id")).select("user_id", "event_type", "value", "ts", "seq")
    return store.latest(log, ("user_id",), "seq")


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of orders that a table of one segment's customers doesn't have yet."""
    there = d.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return store.insert_new(there, d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ("c_custkey",))


@query("SELECT event_id, ts FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page_after(d.table(spark, sf_dir, "events").select("event_id", "ts"), "500", 100, "event_id", ("event_id",))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.newest_page(d.table(spark, sf_dir, "events").select("event_id", "ts"), 2, 50, "ts", "event_id")


@query("SELECT n_name AS name, count(c_custkey) AS commit_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def expert_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = d.table(spark, sf_dir, "nation")
    rows = d.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("expert_name"))
    return relational.expert_listing(nation.select(F.col("n_name").alias("name")), rows)


@query("SELECT DISTINCT CAST(user_id AS BIGINT) AS cl FROM events")
def numeric_changelists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numeric_changelists(d.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cl")))


# --- text


_DOC = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_HEX = r"(?i)[\({]?(?:0[xXoObB]|&[hH])?(?:[0-9a-fA-F][\-,.:/ \t]*){7,}(?:[hHbBuUlLfFdD]+)?[\)}]?"
_B64 = r"[A-Za-z0-9+/_-]{32,}={0,2}"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.documents(spark, sf_dir).select("doc_id", "text")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_HEX}', '', 'g'), '{_B64}', '', 'g') AS clean FROM {_DOC}")
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.sanitize(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_HEX}', 'HEX_TOKEN', 'g'), '{_B64}', 'BASE64_TOKEN', 'g') AS clean FROM {_DOC}")
def sanitize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.sanitize(F.col("text"), replace=True).alias("clean"))


@query(
    "WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, CASE WHEN length(unnest(p)) > 1024 THEN substr(unnest(p), 1, 1004) || '...[line truncated]' ELSE unnest(p) END AS s "
    f"FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {_DOC} WHERE text <> '')), "
    "f AS (SELECT doc_id, i, length(s) + 1 AS used, 0 AS k FROM l WHERE i = 1 UNION ALL "
    "SELECT l.doc_id, l.i, CASE WHEN f.used + length(l.s) + 1 > 1024 THEN length(l.s) + 1 ELSE f.used + length(l.s) + 1 END, "
    "CASE WHEN f.used + length(l.s) + 1 > 1024 THEN f.k + 1 ELSE f.k END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1) "
    "SELECT l.doc_id, f.k::INTEGER AS chunk_index, string_agg(s, chr(10) ORDER BY l.i) AS content, min(l.i)::INTEGER AS line_start, max(l.i)::INTEGER AS line_end "
    "FROM l JOIN f ON f.doc_id = l.doc_id AND f.i = l.i GROUP BY 1, 2"
)
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_lines(_docs(spark, sf_dir), "text", 1024)


_TAIL = "(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$"


@query(f"SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 101 THEN text ELSE decode(unhex(regexp_replace(substr(hex(encode(text)), 1, 202), '{_TAIL}', ''))) END AS cut FROM {_DOC}")
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate_bytes(F.col("text"), 101).alias("cut"))


@query(f"SELECT doc_id, CASE WHEN length(text) / 4.0 <= 50 THEN text ELSE substr(text, 1, 200) END AS cut FROM {_DOC}")
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate_tokens(F.col("text"), 50).alias("cut"))


@query(f"SELECT doc_id, octet_length(encode(text)) // 4 AS tokens FROM {_DOC}")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(
    "SELECT doc_id, text <> '' AND (contains(substr(text, 1, 8192), chr(0)) OR len(list_filter(b, lambda h: h BETWEEN '20' AND '7E' OR h IN ('09', '0A', '0D'))) / nullif(len(b), 0)::DOUBLE < 0.85) AS is_binary "
    f"FROM (SELECT *, regexp_extract_all(substr(hex(encode(text)), 1, 16384), '..') AS b FROM {_DOC})"
)
def is_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.is_binary(F.col("text")).alias("is_binary"))


def _packed_sql(group: str, capacity: int) -> str:
    """The packer row by row; ``group`` is an expression of the documents."""
    return (
        f"WITH RECURSIVE t AS (SELECT {group} AS source, row_number() OVER (PARTITION BY {group} ORDER BY doc_id) AS i, doc_id, greatest(1.0, (octet_length(encode(coalesce(text, ''))) // 4) / 256.0) ** 2 AS c FROM documents), "
        f"f AS (SELECT source, i, doc_id, CASE WHEN c > {capacity} THEN -1 ELSE 0 END AS open, CASE WHEN c > {capacity} THEN 0.0 ELSE c END AS used, 0 AS b, 1 AS next FROM t WHERE i = 1 UNION ALL "
        f"SELECT t.source, t.i, t.doc_id, CASE WHEN c > {capacity} THEN open WHEN open >= 0 AND used + c <= {capacity} THEN open ELSE next END, "
        f"CASE WHEN c > {capacity} THEN used WHEN open >= 0 AND used + c <= {capacity} THEN used + c ELSE c END, "
        f"CASE WHEN c <= {capacity} AND open >= 0 AND used + c <= {capacity} THEN open ELSE next END, CASE WHEN c <= {capacity} AND open >= 0 AND used + c <= {capacity} THEN next ELSE next + 1 END "
        "FROM f JOIN t ON t.source = f.source AND t.i = f.i + 1) SELECT source, doc_id, b::INTEGER AS batch_no FROM f"
    )


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "documents").select("source", "doc_id", text.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(_packed_sql("source", 24))
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.batch_numbers(_token_counts(spark, sf_dir), "source", "doc_id", "tokens", 24 * 256)


@query(_packed_sql("'all'", 96))
def token_batches_of_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one group, in pieces that are numbered side by side."""
    one = _token_counts(spark, sf_dir).withColumn("source", F.lit("all"))
    return packing.batch_numbers(one, "source", "doc_id", "tokens", 96 * 256, piece_rows=256, fan=16)



_LISTED = f"{d.CHANGELISTS_SQL}, {d.FILES_SQL}, fl AS (SELECT changelist_id AS id, array_agg(file_path ORDER BY file_path) AS files FROM cf GROUP BY 1), m AS (SELECT cl.id, ts, author, message, coalesce(files, []) AS files FROM cl LEFT JOIN fl ON fl.id = cl.id)"


@query(
    f"WITH {_LISTED}, n AS (SELECT *, (SELECT count(*) FROM range(1, 4) t(i) WHERE i <= len(files) AND octet_length(encode(array_to_string(files[1:i], ', '))) <= 40) AS fit FROM m) "
    "SELECT id, 'Commit Message: ' || CASE WHEN length(message) > 8 THEN substr(message, 1, 8) || chr(10) || '[...' || (length(message) - 8) || ' bytes truncated]' ELSE message END || chr(10) || "
    "'Files: ' || array_to_string(files[1:fit], ', ') || CASE WHEN len(files) > fit THEN chr(10) || '[...' || (len(files) - fit) || ' files omitted]' ELSE '' END || chr(10) || 'Review Comments: ' || author AS text FROM n"
)
def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.metadata_text(F.col("message"), F.col("files"), F.col("author"), 3, 8, 40)
    return d.changelists(spark, sf_dir).select("id", out.alias("text"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS preview FROM {_DOC}")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.preview(F.col("text"), 60).alias("preview"))


_EXTENSIONS = ", ".join(f"'{k}': '{v}'" for k, v in text.LANGUAGES.items())


@query(
    f"SELECT page_id, path, coalesce(MAP {{{_EXTENSIONS}}}[CASE WHEN regexp_matches(base, '^\\.*[^.].*\\.') THEN lower('.' || split_part(base, '.', -1)) ELSE '' END], '') AS language "
    "FROM (SELECT *, split_part(path, '/', -1) AS base FROM (SELECT page_id, 'a/b.c/' || split_part(url, '/', 3) || CASE page_id % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.md' WHEN 2 THEN '/.sql' ELSE '' END AS path FROM pages))"
)
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    ext = F.when(k == 0, ".PY").when(k == 1, ".md").when(k == 2, "/.sql").otherwise("")
    pages = d.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a/b.c/"), F.split_part("url", F.lit("/"), F.lit(3)), ext).alias("path"))
    return pages.select("page_id", "path", text.language_of(F.col("path")).alias("language"))


_DIFFS = (
    "df AS (SELECT doc_id, 'diff --git a/src/' || doc_id || '.py b/src/' || doc_id || '.py' || chr(10) || '--- a/src/' || doc_id || '.py' || chr(10) || '+++ b/lib/' || (doc_id % 7) || '.py' || chr(10) || "
    "replace(coalesce(text, ''), 'diff', '') AS diff FROM documents)"
)


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of every document's whole text."""
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit("diff --git a/src/"), i, F.lit(".py b/src/"), i, F.lit(".py\n--- a/src/"), i, F.lit(".py\n+++ b/lib/"), (F.col("doc_id") % 7).cast("string"), F.lit(".py\n"))
    return _docs(spark, sf_dir).select("doc_id", F.concat(head, F.replace(F.col("text"), F.lit("diff"), F.lit(""))).alias("diff"))


@query(f"WITH {_DIFFS} SELECT doc_id, 'lib/' || (doc_id % 7) || '.py|src/' || doc_id || '.py' AS names FROM df")
def diff_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select("doc_id", F.array_join(text.diff_filenames(F.col("diff")), "|").alias("names"))


@query(
    f"WITH {_DIFFS}, b AS (SELECT *, regexp_extract_all(substr(hex(encode(diff)), 1, 16384), '..') AS b FROM df), "
    "r AS (SELECT *, list_contains(b, '00') OR len(list_filter(b, lambda h: h BETWEEN '20' AND '7E' OR h IN ('09', '0A', '0D'))) / len(b)::DOUBLE < 0.85 AS bin FROM b) "
    "SELECT doc_id, CASE WHEN bin THEN 'diff --git a/src/' || doc_id || '.py b/src/' || doc_id || '.py' || chr(10) || '[binary file: src/' || doc_id || '.py]' ELSE diff END AS diff, CASE WHEN bin THEN 1 ELSE 0 END AS n FROM r"
)
def filter_binary_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = text.filter_binary(F.col("diff"))
    return _diffs(spark, sf_dir).select("doc_id", f["diff"].alias("diff"), F.size(f["binary_files"]).alias("n"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Range: ' || substr(event_type || user_id, 1, 8) || ' → ' || substr(user_id || event_type, 1, 8) WHEN 1 THEN 'Only: ' || substr(user_id || event_type, 1, 8) ELSE 'No commits processed' END AS shown FROM events")
def commit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = d.table(spark, sf_dir, "events"), F.col("event_id") % 3
    user = F.col("user_id").cast("string")
    shown = text.commit_range(F.when(k == 0, F.concat("event_type", user)), F.when(k < 2, F.concat(user, F.col("event_type"))))
    return e.select("event_id", shown.alias("shown"))


HASHED = (
    "hs AS (SELECT doc_id, bucket, count(*)::INTEGER AS n FROM (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::UBIGINT % 512)::INTEGER AS bucket "
    "FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents)) GROUP BY 1, 2)"
)


@query(f"WITH {HASHED} SELECT * FROM hs")
def hash_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.hashed_counts(_docs(spark, sf_dir), "doc_id", "text")


# --- conversations and results


@query(
    f"WITH {_LISTED} SELECT id, 'Commit: ' || message || chr(10) || 'Files: ' || array_to_string(files[1:10], ', ') || CASE WHEN len(files) > 10 THEN ' (and ' || (len(files) - 10) || ' more)' ELSE '' END || chr(10) || 'Changes:' || chr(10) || author AS content FROM m"
)
def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.changelists(spark, sf_dir).select("id", conversation.changelist_message(F.col("message"), F.col("files"), F.col("author")).alias("content"))


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS content FROM conversations GROUP BY 1")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.transcripts(d.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(
    f"WITH {_CHUNKS} SELECT file_path, string_agg('File: ' || file_path || ' (lines ' || (chunk_index + 1) || '-' || (chunk_index + 1) || ')' || chr(10) || '```markdown' || chr(10) || content || chr(10) || '```' || chr(10), chr(10) ORDER BY chunk_index) AS content "
    "FROM ck GROUP BY 1"
)
def current_state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all documents, a row for each file."""
    return conversation.state_files(_chunks(spark, sf_dir).withColumn("line_end", F.col("line_start")))


@query(f"WITH {_LISTED} SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, author, message, len(files)::INTEGER AS n, files[1] AS first FROM m")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results go to JSON and are read back."""
    c = d.changelists(spark, sf_dir)
    null = F.lit(None)
    rows = c.select(
        F.lit("commit").alias("result_type"), F.col("id").alias("result_id"), "author", "ts", "message", "files", F.lit("").alias("diff"), F.lit(0.5).alias("score"), F.lit("metadata").alias("source"),
        null.cast("string").alias("file_path"), null.cast("int").alias("line_start"), null.cast("int").alias("line_end"), null.cast("string").alias("content"), null.cast("string").alias("revision_id"),
    )
    j = s.json_rows(rows).select(F.from_json("json", "id string, author string, timestamp string, message string, files array<string>").alias("j"))
    return j.select("j.id", F.col("j.timestamp").alias("ts"), "j.author", "j.message", F.size("j.files").alias("n"), F.get("j.files", F.lit(0)).alias("first"))


from spindrift.plans import catalog_history, catalog_search, catalog_services, catalog_values  # noqa: E402, F401
