"""Registered queries of scalar text functions, codecs, embedders and budgets."""

from __future__ import annotations

import hashlib
import json
import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import codec, models, providers, text
from spindrift.plans import derived as d
from spindrift.plans import indexing
from spindrift.plans.catalog import _CHUNKS, _DOC, _TAIL, HASHED, _chunks, _docs
from spindrift.plans.registry import literal_rows, query


def _sql_text(s: str) -> str:
    return " || ".join(f"'{part}'" if part else "''" for part in s.replace("'", "''").split("\n")).replace(" || ", " || chr(10) || ")


_CUT = "CASE WHEN octet_length(encode(text)) <= {n} THEN text ELSE decode(unhex(regexp_replace(substr(hex(encode(text)), 1, 2 * {n}), '{tail}', ''))) END"


@query(
    f"WITH b AS (SELECT doc_id, text, {_CUT.format(n=300, tail=_TAIL)} AS b FROM {_DOC}), t AS (SELECT doc_id, text, CASE WHEN length(b) / 4.0 <= 50 THEN b ELSE substr(b, 1, 200) END AS t FROM b) "
    f"SELECT doc_id, CASE WHEN t = text THEN text ELSE t || {_sql_text(text.EMBEDDING_CUT)} END AS cut FROM t"
)
def truncate_for_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate_for_embedding(F.col("text"), 300, 50).alias("cut"))


@query(f"SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 150 THEN text ELSE {_CUT.format(n=150, tail=_TAIL)} || {_sql_text(text.SIZE_CUT)} END AS cut FROM {_DOC}")
def truncated_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncated_diff(F.col("text"), 150).alias("cut"))


@query(f"WITH {_CHUNKS} SELECT id, file_path || ' (lines ' || (chunk_index + 1) || '-' || (chunk_index + 2) || ')' AS title FROM ck")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", text.display_title(F.col("file_path"), F.col("line_start"), F.col("line_start") + 1).alias("title"))


@query(
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(' ' || p_name || ' , ' || p_brand || ',,' || p_type || ', ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part"
)
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.concat(F.lit(" "), "p_name", F.lit(" , "), "p_brand", F.lit(",,"), "p_type", F.lit(", "))
    return d.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_list(listed), "|").alias("items"))


_QUOTED = "CASE p_partkey % 6 WHEN 0 THEN '\"' || p_name || '\"' WHEN 1 THEN ' ''' || p_name || ''' ' WHEN 2 THEN '\"''' || p_name || '''\"' WHEN 3 THEN p_name WHEN 4 THEN '\"' ELSE '\"' || p_name END"


def _strip(q: str, of: str) -> str:
    return f"CASE WHEN starts_with({of}, {q}) AND ends_with({of}, {q}) THEN substr({of}, 2, greatest(length({of}) - 2, 0)) ELSE {of} END"


@query(f"WITH a AS (SELECT p_partkey, trim({_QUOTED}) AS s FROM part), b AS (SELECT p_partkey, {_strip(chr(39) + chr(34) + chr(39), 's')} AS s FROM a) SELECT p_partkey, {_strip(chr(39) * 4, 's')} AS said FROM b")
def unquoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    around = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    said = F.when(k == 0, around('"', '"')).when(k == 1, around(" '", "' ")).when(k == 2, around("\"'", "'\"")).when(k == 3, name).when(k == 4, F.lit('"')).otherwise(around('"', ""))
    return d.table(spark, sf_dir, "part").select("p_partkey", text.unquoted(said).alias("said"))


@query(
    "SELECT event_id, date_trunc('second', ts) AS from_epoch, date_trunc('second', ts) AS from_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(NULL AS TIMESTAMP) AS from_other FROM events"
)
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: c.cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp")
    e = d.table(spark, sf_dir, "events").withColumn("ts", ts)
    return e.select(
        "event_id", plain(text.epoch_to_timestamp(F.unix_timestamp("ts"))).alias("from_epoch"), plain(text.perforce_timestamp(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))).alias("from_text"),
        text.iso_timestamp(F.col("ts")).alias("iso"), plain(text.perforce_timestamp(F.date_format("ts", "yyyy-MM-dd"))).alias("from_other"),
    )


@query(
    r"SELECT name, regexp_full_match(name, '[\p{L}\p{N}_-]+') AS valid FROM (SELECT n_name AS name FROM nation UNION SELECT p_name FROM part UNION SELECT p_brand FROM part UNION SELECT c_mktsegment || '-' || c_nationkey || 'é' FROM customer UNION SELECT '')"
)
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: d.table(spark, sf_dir, name)
    made = t("customer").select(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("é")))
    names = t("nation").select("n_name").union(t("part").select("p_name")).union(t("part").select("p_brand")).union(made).union(spark.range(1).select(F.lit(""))).toDF("name").distinct()
    return names.select("name", text.valid_name(F.col("name")).alias("valid"))


@query(f"SELECT doc_id, text, true AS smaller FROM {_DOC} WHERE length(text) > 2000 UNION ALL SELECT doc_id, text, NULL FROM {_DOC} WHERE length(text) <= 2000")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _docs(spark, sf_dir).withColumn("packed", codec.compress("text"))
    smaller = F.when(F.length("text") > 2000, F.octet_length("packed") < F.octet_length("text"))
    return packed.select("doc_id", codec.decompress("packed").alias("text"), smaller.alias("smaller"))


@query(
    "WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, CASE WHEN length(unnest(p)) > 4096 THEN substr(unnest(p), 1, 4076) || '...[line truncated]' ELSE unnest(p) END AS s "
    f"FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {_DOC} WHERE length(text) >= 128 AND NOT contains(substr(text, 1, 8192), chr(0)) AND "
    "len(list_filter(regexp_extract_all(substr(hex(encode(text)), 1, 16384), '..'), lambda h: h BETWEEN '20' AND '7E' OR h IN ('09', '0A', '0D'))) >= 0.85 * least(8192, octet_length(encode(text))))), "
    "f AS (SELECT doc_id, i, length(s) + 1 AS used, 0 AS k FROM l WHERE i = 1 UNION ALL "
    "SELECT l.doc_id, l.i, CASE WHEN f.used + length(l.s) + 1 > 4096 THEN length(l.s) + 1 ELSE f.used + length(l.s) + 1 END, "
    "CASE WHEN f.used + length(l.s) + 1 > 4096 THEN f.k + 1 ELSE f.k END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1), "
    f"{d.DOCUMENTS_SQL}, g AS (SELECT doc_id, k, min(i)::INTEGER AS line_start, max(i)::INTEGER AS line_end FROM f GROUP BY 1, 2) "
    "SELECT 'file:' || file_path || ':chunk_' || k AS id, file_path, k::INTEGER AS chunk_index, line_start, line_end, 'r1' AS revision_id FROM g JOIN d USING (doc_id)"
)
def indexable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the files that are texts of some length."""
    files = d.documents(spark, sf_dir).select("file_path", F.col("text").alias("content"))
    return indexing.file_chunks(files, "r1").select("id", "file_path", "chunk_index", "line_start", "line_end", "revision_id")


# --- embedders


@query(f"WITH {HASHED}, n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM hs GROUP BY 1) SELECT doc_id, bucket, floor(CAST(CAST(n / norm AS FLOAT) AS DOUBLE) * 1000000.0)::BIGINT AS millionths FROM hs JOIN n USING (doc_id)")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the default embedder, batched by tokens in Arrow, by their components that aren't 0."""
    vectors = _docs(spark, sf_dir).select("doc_id", models.embedding(F.col("text")).alias("v"))
    each = vectors.select("doc_id", F.posexplode("v").alias("bucket", "value")).where("value <> 0")
    return each.select("doc_id", "bucket", F.floor(F.col("value").cast("double") * 1000000.0).alias("millionths"))


_PREFIX, _SHORT = providers.TASK_PREFIX, 64
_PREFIX_COUNTS = ", ".join(f"({int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 512})" for w in re.findall("[a-z0-9]+", _PREFIX.lower()))


@query(
    f"WITH {HASHED}, a AS (SELECT doc_id, bucket, n FROM hs UNION ALL SELECT doc_id, b, 1 FROM documents, (VALUES {_PREFIX_COUNTS}) p(b)), s AS (SELECT doc_id, bucket, sum(n) AS n FROM a GROUP BY 1, 2), "
    f"n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM s GROUP BY 1) SELECT doc_id, bucket, floor(CAST(CAST(n / norm AS FLOAT) AS DOUBLE) * 1000000.0)::BIGINT AS millionths FROM s JOIN n USING (doc_id) WHERE bucket < {_SHORT}"
)
def truncated_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task prefix before each text, and only the first components of the vector, not scaled again."""
    models.EMBEDDERS["hashing-short"] = partial(models.Truncated, models.HashingEmbedder(), _SHORT, _PREFIX)
    vectors = _docs(spark, sf_dir).select("doc_id", models.embedding(F.col("text"), "hashing-short").alias("v"))
    each = vectors.select("doc_id", F.posexplode("v").alias("bucket", "value")).where("value <> 0")
    return each.select("doc_id", "bucket", F.floor(F.col("value").cast("double") * 1000000.0).alias("millionths"))


def _stand_in(**request: object) -> dict:
    """A service that answers with the length of the text and the model's name's."""
    asked = json.loads(request["body"])["inputText"]
    return {"body": json.dumps({"embedding": [float(len(asked)), float(len(request["modelId"]))]})}


@query(f"SELECT doc_id, length(text)::DOUBLE AS a, {float(len(providers.HOSTED_EMBEDDER))}::DOUBLE AS b FROM {_DOC}")
def hosted_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosted embedder's requests, answered by a stand-in for the service."""
    models.EMBEDDERS["hosted-stand-in"] = partial(providers.HostedEmbedder, _stand_in)
    v = models.embedding(F.col("text"), "hosted-stand-in").alias("v")
    return _docs(spark, sf_dir).select("doc_id", v).select("doc_id", F.col("v")[0].cast("double").alias("a"), F.col("v")[1].cast("double").alias("b"))


@query(literal_rows({"kind": "VARCHAR", "gpu_gb": "DOUBLE", "tokens": "BIGINT", "capacity": "DOUBLE"}, [("embed", 0.0, 24576, 96.0), ("embed", 8.0, 98304, 384.0), ("rerank", 0.0, 12288, 48.0), ("rerank", 1.5, 9216, 36.0)]), fixed=True)
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = {"embed": models.EMBED_TOKENS_PER_GB, "rerank": models.RERANK_TOKENS_PER_GB}
    rows = [(kind, gb, models.budget(per[kind], gb or None)) for kind, gb in (("embed", 0.0), ("embed", 8.0), ("rerank", 0.0), ("rerank", 1.5))]
    return spark.createDataFrame([(k, g, n, n / models.UNIT_TOKENS) for k, g, n in rows], "kind string, gpu_gb double, tokens long, capacity double")
