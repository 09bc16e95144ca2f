"""The engine's tables, derived from the star schema and corpora that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import chunk_id, diff_vector_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelist_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that a changelist (an order) touches: brand/name of its parts."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_name").alias("file_path"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    return lines.select(F.col("l_orderkey").cast("string").alias("changelist_id"), "file_path").distinct()


FILES_SQL = "cf AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS changelist_id, p_brand || '/' || p_name AS file_path FROM lineitem JOIN part ON l_partkey = p_partkey)"


def changelists(spark: SparkSession, sf_dir: str, files: bool = True) -> DataFrame:
    """Orders with their customer as author; ``files`` sorted."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
    message = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    out = orders.join(customer, "o_custkey").select(F.col("o_orderkey").cast("string").alias("id"), "author", F.col("o_orderdate").alias("ts"), message.alias("message"))
    if not files:
        return out
    paths = changelist_files(spark, sf_dir).groupBy(F.col("changelist_id").alias("id")).agg(F.array_sort(F.collect_list("file_path")).alias("files"))
    return out.join(paths, "id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


CHANGELISTS_SQL = (
    "cl AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS author, o_orderdate AS ts, concat_ws(' ', o_orderstatus, o_orderpriority) AS message "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection, id, embedding: metadata, diff chunks and file chunks by vec_id modulo 3; a changelist or file is vec_id modulo 100."""
    e = table(spark, sf_dir, "embeddings")
    parent, chunk = (F.col("vec_id") % 100).cast("string"), F.floor(F.col("vec_id") / 100)
    kind = F.col("vec_id") % 3
    id = F.when(kind == 0, F.col("vec_id").cast("string")).when(kind == 1, diff_vector_id(parent, chunk)).otherwise(chunk_id(parent, chunk))
    return e.select(F.when(kind == 0, "metadata").when(kind == 1, "diffs").otherwise("files").alias("collection"), id.alias("id"), "embedding", "vec_id")


VECTORS_SQL = (
    "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE vec_id % 3 WHEN 0 THEN 'metadata' WHEN 1 THEN 'diffs' ELSE 'files' END AS collection, "
    "CASE vec_id % 3 WHEN 0 THEN CAST(vec_id AS VARCHAR) WHEN 1 THEN (vec_id % 100) || '_chunk_' || (vec_id // 100) "
    "ELSE 'file:' || (vec_id % 100) || ':chunk_' || (vec_id // 100) END AS id FROM embeddings), "
    "q AS (SELECT e FROM v WHERE vec_id = 0), "
    "s AS (SELECT vec_id, collection, id, greatest(0, least(1, coalesce(list_cosine_similarity(v.e, q.e), 0))) AS score FROM v, q)"
)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query of the registered searches: vector 0."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, file_path, text."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select("doc_id", path.alias("file_path"), F.coalesce("text", F.lit("")).alias("text"))


DOCUMENTS_SQL = "d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS file_path, coalesce(text, '') AS text FROM documents)"
