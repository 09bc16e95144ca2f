"""Registered queries of histories and stores: a workspace made of the nations, captured Perforce output, write cycles of a store, an index."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import api
from spindrift.operators import relational
from spindrift.operators.store import Store
from spindrift.plans import derived as d
from spindrift.plans import indexing, vector_index
from spindrift.plans.registry import literal_rows, query
from spindrift.plans.scratch import folder
from spindrift.schemas import EXPERTS, TABLES
from spindrift.sources import history, perforce
from spindrift.sources.detect import detect
from spindrift.streaming.feed import index_workspace

# --- git: a commit for each nation, then one that changes a file, one that renames one, one that deletes one

_BEGAN, _MADE = 1_700_000_000, {}


def _workspace(spark: SparkSession, sf_dir: str) -> str:
    """The path of the workspace; made once for a session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _MADE:
        return _MADE[key]
    nations = d.table(spark, sf_dir, "nation").join(d.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()
    at = Path(folder(spark, "workspace").removeprefix("file://"))
    at.mkdir(parents=True)
    number = 0

    def git(*args: str, who: str = "nobody") -> None:
        stamp = f"{_BEGAN + 3600 * number} +0000"
        names = {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who.lower()}@example.com"), ("DATE", stamp))}
        subprocess.run(["git", "-C", str(at), *args], check=True, capture_output=True, env={**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", **names})

    def commit(message: str, who: str) -> None:
        nonlocal number
        git("add", "-A")
        git("commit", "-q", "-m", message, "-m", "a body", who=who)
        number += 1

    git("init", "-q", "-b", "main")
    for r in rows:
        (at / r.r_name).mkdir(exist_ok=True)
        (at / r.r_name / f"{r.n_name}.md").write_text("".join(f"{r.n_name} of {r.r_name}, line {i} of its file\n" for i in range(1, r.n_nationkey + 6)))
        commit(f"Add {r.n_name}", r.r_name)
    first, second, third = (at / r.r_name / f"{r.n_name}.md" for r in rows[:3])
    first.write_text(first.read_text() + "one line more\n")
    commit("Change a file", "Editor")
    git("mv", str(second), str(second.with_name("renamed.md")))
    commit("Rename a file", "Editor")
    third.unlink()
    commit("Delete a file", "Editor")
    _MADE[key] = str(at)
    return _MADE[key]


_NATIONS = "na AS (SELECT n_nationkey AS k, n_name, r_name, r_name || '/' || n_name || '.md' AS file_path FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT count(*) AS n FROM na)"
_COMMITS = (
    f"{_NATIONS}, gc AS (SELECT k::BIGINT AS ordinal, r_name || ' <' || lower(r_name) || '@example.com>' AS author, 'Add ' || n_name AS message, file_path AS files, k::BIGINT + 6 AS added FROM na UNION ALL "
    "SELECT n.n + i, 'Editor <editor@example.com>', ['Change a file', 'Rename a file', 'Delete a file'][i + 1], "
    "CASE i WHEN 1 THEN file_path || '|' || r_name || '/renamed.md' ELSE file_path END, CASE i WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END FROM n, na JOIN (SELECT unnest([0, 1, 2]) AS i) ON k = i)"
)
_WHEN = f"make_timestamp(({_BEGAN} + 3600 * ordinal) * 1000000)"


def _commits(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    history.register(spark)
    return spark.read.format("spindrift_history").options(path=_workspace(spark, sf_dir), slice_size="7", **options).load()


@query(f"WITH {_COMMITS} SELECT ordinal, author, {_WHEN} AS ts, message, files, added FROM gc")
def git_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits with their files and the number of lines that begin with + in their diffs."""
    added = F.size(F.filter(F.split("diff", "\n"), lambda x: F.startswith(x, F.lit("+")))).cast("long")
    return _commits(spark, sf_dir).select("ordinal", "author", F.col("ts").cast("timestamp_ntz").alias("ts"), "message", F.array_join("files", "|").alias("files"), added.alias("added"))


@query(f"WITH {_COMMITS} SELECT ordinal, message || chr(10) || chr(10) || 'a body' AS message FROM gc WHERE starts_with(files, 'AMERICA/') OR starts_with(files, (SELECT min(r_name) FROM na) || '/')")
def git_commits_of_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages of the commits that touch one region's folder, numbered among all."""
    least = d.table(spark, sf_dir, "region").join(d.table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).agg(F.min("r_name")).first()[0]
    some = _commits(spark, sf_dir, subdirs=f"{least},AMERICA", message="full").select("id", "message")
    return some.join(_commits(spark, sf_dir).select("id", "ordinal"), "id").select("ordinal", "message")


@query(f"WITH {_COMMITS} SELECT ordinal, message FROM gc WHERE ordinal BETWEEN 5 AND 8")
def git_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four commits after the fifth."""
    at, own = _workspace(spark, sf_dir), history.provider("git")
    page = own.ids_after(at, own.commit_ids(at)[4], 4)
    return relational.by_ids(_commits(spark, sf_dir), page).select("ordinal", "message")


@query(f"WITH {_COMMITS} SELECT ordinal, message FROM gc ORDER BY ordinal DESC LIMIT 6 OFFSET 6")
def git_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of six, newest first."""
    from spindrift.sources import git

    return relational.by_ids(_commits(spark, sf_dir), git.ids_page(_workspace(spark, sf_dir), None, 1, 6)).select("ordinal", "message")


@query(f"WITH {_COMMITS} SELECT max({_WHEN}) AS ts, count(*) AS n FROM gc")
def git_latest_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, own = _workspace(spark, sf_dir), history.provider("git")
    return spark.createDataFrame([(own.latest_time(at), own.count(at))], "ts timestamp, n long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_TRACKED = f"{_NATIONS}, tr AS (SELECT CASE k WHEN 1 THEN r_name || '/renamed.md' ELSE file_path END AS file_path, k, n_name, r_name FROM na WHERE k <> 2)"
_CONTENT = "(SELECT string_agg(n_name || ' of ' || r_name || ', line ' || i || ' of its file' || chr(10), '' ORDER BY i) FROM range(1, k + 6) t(i)) || CASE k WHEN 0 THEN 'one line more' || chr(10) ELSE '' END"


@query(f"WITH {_TRACKED} SELECT file_path FROM tr")
def git_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir, table="files")


@query(f"WITH {_TRACKED} SELECT file_path, {_CONTENT} AS content FROM tr UNION ALL SELECT 'no/such/file.md', NULL")
def git_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files as of the last commit, and one that isn't there."""
    at = _workspace(spark, sf_dir)
    absent = spark.createDataFrame([("no/such/file.md", history.content(history.provider("git"), at, "no/such/file.md"))], history.SCHEMAS["content"])
    return _commits(spark, sf_dir, table="content").union(absent)


@query(literal_rows({"path": "VARCHAR", "kind": "VARCHAR"}, [("workspace", "git"), ("parent", None), ("blank", None), ("none", None)]), fixed=True)
def detected_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _workspace(spark, sf_dir)
    return spark.createDataFrame([("workspace", detect(at)), ("parent", detect(str(Path(at).parent))), ("blank", detect(" ")), ("none", detect(None))], "path string, kind string")


# --- Perforce: output as the client prints it, made of the orders and documents, and parsed

_MAPPING = perforce.Mapping("//depot/...", "/ws/...")
_CAPTURED = "cp AS (SELECT m.*, array_to_string(list_transform(files, lambda f: '==== //depot/' || f || '#3 (text) ====' || chr(10) || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || id || chr(10) || '+' || author || chr(10)), '') AS diff FROM m WHERE len(files) > 0)"


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``p4 describe`` prints of every changelist with files; a # ends a path there, so those in names are %23."""
    c = d.changelists(spark, sf_dir).where(F.size("files") > 0).withColumn("files", F.transform("files", lambda f: F.replace(f, F.lit("#"), F.lit("%23"))))
    lit = F.lit
    listed = F.array_join(F.transform("files", lambda f: F.concat(lit("... //depot/"), f, lit("#3 edit\n"))), "")
    sections = F.array_join(F.transform("files", lambda f: F.concat(lit("==== //depot/"), f, lit("#3 (text) ====\n\n@@ -1 +1 @@\n-"), F.col("id"), lit("\n+"), F.col("author"), lit("\n"))), "")
    head = F.concat(lit("Change "), "id", lit(" by "), "author", lit("@ws on "), F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), lit("\n\n\t"), "message", lit("\n\n"))
    return c.select("id", F.concat(head, lit("Affected files ...\n\n"), listed, lit("\nDifferences ...\n\n"), sections).alias("output"))


@query(f"WITH {d.CHANGELISTS_SQL}, {d.FILES_SQL}, fl AS (SELECT changelist_id AS id, array_agg(file_path ORDER BY file_path) AS files FROM cf GROUP BY 1), m AS (SELECT cl.*, files FROM cl JOIN fl USING (id)), {_CAPTURED} "
       "SELECT id, ts, author || '@ws' AS author, message, array_to_string(files, '|') AS files, rtrim(diff, chr(10)) AS diff FROM cp")  # fmt: skip
def p4_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perforce.describe_rows(_described(spark, sf_dir), mapping=_MAPPING)
    plain = lambda c: F.replace(c, F.lit("%23"), F.lit("#"))
    return rows.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "author", "message", plain(F.array_join("files", "|")).alias("files"), plain(F.col("diff")).alias("diff"))


@query(f"WITH {d.FILES_SQL} SELECT changelist_id AS id, array_to_string(array_agg(file_path ORDER BY file_path), '|') AS files, count(*) AS sections FROM cf WHERE starts_with(file_path, 'Brand#1/') GROUP BY 1")
def p4_described_under_a_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sections under one folder of the depot only."""
    rows = perforce.describe_rows(_described(spark, sf_dir), mapping=_MAPPING, prefixes=("//depot/Brand%231/",))
    return rows.select("id", F.regexp_replace(F.array_join("files", "|"), "%23", "#").alias("files"), (F.size(F.split("diff", "(?m)^==== //")) - 1).cast("long").alias("sections"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``p4 changes`` prints: every order, those of the first customers twice."""
    c = d.changelists(spark, sf_dir, files=False)
    line = F.concat(F.lit("Change "), "id", F.lit(" on "), F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" by "), "author", F.lit("@ws '"), "message", F.lit("'"))
    twice = F.when(F.col("author") < "Customer#000000010", F.concat(line, F.lit("\n"), line, F.lit("\nnot a change"))).otherwise(line)
    return c.select(twice.alias("output"))


@query("SELECT o_orderkey AS cl FROM orders")
def p4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numeric_changelists(perforce.listed_rows(_listed(spark, sf_dir)))


@query("SELECT max(o_orderdate) AS ts, count(*) AS n FROM orders")
def p4_latest_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perforce.listed_rows(_listed(spark, sf_dir))
    return rows.agg(F.max("ts").cast("timestamp_ntz").alias("ts"), F.countDistinct("cl").alias("n"))


@query("SELECT o_orderkey AS cl FROM orders WHERE o_orderkey > 99 ORDER BY o_orderkey LIMIT 25")
def p4_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 changelists after the hundredth."""
    return relational.page_after(relational.numeric_changelists(perforce.listed_rows(_listed(spark, sf_dir))), "99", 25, "cl", ("cl",))


@query("SELECT DISTINCT p_type || '/' || p_name || '/' || p_size AS file_path FROM part WHERE p_partkey % 7 <> 0")
def p4_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the parts, every seventh of them deleted."""
    action = F.when(F.col("p_partkey") % 7 == 0, "delete").otherwise("edit")
    path = F.concat_ws("/", "p_type", "p_name", F.col("p_size").cast("string"))
    line = F.concat(F.lit("//depot/"), path, F.lit("#2 - "), action, F.lit(" change 5 (text)"))
    return perforce.tracked_rows(d.table(spark, sf_dir, "part").select(line.alias("output")), _MAPPING)


_RAW = "substr(hex(encode(text)), 1, 16384)"


@query(
    f"SELECT 'src/' || doc_id || '.md' AS file_path, CASE WHEN doc_id % 5 = 0 OR text = '' OR contains(substr(text, 1, 8192), chr(0)) OR "
    f"len(list_filter(regexp_extract_all({_RAW}, '..'), lambda h: h BETWEEN '20' AND '7E' OR h IN ('09', '0A', '0D'))) < 0.85 * least(8192, octet_length(encode(text))) THEN NULL ELSE text END AS content "
    "FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
)
def p4_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a printed file, every fifth marked as binary."""
    kind = F.when(F.col("doc_id") % 5 == 0, "binary").otherwise("text")
    head = F.concat(F.lit("//depot/src/"), F.col("doc_id").cast("string"), F.lit(".md#4 - edit change 9 ("), kind, F.lit(")\n"))
    out = d.documents(spark, sf_dir).select(F.concat(head, "text", F.lit("\n")).alias("output"))
    return perforce.printed_rows(out, _MAPPING)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '//other/' || p_name ELSE p_name || '/' || p_size END AS path FROM part")
def p4_local_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = F.concat(F.lit("//other/"), "p_name")
    inside = F.concat(F.lit("//depot/"), "p_name", F.lit("/"), F.col("p_size").cast("string"))
    depot = F.when(F.col("p_partkey") % 3 == 0, outside).otherwise(inside)
    return d.table(spark, sf_dir, "part").select("p_partkey", perforce.local_path(depot, _MAPPING).alias("path"))


@query(literal_rows({"path": "VARCHAR", "here": "BOOLEAN"}, [("/home/ada/ws/src", True), ("/home/ada", False), ("no client", False)]), fixed=True)
def p4_client_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path lies in the root that ``p4 info`` tells."""
    root = perforce.client_root("User name: ada\nClient root: /home/ada/ws\nServer: x\n")
    here = lambda p: root is not None and Path(p).is_relative_to(root)
    rows = [("/home/ada/ws/src", here("/home/ada/ws/src")), ("/home/ada", here("/home/ada")), ("no client", perforce.client_root("Client unknown.") is not None)]
    return spark.createDataFrame(rows, "path string, here boolean")


# --- stores: writes, replays, deletes and compactions of the customers' rows


def _store(spark: SparkSession, name: str) -> Store:
    made = Store(spark, folder(spark, name))
    made.create()
    return made


def _prompts(spark: SparkSession, sf_dir: str, column: str, where: str) -> DataFrame:
    return d.table(spark, sf_dir, "customer").where(where).select(F.col("c_custkey").cast("string").alias("id"), F.col(column).alias("prompt"))


_CUST = "SELECT c_custkey::VARCHAR AS id, {0} AS prompt FROM customer"


@query(literal_rows({"name": "VARCHAR", "n": "BIGINT"}, [(t, 0) for t in ("changelist_files", "changelists", "experts", "file_chunks", "file_contents", "prompt_cache", "vector_books", "vector_cells", "vector_codes", "vectors")]), fixed=True)
def store_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a new store, made twice."""
    own = _store(spark, "created")
    own.create()
    out = None
    for t in sorted(TABLES):
        one = own.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query(_CUST.format("CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE c_name END"))
def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, then newer ones of some keys; then the first write once more, as a replay."""
    own = _store(spark, "upserts")
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_name", "true"), 1)
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_mktsegment", "c_mktsegment = 'BUILDING'"), 2)
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_name", "true"), 1)
    return own.table("prompt_cache")


@query(_CUST.format("CASE WHEN c_nationkey < 10 THEN c_name ELSE c_mktsegment END"))
def store_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _store(spark, "ignored")
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_name", "c_nationkey < 10"))
    own.insert_or_ignore("prompt_cache", _prompts(spark, sf_dir, "c_mktsegment", "true"))
    return own.table("prompt_cache")


@query(_CUST.format("CASE WHEN c_nationkey < 3 THEN c_mktsegment ELSE c_name END") + " WHERE c_nationkey < 3 OR c_mktsegment <> 'BUILDING'")
def store_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, tombstones, a compaction, and newer rows of some keys after it."""
    own = _store(spark, "compacted")
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_name", "true"), 10)
    own.delete("prompt_cache", F.col("id").isin("none"), 11)
    own.delete("prompt_cache", _prompts(spark, sf_dir, "c_name", "c_mktsegment = 'BUILDING'").select("id"), 12)
    own.compact("prompt_cache")
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_mktsegment", "c_nationkey < 3"), 20)
    return own.table("prompt_cache")


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 2 = 0 THEN 'diffs' ELSE 'metadata' END AS collection, round(list_sum(embedding::DOUBLE[]) * CASE WHEN vec_id % 10 = 3 THEN 2 ELSE 1 END, 4) AS total "
       "FROM embeddings WHERE vec_id % 4 <> 0")  # fmt: skip
def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written, some replaced by their doubles, some deleted by their ids, with ids that aren't there."""
    own = _store(spark, "vectors")
    v = d.table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "diffs").otherwise("metadata").alias("collection"), F.col("vec_id").cast("string").alias("id"), "embedding")
    own.upsert("vectors", v)
    own.upsert("vectors", v.where(F.col("id").cast("int") % 10 == 3).withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    own.delete("vectors", v.where(F.col("id").cast("int") % 4 == 0).select("collection", "id").union(spark.range(1).select(F.lit("diffs"), F.lit("none"))))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return own.table("vectors").select("id", "collection", F.round(total, 4).alias("total"))


@query("SELECT n_name AS name, n_name || '-last2' AS last_processed, n_name || '-first' AS first_processed, n_name || '-last1' AS first_batch_last, true AS timed FROM nation WHERE n_nationkey < 3")
def store_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of indexes whose cursor moves twice: the first changelist stays."""
    own = _store(spark, "cursors")
    names = [r.n_name for r in d.table(spark, sf_dir, "nation").where("n_nationkey < 3").collect()]
    blank = [None] * (len(EXPERTS) - 1)
    own.upsert("experts", spark.createDataFrame([(n, *blank) for n in names], EXPERTS))
    for n in names:
        indexing.advance(own, n, f"{n}-first", f"{n}-last1")
        indexing.advance(own, n, f"{n}-first2", f"{n}-last2")
    return own.table("experts").select("name", "last_processed", "first_processed", "first_batch_last", F.col("last_indexed_at").isNotNull().alias("timed"))


@query("SELECT n_name || '-last' AS last_processed, 'kept 7' AS prompt FROM nation WHERE n_nationkey = 0")
def store_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index's cursor and one changelist's cached prompt."""
    own = _store(spark, "scalars")
    names = d.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit("-last")).alias("last_processed"))
    own.upsert("experts", names.select(*(c if c in names.columns else F.lit(None).alias(c) for c in EXPERTS.fieldNames())))
    own.upsert("prompt_cache", d.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("kept "), F.col("c_custkey").cast("string")).alias("prompt")))
    name = d.table(spark, sf_dir, "nation").where("n_nationkey = 0").first().n_name
    return relational.cursor_of(own.table("experts"), name).crossJoin(relational.cached_prompt(own.table("prompt_cache"), "7"))


@query(f"WITH {d.DOCUMENTS_SQL} SELECT 'file:' || file_path || ':chunk_' || i AS id FROM (SELECT file_path, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM d WHERE doc_id = 1)")
def chunk_ids_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindrift.plans.catalog import _chunks

    return relational.chunk_ids(_chunks(spark, sf_dir), d.documents(spark, sf_dir).where("doc_id = 1").first().file_path)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT greatest(0, least(100, (SELECT count(*) FROM orders)) - 40)")
def remaining_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may still be indexed of a hundred when forty are."""
    orders = d.table(spark, sf_dir, "orders").select("o_orderkey")
    return relational.page_after(orders, None, relational.remaining(100, orders.count(), 40), "o_orderkey", ("o_orderkey",))


@query(_CUST.format("CASE WHEN c_nationkey < 5 THEN c_mktsegment ELSE c_name END") + " WHERE c_nationkey < 5 OR c_nationkey >= 10")
def store_replay_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that a base has folded, once more with other rows: those that it doesn't bring again are gone."""
    own = _store(spark, "replayed")
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_name", "c_nationkey < 10"), 5)
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_name", "c_nationkey >= 10"), 6)
    own.compact("prompt_cache")
    own.upsert("prompt_cache", _prompts(spark, sf_dir, "c_mktsegment", "c_nationkey < 5"), 5)
    return own.table("prompt_cache")


@query(
    "WITH n AS (SELECT count(*) AS c, (SELECT count(*) FROM embeddings) AS v FROM customer) SELECT * FROM (SELECT 'before' AS seen, 0::BIGINT AS prompts, 0::BIGINT AS vectors UNION ALL "
    "SELECT 'between two writes', 0, 0 UNION ALL SELECT 'in the transaction', c, 0 FROM n UNION ALL SELECT 'after', c, v FROM n UNION ALL SELECT 'the version before', 0, 0 UNION ALL SELECT 'after a broken one', c, v FROM n)"
)
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see of a batch of two tables before, between and after its writes, and of one that breaks off."""
    own = _store(spark, "versions")
    counts = lambda name, at: at.table("prompt_cache").agg(F.lit(name).alias("seen"), F.count(F.lit(1)).alias("prompts")).crossJoin(at.table("vectors").agg(F.count(F.lit(1)).alias("vectors")))
    prompts = _prompts(spark, sf_dir, "c_name", "true")
    vectors = d.table(spark, sf_dir, "embeddings").select(F.lit("diffs").alias("collection"), F.col("vec_id").cast("string").alias("id"), "embedding")
    first = own.snapshot()
    seen = [counts("before", first)]
    with own.transaction(1, 9) as t:
        t.upsert("prompt_cache", prompts)
        seen.append(counts("between two writes", Store(spark, own.root).snapshot()))
        seen.append(counts("in the transaction", t.snapshot()))
        t.upsert("vectors", vectors)
    seen += [counts("after", own.snapshot()), counts("the version before", first)]
    broken = own.transaction(10, 19)
    broken.delete("vectors", F.lit(True))
    broken.abort()
    seen.append(counts("after a broken one", own.snapshot()))
    out = seen[0]
    for one in seen[1:]:
        out = out.union(one)
    return out


@query(f"WITH {d.CHANGELISTS_SQL}, top AS (SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20) SELECT id, author, CASE WHEN id::BIGINT % 2 = 0 THEN 'new' ELSE message END AS message FROM cl "
       "WHERE author IN (SELECT c_name FROM top)")  # fmt: skip
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelists of the twenty customers with most, looked up by author in a base and a log with newer rows of half of all."""
    own = _store(spark, "lookups")
    rows = d.changelists(spark, sf_dir, files=False)
    full = rows.select(*(c if c in rows.columns else F.lit(None).alias(c) for c in TABLES["changelists"].fieldNames()))
    own.upsert("changelists", full, 1)
    own.compact("changelists")
    own.upsert("changelists", full.where("id % 2 = 0").withColumn("message", F.lit("new")), 2)
    names = [r.c_name for r in d.table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_name").select("c_name").limit(20).collect()]
    return own.lookup("changelists", "author", names).select("id", "author", "message")


@query(
    "WITH v AS (SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 9 = 4 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE vec_id % 11 <> 5), "
    "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 1) SELECT v.id, round(greatest(0, least(1, list_cosine_similarity(v.e, q.e))), 6) AS score FROM v, q ORDER BY score DESC, v.id LIMIT 25"
)
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all vectors, then changed and deleted ones: with all cells and candidates enough its answer is the exact scan's."""
    own, name = _store(spark, "indexed-vectors"), "diffs"
    every = d.table(spark, sf_dir, "embeddings").select(F.lit(name).alias("collection"), F.col("vec_id").cast("string").alias("id"), "embedding")
    own.upsert("vectors", every, 1)
    vector_index.build(own, name)
    with own.transaction(2, 9) as t:
        t.upsert("vectors", every.where("id % 9 = 4").withColumn("embedding", F.transform("embedding", lambda x: -x)))
        vector_index.maintain(t, 2)
        gone = every.where("id % 11 = 5").select("collection", "id")
        t.delete("vectors", gone, 3)
        t.delete("vector_codes", gone, 3)
    query = list(d.table(spark, sf_dir, "embeddings").where("vec_id = 1").first().embedding)
    found = vector_index.top_k(own.snapshot(), name, query, 25, vector_index.MOST_CELLS, refine=20)
    return found.select("id", F.round("score", 6).alias("score"))


# --- an index of the workspace, made in batches


def _indexed(spark: SparkSession, sf_dir: str) -> Store:
    """The workspace's index: ten commits at most at first, then the rest, in batches of sixteen."""
    key = (spark.sparkContext.applicationId, sf_dir, "index")
    if key not in _MADE:
        data, at = folder(spark, "indexes").removeprefix("file://"), _workspace(spark, sf_dir)
        api.populate(spark, data, "nations", at, max_commits=10, batch_size=16)
        api.populate(spark, data, "nations", batch_size=16)
        _MADE[key] = data
    return api.Context(spark, _MADE[key], "nations").store


@query(f"WITH {_COMMITS} SELECT author, message, files, added FROM gc WHERE added > 0 OR message = 'Rename a file'")
def indexed_changelists(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.size(F.filter(F.split("diff", "\n"), lambda x: F.startswith(x, F.lit("+")))).cast("long")
    return _indexed(spark, sf_dir).table("changelists").select("author", "message", F.array_join("files", "|").alias("files"), added.alias("added"))


@query(f"WITH {_COMMITS} SELECT message, unnest(string_split(files, '|')) AS file_path FROM gc")
def indexed_changelist_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _indexed(spark, sf_dir)
    named = own.table("changelists").select(F.col("id").alias("changelist_id"), "message")
    return own.table("changelist_files").join(named, "changelist_id").select("message", "file_path")


_INDEXED = f"{_TRACKED}, ix AS (SELECT file_path, {_CONTENT} AS content, k + 5 + CASE k WHEN 0 THEN 1 ELSE 0 END AS n FROM tr)"


@query(f"WITH {_INDEXED} SELECT 'file:' || file_path || ':chunk_0' AS id, file_path, 0 AS chunk_index, content, 1 AS line_start, n::INTEGER + 1 AS line_end FROM ix")
def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the files as they are after the last commit: the changed one anew, the renamed one's under its new name, none of the deleted one."""
    return _indexed(spark, sf_dir).table("file_chunks").drop("revision_id")


@query(f"WITH {_INDEXED} SELECT file_path, 1 AS chunk_count, length(content)::BIGINT AS file_size, length(content)::BIGINT AS content_bytes FROM ix")
def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).table("file_contents").select("file_path", "chunk_count", "file_size", "content_bytes")


@query(f"WITH {_COMMITS}, {_INDEXED.replace(_NATIONS + ', ', '')} SELECT 'metadata' AS collection, message AS of FROM gc UNION ALL SELECT 'diffs', message FROM gc UNION ALL SELECT 'files', file_path FROM ix")
def indexed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every vector of the index is of; all have the length 1."""
    own = _indexed(spark, sf_dir)
    v = own.table("vectors").withColumn("long", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).where("abs(long - 1) < 1e-4")
    named = own.table("changelists").select(F.col("id").alias("parent"), "message")
    of = v.withColumn("parent", F.split_part("id", F.lit("_chunk_"), F.lit(1))).join(named, "parent", "left")
    return of.select("collection", F.coalesce("message", F.split_part(F.substring("id", 6, F.lit(1 << 20)), F.lit(":chunk_"), F.lit(1))).alias("of"))


@query(f"WITH {_COMMITS} SELECT message FROM gc WHERE ordinal > 20")
def indexed_after_a_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that begins after the 21st commit."""
    at, own = _workspace(spark, sf_dir), _store(spark, "started")
    index_workspace(spark, own, "late", at, start_after=history.provider("git").commit_ids(at)[20])
    return own.table("changelists").select("message")


@query(f"WITH {_COMMITS} SELECT 'nations' AS name, 'git' AS vcs_type, count(*) AS commit_count, true AS linked FROM gc")
def listed_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made known in another folder by a link, and listed there."""
    _indexed(spark, sf_dir)
    data, other = _MADE[(spark.sparkContext.applicationId, sf_dir, "index")], folder(spark, "others").removeprefix("file://")
    api.import_expert(other, f"{data}/data/nations")
    rows = [(e["name"], e["vcs_type"], e["commit_count"], (Path(other) / "data" / e["name"]).is_symlink()) for e in api.list_experts(spark, other)]
    return spark.createDataFrame(rows, "name string, vcs_type string, commit_count long, linked boolean")


@query(literal_rows({"tried": "VARCHAR", "error": "VARCHAR"}, [("not there", "FileNotFoundError"), ("a file", "NotADirectoryError"), ("no index", "InvalidIndexError"), ("known", "ExpertExistsError"), ("unknown index", "ExpertNotFoundError"), ("bad name", "ValueError")]), fixed=True)
def surface_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _indexed(spark, sf_dir)
    data, at = _MADE[(spark.sparkContext.applicationId, sf_dir, "index")], _workspace(spark, sf_dir)
    tried = {
        "not there": lambda: api.import_expert(data, f"{data}/none"), "a file": lambda: api.import_expert(data, f"{at}/.git/HEAD"), "no index": lambda: api.import_expert(data, at),
        "known": lambda: api.import_expert(data, f"{data}/data/nations"), "unknown index": lambda: api.query_expert(spark, data, "none", "x"), "bad name": lambda: api.check_name("a b"),
    }
    rows = []
    for case, run in tried.items():
        try:
            run()
        except Exception as e:  # which error it is is the row
            rows.append((case, type(e).__name__))
    return spark.createDataFrame(rows, "tried string, error string")


@query(f"WITH {_COMMITS}, {_NATIONS.replace('na AS', 'nb AS').replace('FROM na)', 'FROM nb)').replace(', n AS', ', nn AS')} SELECT 'Add ' || n_name AS message, 'commit' AS result_type FROM nb WHERE k = 9")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best changelist for a question that names a nation."""
    _indexed(spark, sf_dir)
    data = _MADE[(spark.sparkContext.applicationId, sf_dir, "index")]
    name = d.table(spark, sf_dir, "nation").where("n_nationkey = 9").first().n_name
    found = api.query_expert(spark, data, "nations", f"add {name}", max_changes=1, scope="metadata")
    return found.select("message", "result_type")


@query(f"WITH {_NATIONS} SELECT 'add ' || n_name AS answer, 2::BIGINT AS pieces, true AS counted FROM na WHERE k = 9")
def prompted_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation made of a search's results, answered piece by piece by the generator that repeats the question."""
    _indexed(spark, sf_dir)
    name = d.table(spark, sf_dir, "nation").where("n_nationkey = 9").first().n_name
    data = _MADE[(spark.sparkContext.applicationId, sf_dir, "index")]
    *pieces, whole = api.prompt_expert_stream(spark, data, "nations", f"add {name}", "echo", max_changes=3, max_file_chunks=2)
    return spark.createDataFrame([("".join(pieces), len(pieces), whole.usage.input_tokens > 0)], "answer string, pieces long, counted boolean")


@query(literal_rows({"step": "VARCHAR", "made": "VARCHAR"}, [("new", ""), ("store asked for", "store"), ("engine asked for", "engine store"), ("closed", "")]), fixed=True)
def lazy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a context holds after each step."""
    _indexed(spark, sf_dir)
    own = api.Context(spark, _MADE[(spark.sparkContext.applicationId, sf_dir, "index")], "nations")
    made = lambda: " ".join(sorted(n for n in ("store", "engine", "generator") if n in own.__dict__))
    rows = [("new", made())]
    for step in ("store", "engine"):
        getattr(own, step)
        rows.append((f"{step} asked for", made()))
    own.close()
    return spark.createDataFrame([*rows, ("closed", made())], "step string, made string")
