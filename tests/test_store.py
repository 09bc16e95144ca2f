"""The store: commits of several tables at once, versions, replays, look-ups that prune files, vacuum; against a plain model."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators.store import Conflict, Sealed, Store

TABLES = ("changelists", "changelist_files", "file_chunks", "file_contents", "vectors")


def prompts(spark, *rows):
    return spark.createDataFrame(rows, "id string, prompt string")


def content(at, table="prompt_cache"):
    return sorted(tuple(r) for r in at.table(table).collect())


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.create()
    return made


def batch(spark, t, tag, n=3):
    """Rows of all five tables of a batch, a write each; says after each write that it was made."""
    ids = spark.range(n).select(F.concat(F.lit(tag), F.col("id").cast("string")).alias("id"))
    path = F.concat(F.lit("src/"), "id")
    blank = lambda df, table: df.select(*(c if c in df.columns else F.lit(None).alias(c) for c in __import__("spindrift.schemas", fromlist=["x"]).TABLES[table].fieldNames()))
    rows = {
        "changelists": ids, "changelist_files": ids.select(F.col("id").alias("changelist_id"), path.alias("file_path")), "file_chunks": ids.withColumn("file_path", path),
        "file_contents": ids.select(path.alias("file_path")), "vectors": ids.withColumn("collection", F.lit("files")).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))),
    }
    for table, df in rows.items():
        t.upsert(table, blank(df, table))
        yield table


def counts(at):
    return [at.table(t).count() for t in TABLES]


def test_a_batch_is_seen_whole_or_not_at_all(spark, store):
    with store.transaction(10, 19) as t:
        for _ in batch(spark, t, "a"):
            assert counts(Store(spark, store.root)) == [0] * 5
        assert counts(t) == [3] * 5  # its own reads see what it wrote
    old = store.snapshot()
    with store.transaction(20, 29) as t:
        for _ in batch(spark, t, "b", 4):
            assert counts(Store(spark, store.root)) == [3] * 5
    assert counts(store) == [7] * 5 and counts(old) == [3] * 5
    with pytest.raises(ZeroDivisionError), store.transaction(30, 39) as t:
        for table in batch(spark, t, "c"):
            if table == "vectors":
                raise ZeroDivisionError
    assert counts(store) == [7] * 5 and all("write=30" not in n for x in TABLES for n, _ in store.files.names(f"{store.root}/{x}"))


def test_a_replay_replaces_what_its_numbers_wrote(spark, store):
    store.upsert("prompt_cache", prompts(spark, ("z", "old"), ("y", "old")), 1)
    for _ in range(2):  # the second time after a compaction of all but the newest number, as tidy does it
        with store.transaction(10, 19) as t:
            t.upsert("prompt_cache", prompts(spark, ("a", "1"), ("b", "1"), ("y", "new")))
            t.delete("prompt_cache", F.col("id") == "z", 11)
        assert content(store) == [("a", "1"), ("b", "1"), ("y", "new")]
        with store.transaction(10, 19) as t:  # cut off, and retried with fewer rows and no deletion
            t.upsert("prompt_cache", prompts(spark, ("a", "2")))
        assert content(store) == [("a", "2"), ("y", "old"), ("z", "old")]
        store.compact("prompt_cache", through=9)


def test_a_replay_after_the_compaction_of_its_number(spark, store):
    store.upsert("prompt_cache", prompts(spark, ("a", "1"), ("b", "1")), 5)
    store.upsert("prompt_cache", prompts(spark, ("c", "1")), 6)
    store.compact("prompt_cache")
    store.upsert("prompt_cache", prompts(spark, ("a", "2")), 5)
    assert content(store) == [("a", "2"), ("c", "1")]
    store.compact("prompt_cache")
    assert content(store) == [("a", "2"), ("c", "1")]
    with store.transaction(5):
        pass  # nothing is left of it
    assert content(store) == [("c", "1")]


def test_writers_meet(spark, store):
    one, two, three = (store.transaction() for _ in range(3))
    one.upsert("prompt_cache", prompts(spark, ("a", "1")), 7)
    two.upsert("prompt_cache", prompts(spark, ("b", "1")), 8)
    three.delete("prompt_cache", F.col("id") == "a")
    three.upsert("file_contents", spark.createDataFrame([("p",)], "file_path string").select("file_path", *(F.lit(None).alias(c) for c in ("expert_name", "revision_id", "file_size", "content_bytes", "chunk_count", "last_indexed_at"))))
    one.commit()
    two.commit()
    with pytest.raises(Conflict, match="prompt_cache"):
        three.commit()
    assert content(store) == [("a", "1"), ("b", "1")] and store.table("file_contents").isEmpty() and not store.files.names(f"{store.root}/file_contents")
    assert not store.files.put_if_absent(store.version_file(store.versions()[-1]), "{}") and content(store) == [("a", "1"), ("b", "1")]
    folding = store.transaction()
    folding.compact("prompt_cache")
    store.upsert("prompt_cache", prompts(spark, ("c", "1")), 9)
    with pytest.raises(Conflict):
        folding.commit()
    assert content(store) == [("a", "1"), ("b", "1"), ("c", "1")]


def test_versions_and_vacuum(spark, store):
    for i in range(4):
        store.upsert("prompt_cache", prompts(spark, ("a", str(i)), (str(i), "x")), i + 1)
    assert store.delete("prompt_cache", F.col("id") == "0", 9) == 1
    old = store.snapshot()
    store.compact("prompt_cache")
    now = [("1", "x"), ("2", "x"), ("3", "x"), ("a", "3")]
    assert content(old) == content(store) == content(store.snapshot(old.version)) == now
    assert store.base("prompt_cache").where("deleted").count() == 1
    assert store.vacuum(keep=1) == 0 and content(old) == now  # what is younger than a day stays
    assert store.vacuum(keep=1, older_ms=0) >= 6 and content(store) == now and len(store.versions()) == 1
    assert store.base("prompt_cache").where("deleted").count() == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        content(old)
    for late in (3, 9):
        with pytest.raises(Sealed):
            store.upsert("prompt_cache", prompts(spark, ("0", "back")), late)
    store.upsert("prompt_cache", prompts(spark, ("0", "back")), 10)
    assert content(store) == [("0", "back"), *now]


def files_read(df):
    return len(df.inputFiles())


def test_a_lookup_reads_one_file_of_a_hundred(spark, store):
    n = 1000
    path = F.concat(F.lit("src/"), F.lpad((F.col("i") / 10).cast("int").cast("string"), 3, "0"))
    named = spark.range(n).select(F.col("id").alias("i"), F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.concat(F.lit("author"), (F.col("id") % 7).cast("string")).alias("author"))
    blank = lambda df, *names: df.select("*", *(F.lit(None).alias(c) for c in names))
    changes = blank(named, "expert_name", "ts", "message", "diff", "files", "review_comments")
    chunks = blank(named.select(path.alias("file_path"), F.concat(F.lit("file:"), path, F.lit(":chunk_"), (F.col("i") % 10).cast("string")).alias("id")), "chunk_index", "content", "line_start", "line_end", "revision_id")
    store.upsert("changelists", changes, 1)
    store.upsert("file_chunks", chunks, 1)
    store.upsert("changelist_files", named.select(F.col("id").alias("changelist_id"), path.alias("file_path")), 1)
    for table in ("changelists", "file_chunks", "changelist_files"):
        store.compact(table, file_rows=10)
        assert files_read(store.base(table)) >= 100
    one = store.lookup("changelists", "id", ["00417"])
    assert files_read(one) == 1 and [r.id for r in one.collect()] == ["00417"]
    assert files_read(store.lookup("changelists", "id", ["00000", "00001", "00999", None])) <= 3
    assert store.lookup("changelists", "id", ["none"]).count() == 0 == store.lookup("changelists", "id", []).count()
    of_file = store.lookup("file_chunks", "file_path", ["src/042"])
    assert files_read(of_file) <= 2 and of_file.count() == 10
    assert files_read(store.lookup("file_chunks", "id", ["file:src/042:chunk_3"])) == 1
    touching = store.lookup("changelist_files", "file_path", ["src/007"])
    assert files_read(touching) <= 2 and sorted(r.changelist_id for r in touching.collect()) == [f"{i:05}" for i in range(70, 80)]
    assert store.lookup("changelists", "author", ["author3"]).count() == len(range(3, n, 7))  # no ranges: all files, with Parquet's own filters
    # newer writes: a row changed, one deleted, one new, one that takes another author
    store.upsert("changelists", changes.where("i = 417").withColumn("message", F.lit("new")), 2)
    store.delete("changelists", F.col("id") == "00418", 3)
    store.upsert("changelists", changes.where("i = 3").withColumn("author", F.lit("author9")), 4)
    got = store.lookup("changelists", "id", ["00417", "00418", "00419"])
    assert sorted((r.id, r.message) for r in got.collect()) == [("00417", "new"), ("00419", None)]
    assert files_read(got) <= 3 + 3
    assert store.lookup("changelists", "author", ["author3"]).count() == len(range(3, n, 7)) - 1
    assert [r.id for r in store.lookup("changelists", "author", ["author9"]).collect()] == ["00003"]
    # a write under an older number than the base's doesn't take its row
    store.upsert("changelists", changes.where("i = 500").withColumn("author", F.lit("late")).withColumn("message", F.lit("late")), 0)
    assert store.lookup("changelists", "author", ["late"]).count() == 0 == store.lookup("changelists", "id", ["00500"]).where("message is not null").count()


def test_a_bloom_filter_skips_row_groups(spark, store):
    """A value inside a file's range that it doesn't hold is not read from it."""
    rows = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.concat(F.lit("author"), (F.col("id") * 2).cast("string")).alias("author"))
    store.upsert("changelists", rows.select("*", *(F.lit(None).alias(c) for c in ("expert_name", "ts", "message", "diff", "files", "review_comments"))), 1)
    store.compact("changelists", file_rows=5_000)

    def scanned(author):
        df = store.lookup("changelists", "author", [author])
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves, found = plan.collectLeaves(), 0
        for i in range(leaves.size()):
            metrics = leaves.apply(i).metrics()
            found += metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        return found

    assert scanned("author5000") >= 1 and scanned("author5001") == 0


def test_against_a_model(spark, tmp_path):
    """Random writes, deletions, replays of the newest number and compactions, against a dictionary of writes."""
    rng, store, writes = random.Random(3), Store(spark, str(tmp_path / "model")), {}
    store.create()

    def model():
        rows = {}
        for n in sorted(writes):
            for key, value in writes[n].items():
                rows[key] = value
        return sorted((k, v) for k, v in rows.items() if v is not None)

    number = 1
    for step in range(14):
        what = rng.choice(["upsert", "upsert", "delete", "replay", "compact"])
        keys = [f"k{rng.randrange(8)}" for _ in range(rng.randint(1, 4))]
        if what == "compact":
            store.compact("prompt_cache", through=number - 1)
        elif what == "delete":
            number += 1
            there = {k for k, _ in model()}
            store.delete("prompt_cache", F.col("id").isin(keys), number)
            writes[number] = {k: None for k in keys if k in there}
        else:
            number += what == "upsert"
            fresh = {k: f"{step}" for k in keys}
            store.upsert("prompt_cache", prompts(spark, *fresh.items()), number)
            writes[number] = fresh
        assert content(store) == model(), (step, what)
