"""Indexing: batches of changelists and the files they touch become rows and vectors of the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as t
from spindrift.functions.models import embedding
from spindrift.operators import relational
from spindrift.operators.store import Store, Transaction
from spindrift.plans import vector_index
from spindrift.schemas import DIFFS, FILES, METADATA

CHUNK_CHARS, LEAST_CHARS = 4096, 128
#: A batch's writes are numbered by its place in the history, shifted by so many bits.
SEQ_BITS = 20

Contents = Callable[[DataFrame, str], DataFrame]  # (file_path rows, revision) -> file_path, content


def _vectors(df: DataFrame, collection: str, id: str, text: str, model: str, sanitize: bool) -> DataFrame:
    fed = t.sanitize(F.col(text)) if sanitize else F.col(text)
    return df.select(F.lit(collection).alias("collection"), F.col(id).alias("id"), embedding(fed, model).alias("embedding"))


def commit_vectors(commits: DataFrame, model: str = "hashing", sanitize: bool = True, metadata: bool = True, diffs: bool = True) -> DataFrame:
    """A vector of each changelist's metadata text, and one of each chunk of its diff. Only what is embedded is sanitised."""
    text = t.metadata_text(F.col("message"), F.col("files"), F.col("review_comments"))
    sides = [_vectors(commits.withColumn("text", text), METADATA, "id", "text", model, sanitize)] if metadata else []
    if diffs:
        parts = commits.select("id", F.posexplode(t.chunk_fixed(F.col("diff"), CHUNK_CHARS)).alias("i", "text"))
        sides.append(_vectors(parts.withColumn("id", t.diff_vector_id(F.col("id"), F.col("i"))), DIFFS, "id", "text", model, sanitize))
    return sides[0].union(sides[1]) if len(sides) == 2 else sides[0]


def file_chunks(contents: DataFrame, revision: str) -> DataFrame:
    """Chunks of files that are texts of some length: rows of FILE_CHUNKS."""
    good = contents.where((F.length("content") >= LEAST_CHARS) & ~t.is_binary(F.col("content")))
    parts = t.chunk_lines(good.select("file_path", "content"), "content", CHUNK_CHARS)
    return parts.withColumn("id", t.chunk_id(F.col("file_path"), F.col("chunk_index"))).withColumn("revision_id", F.lit(revision))


def own_numbers(seq: int) -> tuple[int, int]:
    """The numbers that belong to the batch ``seq``."""
    return seq << SEQ_BITS, (seq + 1 << SEQ_BITS) - 1


def index_batch(store: Store, commits: DataFrame, seq: int, name: str, contents: Contents | None, tracked: DataFrame | None, model: str = "hashing", sanitize: bool = True, cursor: dict | None = None, revision: str | None = None) -> int:
    """Writes one batch of changelists (ordinal, id, ts, author, message, diff, files) under the number ``seq``; returns how many. ``cursor``: and moves the
    index's cursor over them; these are other columns of the index's row that change with it.

    All tables change in one commit. A replay with the same number replaces the same rows; between two batches there is room for other writes. Files are
    read as of ``revision`` (none: the batch's last changelist); a touched file's old chunks all go, whether it is there still or not.
    """
    with store.transaction(*own_numbers(seq)) as own:
        return _write_batch(own, commits, name, contents, tracked, model, sanitize, cursor, revision)


def _write_batch(store: Transaction, commits: DataFrame, name: str, contents: Contents | None, tracked: DataFrame | None, model: str, sanitize: bool, cursor: dict | None, revision: str | None) -> int:
    at = store.own[0]
    rows = commits.withColumn("diff", t.filter_binary(F.col("diff"))["diff"])
    if cursor is not None:
        ends = commits.agg(F.min_by("id", "ordinal"), F.max_by("id", "ordinal")).first()
        if ends[0] is not None:
            advance(store, name, *ends, **cursor)
    rows = rows.where(F.trim("diff") != "")
    rows = rows.withColumn("expert_name", F.lit(name)).withColumn("review_comments", F.lit(None).cast("string")).persist()
    try:
        last = rows.agg(F.max_by("id", "ordinal"), F.count(F.lit(1))).first()
        if not last[1]:
            return 0
        experts = store.table("experts").where(F.col("name") == name).first()
        flags = (experts is None or experts.embed_metadata is not False, experts is None or experts.embed_diffs is not False)
        if contents is not None:
            touched = relational.touched_files(rows)
            there = touched if tracked is None else relational.split_by_tracked(touched, tracked)[0]
            at_revision = revision or last[0]
            chunks = file_chunks(contents(there, at_revision), at_revision).persist()
            old = store.table("file_chunks").join(touched, "file_path", "left_semi").select("id")
            stale = old.join(chunks.select("id"), "id", "left_anti").persist()
            gone_vectors = stale.withColumn("collection", F.lit(FILES)).select("collection", "id")
            store.delete("vectors", gone_vectors, at + 1)
            store.delete("vector_codes", gone_vectors, at + 1)
            store.delete("file_chunks", stale, at + 1)
            gone = store.table("file_contents").join(touched, "file_path", "left_semi").join(chunks.select("file_path"), "file_path", "left_anti").select("file_path")
            store.delete("file_contents", gone, at + 1)
            summary = relational.file_summaries(chunks).withColumn("expert_name", F.lit(name)).withColumn("revision_id", F.lit(at_revision)).withColumn("last_indexed_at", F.current_timestamp())
            store.upsert("file_contents", summary, at)
            store.upsert("file_chunks", chunks, at)
            vectors = _vectors(chunks, FILES, "id", "content", model, sanitize)
        else:
            vectors = None
        store.upsert("changelists", rows, at)
        store.insert_or_ignore("changelist_files", rows.select(F.col("id").alias("changelist_id"), F.explode("files").alias("file_path")), at)
        own = commit_vectors(rows, model, sanitize, *flags) if any(flags) else None
        both = own if vectors is None else vectors if own is None else own.union(vectors)
        if both is not None:
            store.upsert("vectors", both, at)
            vector_index.maintain(store, at)
        return last[1]
    finally:
        rows.unpersist()


def advance(store: Store | Transaction, name: str, first: str, last: str, **changed: object) -> None:
    """Moves the cursor; the first changelist ever processed stays, and so does the last of the first batch. ``changed``: other columns of the index's row."""
    e = store.table("experts").where(F.col("name") == name)
    moved = e.withColumn("last_processed", F.lit(last)).withColumn("first_processed", F.coalesce("first_processed", F.lit(first)))
    moved = moved.withColumn("first_batch_last", F.coalesce("first_batch_last", F.lit(last))).withColumn("last_indexed_at", F.current_timestamp())
    for c, value in changed.items():
        moved = moved.withColumn(c, F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value))
    store.upsert("experts", moved)
