"""Conversations for a text generator, made of search results."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.models import GENERATORS, GenerationError, TextGenerator, create
from spindrift.functions.text import language_of, truncate_bytes, unquoted
from spindrift.operators.store import Store
from spindrift.plans.scratch import folder

SYSTEM = (
    "You advise developers from the history of their code base. Rely only on this conversation. Name the existing files that matter most, "
    "the approaches that worked before, how to test the change, and what went wrong in the past. Say so if the history doesn't help."
)
PLAYFUL = "Add light-hearted jokes about a saboteur aboard a spaceship, without making the advice less useful."
PROMPT_SYSTEM = "Write the short request that a developer may have made that led to this change. Answer with the request alone."

# Texts that messages hold.
BREVITY = "\n\n[... diff truncated for brevity ...]"
PROMPT_BREVITY = "\n[... truncated for brevity ...]"
STATE_HEAD = "=== CURRENT CODEBASE STATE (HEAD) ===\n"
STATE_TAIL = "=== END CURRENT STATE ==="
SHOWN_FILES = 10
#: Rounds of a run that keeps prompts: each reads its own part and ends in a commit, so a round grows with the requests and not the number of rounds.
MOST_ROUNDS = 16


class NoChangelistsError(ValueError):
    """A conversation needs one changelist at least."""


def system_prompt(playful: bool = False) -> str:
    return f"{SYSTEM}\n\n{PLAYFUL}" if playful else SYSTEM


def _diff(diff: Column, most: int, mark: str) -> Column:
    """The guard counts code points, the cut bytes."""
    cut = truncate_bytes(diff, most)
    return F.when((F.length(diff) > most) & (F.octet_length(diff) > most), F.concat(cut, F.lit(mark))).otherwise(diff)


def _files(files: Column) -> Column:
    more = F.size(files) - SHOWN_FILES
    shown = F.array_join(F.slice(files, 1, SHOWN_FILES), ", ")
    return F.when(more > 0, F.concat(shown, F.lit(" (and "), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def changelist_message(message: Column, files: Column, diff: Column, most: int = 80_000) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Commit: "), message), F.concat(F.lit("Files: "), _files(files)), F.concat(F.lit("Changes:\n"), _diff(diff, most, BREVITY)))


def prompt_request(message: Column, files: Column, diff: Column, most: int = 8_000) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("Commit Message: "), message), F.concat(F.lit("Files Changed: "), _files(files)),
        F.concat(F.lit("\nCode Changes:\n"), _diff(diff, most, PROMPT_BREVITY)),
    )


def state_block(path: Column, first: Column, last: Column, content: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit(" (lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")\n```"), language_of(path), F.lit("\n"), content, F.lit("\n```\n"))


def _state_rows() -> Column:
    block = state_block(F.col("file_path"), F.col("line_start"), F.col("line_end"), F.col("content"))
    return F.array_sort(F.collect_list(F.struct("file_path", "line_start", "line_end", block.alias("block"))))


def state_files(chunks: DataFrame) -> DataFrame:
    """Rows file_path, content by path: the blocks of each file by line."""
    each = chunks.groupBy("file_path").agg(_state_rows().alias("rows"))
    return each.select("file_path", F.array_join("rows.block", "\n").alias("content")).orderBy("file_path")


def state_message(chunks: DataFrame) -> DataFrame:
    """One row ``content``: all chunks by path and line; no row without chunks.

    The blocks of a file are put together where the file is, then the files; a message is one row, so it is for a search's few files.
    """
    files = F.array_sort(F.collect_list(F.struct("file_path", "content")))
    one = state_files(chunks).agg(files.alias("files")).where(F.size("files") > 0)
    return one.select(F.concat_ws("\n", F.lit(STATE_HEAD), F.array_join("files.content", "\n"), F.lit(STATE_TAIL)).alias("content"))


def messages(changelists: DataFrame, prompt: str, chunks: DataFrame | None = None, paired: bool = False, most: int = 80_000) -> DataFrame:
    """Rows section, ts, id, seq, role, content in the conversation's order.

    Changelists by time, as user messages, or each after its generated prompt (column ``generated_prompt``) as the
    assistant's; then the files' state; then the prompt.
    """
    told = changelist_message(F.col("message"), F.col("files"), F.col("diff"), most)
    said = [F.struct(F.lit(1).alias("seq"), F.lit("assistant" if paired else "user").alias("role"), told.alias("content"))]
    if paired:
        said.insert(0, F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("generated_prompt").alias("content")))
    out = changelists.select(F.lit(0).alias("section"), "ts", "id", F.inline(F.array(*said)))
    empty = [F.lit(None).cast("timestamp").alias("ts"), F.lit("").alias("id"), F.lit(0).alias("seq"), F.lit("user").alias("role")]
    if chunks is not None:
        out = out.union(state_message(chunks).select(F.lit(1), *empty, "content"))
    last = changelists.sparkSession.range(1).select(F.lit(2), *empty, F.lit(prompt))
    return out.union(last).orderBy("section", "ts", "id", "seq")


def build(changelists: DataFrame, prompt: str, chunks: DataFrame | None = None, playful: bool = False, paired: bool = False, most: int = 80_000) -> tuple[str, list[dict[str, str]]]:
    """(system prompt, messages) for a generator: a search's few results, so they come to the driver."""
    rows = messages(changelists, prompt, chunks, paired, most).collect()
    if not any(r.section == 0 for r in rows):
        raise NoChangelistsError("a conversation needs changelists")
    return system_prompt(playful), [{"role": r.role, "content": r.content} for r in rows]


def generated_prompts(changelists: DataFrame, cache: DataFrame, generator: str | Callable[[], TextGenerator] = "echo", most: int = 8_000) -> DataFrame:
    """id, prompt, hit: cached prompts, and new ones for the rest. New rows (hit false) are for the caller to keep.

    generator: a registered one's name, or what makes one in a worker.
    """
    make = generator if callable(generator) else GENERATORS[generator] if generator in GENERATORS else create(GENERATORS, generator)
    asked = changelists.join(cache.select("id", F.col("prompt").alias("cached")), "id", "left")
    hits = asked.where(F.coalesce("cached", F.lit("")) != "").select("id", F.col("cached").alias("prompt"), F.lit(True).alias("hit"))
    missing = asked.where(F.coalesce("cached", F.lit("")) == "").select("id", prompt_request(F.col("message"), F.col("files"), F.col("diff"), most).alias("request"))

    def run(frames):
        model: TextGenerator = make()
        for f in frames:
            f["prompt"] = [model.generate(PROMPT_SYSTEM, [{"role": "user", "content": r}]).content for r in f.pop("request")]
            yield f

    made = missing.mapInPandas(run, "id string, prompt string").select("id", unquoted(F.col("prompt")).alias("prompt"), F.lit(False).alias("hit"))
    return hits.union(made)


def keep_prompts(store: Store, changelists: DataFrame, generator: str | Callable[[], TextGenerator] = "echo", most: int = 8_000, round_size: int = 256) -> tuple[int, int]:
    """Makes the prompts that the store's cache doesn't have, and keeps them as it goes; returns how many were there and how many were made.

    Equal requests are asked once. Requests go in rounds of about ``round_size`` (a ``MOST_ROUNDS``-th of all, where that is more), each a commit: a run that is killed, or whose generator
    fails, has kept what the rounds before had, and of its own round whatever had an answer, so the next run asks only for the rest. GenerationError tells of failures after the round's
    answers are kept.
    """
    make = generator if callable(generator) else GENERATORS[generator] if generator in GENERATORS else create(GENERATORS, generator)
    spark = changelists.sparkSession
    asked = changelists.select("id", prompt_request(F.col("message"), F.col("files"), F.col("diff"), most).alias("request")).dropDuplicates(["id"])
    known = store.table("prompt_cache").where(F.coalesce("prompt", F.lit("")) != "").select("id", F.lit(True).alias("known"))
    at = folder(spark, "requests")
    request = F.when(F.col("known").isNull(), F.col("request"))
    asked.join(known, "id", "left").select("id", "known", request.alias("request"), F.sha2(F.coalesce(request, F.lit("")), 256).alias("key")).write.parquet(at)
    every = spark.read.parquet(at)
    missing = every.where("known is null")
    hits, n, keys = every.agg(F.count("known"), F.count_if(F.col("known").isNull()), F.approx_count_distinct(F.when(F.col("known").isNull(), F.col("key")))).first()
    rounds = max(1, min(MOST_ROUNDS, math.ceil(keys / round_size)))
    dealt = F.pmod(F.xxhash64("key"), F.lit(rounds)).cast("int").alias("round")
    missing.select("id", "key", dealt).write.partitionBy("round").parquet(f"{at}-ids")
    missing.groupBy("key").agg(F.min("request").alias("request")).select("*", dealt).write.partitionBy("round").parquet(f"{at}-distinct")
    ids, distinct = (spark.read.schema(f"{own} string, {other} string, round int").parquet(f"{at}-{name}") for own, other, name in (("id", "key", "ids"), ("key", "request", "distinct")))

    def run(frames):
        model: TextGenerator = make()
        for f in frames:
            prompts, errors = [], []
            for r in f.pop("request"):
                try:
                    prompts.append(model.generate(PROMPT_SYSTEM, [{"role": "user", "content": r}]).content)
                    errors.append(None)
                except Exception as e:  # told when the others are kept
                    prompts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            f["prompt"], f["error"] = prompts, errors
            yield f

    for i in range(rounds if n else 0):
        mine, done = F.col("round") == i, f"{at}-round{i}"
        distinct.where(mine).select("key", "request").mapInPandas(run, "key string, prompt string, error string").write.parquet(done)
        answers = spark.read.schema("key string, prompt string, error string").parquet(done)
        good = ids.where(mine).join(answers.where("prompt is not null"), "key").select("id", unquoted(F.col("prompt")).alias("prompt"))
        store.upsert("prompt_cache", good)
        bad = answers.where("error is not null").agg(F.min("error"), F.count(F.lit(1))).first()
        if bad[1]:
            raise GenerationError(f"{bad[1]} requests failed; {bad[0]}")
    return hits, n


def transcripts(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """key, content: each conversation as lines ``role: content`` in its order; a turn without text is an empty line of its role."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.coalesce(content, F.lit("")).alias("t"))))
    lines = F.transform("rows", lambda x: F.concat(x["r"], F.lit(": "), x["t"]))
    return turns.groupBy(key).agg(rows.alias("rows")).select(key, F.array_join(lines, "\n").alias("content"))


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changelists, file chunks) of a search's results."""
    return results.where(F.col("result_type") == "commit"), results.where(F.col("result_type") == "file_chunk")
