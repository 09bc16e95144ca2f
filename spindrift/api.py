"""The engine's surface: populate, query, prompt, list, import."""

from __future__ import annotations

import asyncio
import re
from collections.abc import AsyncIterator, Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.generators import Logged
from spindrift.functions.models import GENERATORS, Generated, TextGenerator, streamed
from spindrift.functions.providers import Settings, generator
from spindrift.operators.store import Store
from spindrift.plans import conversation
from spindrift.plans.search import Engine, QueryParams
from spindrift.schemas import EXPERTS
from spindrift.sources.detect import detect
from spindrift.streaming.feed import index_workspace


class EngineError(Exception):
    """Base of the surface's errors."""


class ExpertNotFoundError(EngineError):
    """No index has this name."""


class ExpertExistsError(EngineError):
    """An index has this name already."""


class InvalidIndexError(EngineError):
    """A folder that is no index."""


class NoResultsError(EngineError):
    """A search that a conversation needs found nothing."""


def check_name(name: str) -> str:
    if not re.fullmatch(r"[\w-]+", name) or not name.strip("_-"):
        raise ValueError(f"{name!r}: letters, digits, hyphens and underscores only")
    return name


def _folder(data_dir: str, name: str) -> Path:
    return Path(data_dir) / "data" / check_name(name)


def _open(spark: SparkSession, data_dir: str, name: str) -> Store:
    folder = _folder(data_dir, name)
    store = Store(spark, str(folder.resolve()))
    if not store.exists():
        raise ExpertNotFoundError(name)
    return store


@dataclass
class Context:
    """What the operations on one index need, each made when it is first asked for."""

    spark: SparkSession
    data_dir: str
    name: str
    settings: Settings = field(default_factory=Settings)
    debug: bool = False

    @cached_property
    def store(self) -> Store:
        """The index's tables; ExpertNotFoundError if there is no such index."""
        return _open(self.spark, self.data_dir, self.name)

    @cached_property
    def engine(self) -> Engine:
        row = self.store.table("experts").select("embedder").first()
        return Engine(self.spark, self.store.root, row.embedder if row and row.embedder else "hashing")

    @cached_property
    def generator(self) -> TextGenerator:
        own = generator(self.settings)
        return Logged(own, self.spark, str(Path(self.data_dir) / "logs")) if self.debug else own

    @property
    def prompt_generator(self) -> TextGenerator:
        return generator(self.settings, "promptgen")

    def close(self) -> None:
        """Lets go of what was made."""
        for name in ("store", "engine", "generator"):
            self.__dict__.pop(name, None)

    def __enter__(self) -> Context:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def populate(
    spark: SparkSession, data_dir: str, name: str, workspace: str | None = None, subdirs: Sequence[str] = (), max_commits: int = 10_000, batch_size: int = 500, start_at: str | None = None,
    vcs: str | None = None, embedder: str = "hashing",
) -> int:
    """Makes or updates an index of a workspace; returns how many changelists are new. A known index keeps its workspace and its embedder.

    vcs: git or p4, else whichever recognises the workspace.
    """
    folder = _folder(data_dir, name)
    store = Store(spark, str(folder.resolve()))
    row = store.table("experts").first() if store.exists() else None
    if row is not None:
        if workspace and Path(workspace).resolve() != Path(row.workspace_path):
            raise ValueError(f"{name} is an index of {row.workspace_path}")
        workspace, subdirs, vcs, embedder = row.workspace_path, tuple(row.subdirs), vcs or row.vcs_type, row.embedder or "hashing"
    elif not workspace or not Path(workspace).is_dir():
        raise ValueError("a new index needs a workspace that is there")
    kind = vcs or detect(workspace)
    if kind is None:
        raise ValueError(f"{workspace}: no version control found")
    store.create()
    if row is None:
        new = (name, str(Path(workspace).resolve()), list(subdirs), kind, datetime.now(UTC), None, None, None, None, max_commits, True, True, embedder, None, None, None, None)
        store.upsert("experts", spark.createDataFrame([new], EXPERTS))
    return index_workspace(spark, store, name, str(workspace), tuple(subdirs), batch_size, max_commits, start_at, embedder, kind=kind)


def query_expert(spark: SparkSession, data_dir: str, name: str, prompt: str, **settings: object) -> DataFrame:
    """Results of a search; ``settings`` are those of QueryParams."""
    params = QueryParams(prompt, **settings)
    return Context(spark, data_dir, name).engine.search(params)


def prompt_expert_stream(
    spark: SparkSession, data_dir: str, name: str, prompt: str, generator: str = "echo", playful: bool = False, paired: bool = False, settings: Settings | None = None, debug: bool = False,
    **search: object,
) -> Iterator[str | Generated]:
    """A generator's answer to a conversation made of a search's results: pieces of its text as they come, then the whole with its usage.

    generator: a registered one's or a provider's name, or auto. ``search``: settings of QueryParams.
    """
    with Context(spark, data_dir, name, replace(settings or Settings(), provider=generator), debug) as own:
        results = own.engine.search(QueryParams(prompt, **search)).persist()
        try:
            if results.isEmpty():
                raise NoResultsError(prompt)
            commits, chunks = conversation.split_results(results)
            commits = commits.withColumnRenamed("result_id", "id")
            if paired:
                make = generator if generator in GENERATORS else (lambda: own.prompt_generator)
                conversation.keep_prompts(own.store, commits, make)
                kept = own.store.lookup("prompt_cache", "id", [r.id for r in commits.select("id").collect()])
                commits = commits.join(kept.select("id", F.col("prompt").alias("generated_prompt")), "id")
            system, messages = conversation.build(commits, prompt, chunks, playful, paired)
        finally:
            results.unpersist()
        yield from streamed(own.generator, system, messages)


async def prompt_expert_stream_async(*args: object, **settings: object) -> AsyncIterator[str | Generated]:
    """``prompt_expert_stream`` for an event loop; each piece is waited for in a thread."""
    stream, end = prompt_expert_stream(*args, **settings), object()
    while (piece := await asyncio.to_thread(next, stream, end)) is not end:
        yield piece


def prompt_expert(spark: SparkSession, data_dir: str, name: str, prompt: str, **settings: object) -> Generated:
    """The whole answer; the last usage told counts."""
    *_, last = prompt_expert_stream(spark, data_dir, name, prompt, **settings)
    return last


def list_experts(spark: SparkSession, data_dir: str) -> list[dict]:
    """All indexes with their counts and cursors, by name."""
    out = []
    for folder in sorted((Path(data_dir) / "data").glob("*/_versions")):
        store = Store(spark, str(folder.parent.resolve()))
        row = store.table("experts").first()
        if row is not None:
            out.append({**row.asDict(), "commit_count": store.table("changelists").count()})
    return sorted(out, key=lambda e: e["name"])


def import_expert(data_dir: str, source: str) -> str:
    """Makes an index that lies elsewhere known here, by a link; returns its name."""
    path = Path(source)
    if not path.exists():
        raise FileNotFoundError(source)
    if not path.is_dir():
        raise NotADirectoryError(source)
    if not (path / "_versions").is_dir():
        raise InvalidIndexError(source)
    target = _folder(data_dir, path.name)
    if target.exists() or target.is_symlink():
        raise ExpertExistsError(path.name)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.symlink_to(path.resolve(), target_is_directory=True)
    return path.name


def listing_markdown(experts: Sequence[dict]) -> str:
    if not experts:
        return "No experts found. Create one with the 'populate' command."
    out = ["# Available Experts\n"]
    for e in experts:
        out += [f"## {e['name']}", f"- **Workspace**: {e['workspace_path']}", f"- **VCS Type**: {e['vcs_type']}", f"- **Commits Indexed**: {e['commit_count']}"]
        out += [f"- **Subdirectories**: {', '.join(e['subdirs'])}"] if e["subdirs"] else []
        out += [f"- **Last Indexed**: {e['last_indexed_at'].isoformat()}"] if e["last_indexed_at"] else []
        if e["first_processed"] and e["last_processed"]:
            out.append(f"- **Commit Range**: {e['first_processed'][:8]} to {e['last_processed'][:8]}")
        out.append("")
    return "\n".join(out)
