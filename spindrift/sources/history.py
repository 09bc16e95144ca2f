"""Change histories as a Spark data source: ``spark.read.format("spindrift_history").option("path", …).option("table", "commits")``.

Options: provider (git, p4), path, subdirs, table, revision, message (subject, full), slice_size, batch_size, start_after, start and stop (places of a
stream in its listing), until and known (the listing: what comes before one id, but not before others), base (added to ordinals), command (of the p4 client). Tables: commits (ordinal, id, ts, author, message, diff, files), files (file_path), content (file_path, content). The listing of
ids is made once on the driver and cut into partitions; each partition asks for its own commits. As a stream, the offset is the
place of the next commit in the listing, and a batch holds at most ``batch_size`` commits: their ids alone are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spindrift.sources import git
from spindrift.sources.perforce import Perforce

COMMITS = "ordinal long, id string, ts timestamp, author string, message string, diff string, files array<string>"
SCHEMAS = {"commits": COMMITS, "files": "file_path string", "content": "file_path string, content string"}


class Provider(Protocol):
    """What a version control has to offer. Ids are in the order of the history, oldest first."""

    def detect(self, path: str) -> bool: ...

    def commit_ids(self, path: str, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> list[str]: ...

    def count_ids(self, path: str, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> int: ...

    def ids_between(self, path: str, lo: int, hi: int, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> list[str]: ...

    def place_of(self, path: str, id: str, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> int | None: ...

    def head(self, path: str) -> str | None: ...

    def ancestors(self, path: str, ids: list[str], of: str) -> list[str]: ...

    def ids_after(self, path: str, after: str | None, n: int, subdirs: tuple[str, ...] = ()) -> list[str]: ...

    def read_commits(self, path: str, ids: list[str], subdirs: tuple[str, ...] = (), full_message: bool = False) -> Iterator[tuple]: ...

    def tracked(self, path: str, revision: str = "HEAD", subdirs: tuple[str, ...] = ()) -> list[str]: ...

    def contents(self, path: str, paths: list[str], revision: str = "HEAD") -> Iterator[tuple[str, str | None]]: ...

    def latest_time(self, path: str) -> datetime | None: ...

    def count(self, path: str) -> int: ...


class Git:
    """The functions of ``sources.git``."""

    detect, commit_ids, ids_after, read_commits = map(staticmethod, (git.is_git, git.commit_ids, git.ids_after, git.read_commits))
    head, ancestors, count_ids, ids_between, place_of = map(staticmethod, (git.head, git.ancestors, git.count_ids, git.ids_between, git.place_of))
    tracked, contents, latest_time, count = map(staticmethod, (git.tracked, git.contents, git.latest_time, git.count))


#: In the order in which they are asked whether a path is theirs.
PROVIDERS = {"git": Git, "p4": Perforce}


def provider(name: str, command: str | None = None) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown version control {name!r}; known: {', '.join(PROVIDERS)}")
    return PROVIDERS[name](command) if name == "p4" and command else PROVIDERS[name]()


def content(own: Provider, path: str, file: str, revision: str = "HEAD") -> str | None:
    """One file's text."""
    return next(own.contents(path, [file], revision))[1]


@dataclass
class Slice(InputPartition):
    lo: int
    items: tuple[str, ...]


class _Settings:
    def __init__(self, options: dict[str, str], name: str = "git"):
        self.name, self.command = options.get("provider", name), options.get("command")
        self.path = options.get("path", ".")
        self.subdirs = tuple(s for s in options.get("subdirs", "").split(",") if s)
        self.table = options.get("table", "commits")
        self.revision = options.get("revision", "HEAD")
        self.full = options.get("message", "subject") == "full"
        self.batch = int(options.get("batch_size", options.get("batchsize", "500")))
        self.slice = int(options.get("slice_size", options.get("slicesize", "200")))
        self.after = options.get("start_after", options.get("startafter"))
        self.start, self.stop = int(options.get("start", "0")), int(options.get("stop", "-1"))
        self.until, self.base = options.get("until", "HEAD"), int(options.get("base", "0"))
        self.known = tuple(k for k in options.get("known", "").split(",") if k)
        if self.table not in SCHEMAS:
            raise ValueError(f"table must be one of {', '.join(SCHEMAS)}")

    @property
    def own(self) -> Provider:
        return provider(self.name, self.command)

    def commit_ids(self) -> list[str]:
        return self.own.commit_ids(self.path, self.subdirs, self.until, self.known)

    def slices(self, items: list[str], lo: int = 0) -> list[Slice]:
        return [Slice(lo + i, tuple(items[i : i + self.slice])) for i in range(0, len(items), self.slice)]

    def rows(self, part: Slice) -> Iterator[tuple]:
        if self.table == "commits":
            for i, row in enumerate(self.own.read_commits(self.path, list(part.items), self.subdirs, self.full)):
                yield (self.base + part.lo + i, *row)
        elif self.table == "files":
            for p in part.items:
                yield (p,)
        else:
            yield from self.own.contents(self.path, list(part.items), self.revision)


class HistoryReader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[Slice]:
        s = self.settings
        items = s.commit_ids() if s.table == "commits" else s.own.tracked(s.path, s.revision, s.subdirs)
        return s.slices(items) or [Slice(0, ())]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.settings.rows(partition)


class HistoryStream(DataSourceStreamReader):
    """Commits after the offset, at most a batch at a time; it holds the ids of one batch."""

    def __init__(self, settings: _Settings):
        self.settings = settings
        self.at = self._start()

    def _listing(self) -> tuple:
        s = self.settings
        return s.subdirs, s.until, s.known

    def _start(self) -> int:
        s = self.settings
        if not s.after:
            return s.start
        place = s.own.place_of(s.path, s.after, *self._listing())
        if place is None:
            raise git.UnknownCommitError(s.after)
        return place + 1

    def initialOffset(self) -> dict:
        return {"next": self._start()}

    def latestOffset(self) -> dict:
        s = self.settings
        stop = s.stop if s.stop >= 0 else s.own.count_ids(s.path, *self._listing())
        self.at = max(self.at, min(self.at + self.settings.batch, stop))
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = max(self.at, end["next"])
        s = self.settings
        return s.slices(s.own.ids_between(s.path, start["next"], end["next"], *self._listing()), start["next"]) or [Slice(start["next"], ())]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.settings.rows(partition)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["next"])


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spindrift_history"

    def _settings(self) -> _Settings:
        return _Settings(dict(self.options))

    def schema(self) -> str:
        return SCHEMAS[self._settings().table]

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self._settings())

    def streamReader(self, schema) -> HistoryStream:
        return HistoryStream(self._settings())


class GitSource(HistorySource):
    """``spindrift_history`` of git."""

    @classmethod
    def name(cls) -> str:
        return "spindrift_git"


def register(spark: SparkSession) -> None:
    for source in (HistorySource, GitSource):
        spark.dataSource.register(source)
