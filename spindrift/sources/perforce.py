"""Perforce history: listings, descriptions and file contents, from the text that ``p4`` prints.

Parsing is separate from running the client (``Perforce``), so the parsers work on any table of captured output (``describe_rows``).
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.functions.text import filter_binary, perforce_timestamp
from spindrift.sources.git import looks_binary

DESCRIBED = "id string, ts timestamp, author string, message string, diff string, files array<string>"
_HEADER = re.compile(r"^Change (\d+) by (\S+) on (\d{4}/\d\d/\d\d)(?: (\d\d:\d\d:\d\d))?.*$", re.M)
_FILE = re.compile(r"^\.\.\. (//[^#\n]+)(?:#\d+)?", re.M)
#: Actions that leave no file.
GONE = ("delete", "move/delete", "purge", "archive")
#: Captured outputs of an Arrow batch that are parsed at a time.
SLICE_ROWS = 1024
_SECTION = re.compile(r"(?m)^(?===== //)")


class PerforceError(RuntimeError):
    """p4 failed."""


class UnknownChangeError(ValueError):
    """The cursor is no changelist number."""


def p4(path: str, *args: str, command: str = "p4") -> str:
    try:
        done = subprocess.run([command, *args], cwd=path, capture_output=True, check=False)
    except OSError as e:
        raise PerforceError(str(e)) from e
    if done.returncode:
        raise PerforceError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "replace")


def client_root(info: str) -> str | None:
    m = re.search(r"^Client root: (.+?)\s*$", info, re.M)
    return m[1] if m else None


def changelist_ids(listing: str) -> list[str]:
    """Distinct changelist numbers of ``p4 changes`` output, in numeric order."""
    return [str(n) for n in sorted({int(m[1]) for m in re.finditer(r"^Change (\d+)\b", listing, re.M)})]


def latest_time(listing: str) -> datetime | None:
    """The time of the first change listed, wherever the line has it."""
    m = re.search(r"(\d{4}/\d\d/\d\d)(?: (\d\d:\d\d:\d\d))?", listing)
    return datetime.strptime(f"{m[1]} {m[2] or '00:00:00'}", "%Y/%m/%d %H:%M:%S").replace(tzinfo=UTC) if m else None


class Mapping:
    """Depot and local prefixes of a workspace."""

    def __init__(self, depot: str, local: str):
        self.depot, self.local = depot.removesuffix("...").rstrip("/"), local.removesuffix("...").rstrip("/")

    @classmethod
    def of_where(cls, printed: str) -> Mapping | None:
        """From ``p4 where //...``: depot path, client path, local path."""
        m = re.match(r"(//\S+) (//\S+) (.+)", printed.strip())
        return cls(m[1], m[3]) if m else None

    def to_local(self, depot: str) -> str:
        """Relative to the workspace; as it is when it lies outside."""
        return depot[len(self.depot) + 1 :] if depot.startswith(self.depot + "/") else depot

    def to_depot(self, subdir: str) -> str:
        return f"{self.depot}/{subdir.strip('/')}" if subdir.strip("/") else self.depot


def described(output: str, mapping: Mapping | None = None, prefixes: tuple[str, ...] = ()) -> Iterator[tuple]:
    """DESCRIBED rows from ``p4 describe -du`` output; files and diff sections only under the depot prefixes."""
    under = lambda path: not prefixes or path.startswith(prefixes)
    heads = list(_HEADER.finditer(output))
    for head, after in zip(heads, [*heads, None][1:], strict=True):
        try:
            ts = datetime.strptime(f"{head[3]} {head[4] or '00:00:00'}", "%Y/%m/%d %H:%M:%S").replace(tzinfo=UTC)
        except ValueError:
            continue
        body = output[head.end() : after.start() if after else len(output)]
        about, _, diff = body.partition("\nDifferences ...")
        said, _, listed = about.partition("\nAffected files ...")
        message = "\n".join(line.strip() for line in said.splitlines() if line[:1] in ("\t", " ") and line.strip())
        files = [mapping.to_local(p) if mapping else p for p in _FILE.findall(listed) if under(p)]
        kept = [s for s in _SECTION.split(diff) if s.startswith("==== //") and under(s.split()[1].split("#")[0])]
        yield head[1], ts, head[2], message or f"Changelist {head[1]}", "".join(kept).strip("\n"), files


def describe_rows(captured: DataFrame, column: str = "output", mapping: Mapping | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """DESCRIBED rows from a table of captured output: binary sections replaced, changelists without diff dropped."""

    schema = to_arrow_schema(T.StructType.fromDDL(DESCRIBED))

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for at in range(0, f.num_rows, SLICE_ROWS):
                rows = [r for text in f[column].slice(at, SLICE_ROWS) for r in described(text.as_py() or "", mapping, prefixes)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = captured.select(column).mapInArrow(run, DESCRIBED).where(F.trim("diff") != "")  # what stands for a binary section isn't blank, and neither is the section
    return rows.withColumn("diff", filter_binary(F.col("diff"), "==== //")["diff"])


def listed_rows(captured: DataFrame, column: str = "output") -> DataFrame:
    """cl, ts, author of every line of captured ``p4 changes`` output; times of day where the lines have them."""
    line = F.explode(F.split(column, "\n")).alias("line")
    part = lambda pattern, i: F.regexp_extract("line", pattern, i)
    head = r"^Change (\d+) on (\d{4}/\d\d/\d\d)(?: (\d\d:\d\d:\d\d))? by (\S+)"
    when = F.concat_ws(" ", part(head, 2), F.coalesce(F.nullif(part(head, 3), F.lit("")), F.lit("00:00:00")))
    rows = captured.select(line).where(F.col("line").rlike(head))
    return rows.select(part(head, 1).alias("cl"), perforce_timestamp(when).alias("ts"), part(head, 4).alias("author"))


def tracked_rows(captured: DataFrame, mapping: Mapping, column: str = "output") -> DataFrame:
    """The distinct local paths in captured ``p4 files`` output, without deleted files."""
    line = captured.select(F.explode(F.split(column, "\n")).alias("line"))
    found = line.select(*(F.regexp_extract("line", r"^(//[^#\n]+)#\d+ - (\S+)", i).alias(c) for i, c in ((1, "depot"), (2, "action"))))
    kept = found.where((F.col("depot") != "") & ~F.col("action").isin(*GONE))
    return kept.select(local_path(F.col("depot"), mapping).alias("file_path")).distinct()


def local_path(depot: Column, mapping: Mapping) -> Column:
    """``Mapping.to_local`` of a column."""
    return F.when(F.startswith(depot, F.lit(f"{mapping.depot}/")), F.substring(depot, len(mapping.depot) + 2, F.lit(1 << 30))).otherwise(depot)


def printed_rows(captured: DataFrame, mapping: Mapping, column: str = "output") -> DataFrame:
    """file_path, content of the files in captured ``p4 print`` output."""

    def run(frames: Iterable) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = [(mapping.to_local(p), t) for text in f[column] for p, t in printed_files(text or "")]
            yield pd.DataFrame(rows, columns=["file_path", "content"])

    return captured.select(column).mapInPandas(run, "file_path string, content string")


def printed_files(output: str) -> Iterator[tuple[str, str | None]]:
    """(depot path, text) from ``p4 print`` output; None for binary and empty files."""
    parts = re.split(r"(?m)^(//[^#\n]+)#\d+ - .*?\(([^)]*)\)[^\n]*\n", output)
    for path, kind, text in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        text = text.removesuffix("\n")
        yield path, None if "binary" in kind or not text or looks_binary(text.encode()) else text


def tracked_files(listing: str) -> list[str]:
    """Depot paths of ``p4 files`` output, without deleted ones."""
    found = re.finditer(r"^(//[^#\n]+)#\d+ - (\S+)", listing, re.M)
    return [m[1] for m in found if m[2] not in GONE]


CONTENT_BATCH = 50


class Perforce:
    """A workspace's history through the ``p4`` client."""

    def __init__(self, command: str = "p4"):
        self.command = command
        self._mappings: dict[str, Mapping] = {}

    def _run(self, path: str, *args: str) -> str:
        return p4(path, *args, command=self.command)

    def detect(self, path: str) -> bool:
        """The path lies in the root of the client that ``p4 info`` names."""
        try:
            root = client_root(self._run(path, "info"))
        except PerforceError:
            return False
        return root is not None and Path(path).resolve().is_relative_to(Path(root).resolve())

    def mapping(self, path: str) -> Mapping:
        """The workspace's mapping; asked for once."""
        if path not in self._mappings:
            found = Mapping.of_where(self._run(path, "where", "//..."))
            if found is None:
                raise PerforceError(f"{path} is mapped to no depot")
            self._mappings[path] = found
        return self._mappings[path]

    def _prefixes(self, path: str, subdirs: tuple[str, ...]) -> tuple[str, ...]:
        own = self.mapping(path)
        return tuple(f"{own.to_depot(s)}/" for s in subdirs or ("",))

    def commit_ids(self, path: str, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> list[str]:
        """Numbers of the submitted changelists under the subdirectories, in numeric order, each once: to ``until``, and beyond all ``known`` ones (a changelist gets its number
        when it is submitted)."""
        ids = changelist_ids("\n".join(self._run(path, "changes", "-s", "submitted", f"{p}...") for p in self._prefixes(path, subdirs)))
        least = max(map(int, known), default=-1)
        return [i for i in ids if int(i) > least and (until == "HEAD" or int(i) <= int(until))]

    def count_ids(self, path: str, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> int:
        return len(self.commit_ids(path, subdirs, until, known))

    def ids_between(self, path: str, lo: int, hi: int, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> list[str]:
        """The numbers at some places of the listing: it is short text, and held for the call."""
        return self.commit_ids(path, subdirs, until, known)[max(0, lo) : hi]

    def place_of(self, path: str, id: str, subdirs: tuple[str, ...] = (), until: str = "HEAD", known: tuple[str, ...] = ()) -> int | None:
        ids = self.commit_ids(path, subdirs, until, known)
        return ids.index(id) if id in ids else None

    def head(self, path: str) -> str | None:
        """The newest changelist's number; None without any."""
        return next(reversed(self.commit_ids(path)), None)

    def ancestors(self, path: str, ids: list[str], of: str) -> list[str]:
        """Those of ``ids`` that aren't after ``of``."""
        return [i for i in ids if int(i) <= int(of)]

    def ids_after(self, path: str, after: str | None, n: int, subdirs: tuple[str, ...] = ()) -> list[str]:
        """The next ``n`` numbers after a changelist: none if it is outside the listing, an error if it is no number."""
        if after is not None and not after.isdigit():
            raise UnknownChangeError(after)
        ids = self.commit_ids(path, subdirs)
        if after is None:
            return ids[: max(0, n)]
        return ids[ids.index(after) + 1 :][: max(0, n)] if after in ids else []

    def read_commits(self, path: str, ids: list[str], subdirs: tuple[str, ...] = (), full_message: bool = True) -> Iterator[tuple]:
        """(id, ts, author, message, diff, files) of the changelists, in their order; only files under the subdirectories."""
        if not ids:
            return
        found = described(self._run(path, "describe", "-du", *ids), self.mapping(path), self._prefixes(path, subdirs))
        told = {row[0]: row for row in found}
        for id in ids:
            if id in told:
                yield told[id] if full_message else (*told[id][:3], told[id][3].split("\n", 1)[0], *told[id][4:])

    def tracked(self, path: str, revision: str = "HEAD", subdirs: tuple[str, ...] = ()) -> list[str]:
        """Local paths of the files as of a changelist."""
        at = "" if revision == "HEAD" else f"@{revision}"
        own, out = self.mapping(path), []
        for p in self._prefixes(path, subdirs):
            try:
                out += tracked_files(self._run(path, "files", f"{p}...{at}"))
            except PerforceError as e:
                if "no such file" not in str(e):
                    raise
        return sorted({own.to_local(p) for p in out})

    def contents(self, path: str, paths: list[str], revision: str = "HEAD") -> Iterator[tuple[str, str | None]]:
        """(path, text) as of a changelist, a row for each path; None for missing, empty and binary files."""
        at, own = "" if revision == "HEAD" else f"@{revision}", self.mapping(path)
        for lo in range(0, len(paths), CONTENT_BATCH):
            some = paths[lo : lo + CONTENT_BATCH]
            try:
                found = dict(printed_files(self._run(path, "print", *(f"{own.to_depot(p)}{at}" for p in some))))
            except PerforceError as e:
                if "no such file" not in str(e):
                    raise
                found = {}
            for p in some:
                yield p, found.get(own.to_depot(p))

    def latest_time(self, path: str) -> datetime | None:
        return latest_time(self._run(path, "changes", "-t", "-m", "1", "-s", "submitted", f"{self.mapping(path).depot}/..."))

    def count(self, path: str) -> int:
        """How many submitted changelists; 0 where the client fails."""
        try:
            return len(self.commit_ids(path))
        except PerforceError:
            return 0
