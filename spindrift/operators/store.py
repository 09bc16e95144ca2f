"""Latest-wins tables on plain Parquet under one manifest: a compacted base and a log of later writes for each table.

A log row has the number of the write that brought it and whether it is a tombstone. A read gives the latest row of each key,
base and log together, if it is no tombstone: base rows whose keys the log doesn't hold are read as they lie, without a shuffle, and only
the others meet.

**Commits.** A version is one small file that lists the folders of all tables. A transaction writes its folders first, and then the next
version's file, which it renames into place if no other writer has: so all its tables become visible at once or not at all. A reader holds
a version (``snapshot``) and sees that, whatever is written meanwhile. Of two writers of one version the later rebases on the other's, or
fails with ``Conflict`` if the other changed a table that it has read. The rename must be atomic and refuse to overwrite, as HDFS's does.

**Replays.** A transaction over a range of numbers replaces what was written under them before, in the log and, by a mask, in the base. ``tidy``
leaves the newest numbers in the log, so the batch that may be replayed is whole there. After ``vacuum``, which drops tombstones, numbers up
to the newest are sealed and a write under one fails.

**Look-ups.** A base is ordered by ``CLUSTERED``, and a small table beside it has the least and greatest keys of each of its files, so ``lookup``
reads the files that can hold a value; Parquet's own Bloom filters are on for the columns of ``BLOOMS``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from copy import deepcopy

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.schemas import KEYS, TABLES

_SEQ, _GONE = "batch_seq", "deleted"
#: Columns that a table's files are laid out by, that a base is ordered by, whose ranges are kept for each file, and that have Bloom filters.
LAID_BY = {"vectors": ("collection",)}
CLUSTERED = {
    "changelists": ("id",), "changelist_files": ("file_path", "changelist_id"), "file_contents": ("file_path",), "file_chunks": ("file_path", "id"), "vectors": ("collection", "id"),
    "prompt_cache": ("id",), "experts": ("name",), "vector_cells": ("collection", "cell"), "vector_books": ("collection", "part"), "vector_codes": ("collection", "cell", "id"),
}
RANGED = {**{t: (c[0],) for t, c in CLUSTERED.items()}, "file_chunks": ("file_path", "id"), "vectors": ("id",), "vector_codes": ("cell",)}
BLOOMS = {"changelists": ("id", "author"), "changelist_files": ("changelist_id",), "file_chunks": ("id",), "vectors": ("id",), "vector_codes": ("id",)}
#: Most rows of a base's file; values that a look-up prunes files for, beyond which it filters the whole base.
FILE_ROWS, MOST_VALUES = 1_000_000, 4_000


class Conflict(RuntimeError):
    """Another writer changed a table that the transaction has read."""


class Sealed(ValueError):
    """A write under a number whose tombstones are gone."""


def latest(log: DataFrame, keys: tuple[str, ...], seq: str = _SEQ) -> DataFrame:
    """The row of the latest write of each key. Of rows of one key in one write a hash of their columns decides."""
    rest = [c for c in log.columns if c not in (*keys, seq)]
    if not rest:
        return log.select(*keys).distinct()
    newest = F.max_by(F.struct(*rest), F.struct(seq, F.xxhash64(*rest).alias("tie")))
    return log.groupBy(*keys).agg(newest.alias("r")).select(*keys, *(F.col(f"r.`{c}`").alias(c) for c in rest))


def numbered(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``latest``, with the number of each row's write."""
    return latest(log.withColumn("__at", F.col(_SEQ)), keys).withColumnRenamed("__at", _SEQ)


def insert_new(existing: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows whose keys aren't there yet, each key once."""
    return rows.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def _schema(table: str) -> T.StructType:
    return T.StructType([*TABLES[table].fields, T.StructField(_GONE, T.BooleanType()), T.StructField(_SEQ, T.LongType())])


class _Files:
    """Hadoop's file system under a folder: the manifests need no more than this."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder and when they were changed (milliseconds)."""
        at = self.path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Makes a file with this text, unless there is one."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(part), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(part).toUri() if "://" in name else self.fs.getUri(), self.conf).rename(self.path(part), self.path(name), none)
        except Py4JJavaError as e:
            self.remove(part)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True


def _within(numbers: Iterable[Sequence[int]]) -> Column:
    out = F.lit(False)
    for lo, hi in numbers:
        out = out | F.col(_SEQ).between(lo, hi)
    return out


class Snapshot:
    """The tables as one version has them."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def _entry(self, table: str) -> dict:
        return self.manifest["tables"].get(table, {"base": None, "log": []})

    def _read(self, table: str, paths: Sequence[str]) -> DataFrame:
        where = f"{self.root}/{table}"
        return self.spark.read.schema(_schema(table)).option("basePath", where).parquet(*paths).select(*_schema(table).fieldNames())

    def numbers(self, table: str) -> list[int]:
        """Numbers of the writes since the base."""
        return sorted({n for n, _ in self._entry(table)["log"]})

    def log(self, table: str) -> DataFrame:
        """The writes since the base."""
        paths = [f"{self.root}/{table}/{p}" for _, p in self._entry(table)["log"]]
        return self._read(table, paths) if paths else self.spark.createDataFrame([], _schema(table))

    def base(self, table: str, files: Sequence[str] | None = None) -> DataFrame | None:
        """One row for each key, tombstones too, with its write's number; ``files``: of these alone."""
        base = self._entry(table)["base"]
        if base is None:
            return None
        if files is not None and not files:
            return self.spark.createDataFrame([], _schema(table))
        rows = self._read(table, files if files is not None else [f"{self.root}/{table}/{base['path']}"])
        return rows.where(~_within(base["masked"])) if base["masked"] else rows

    def _rows(self, table: str, base: DataFrame | None = None, where: Column | None = None, key: bool = False) -> DataFrame:
        """The latest row of each key, tombstones too. ``base``: with these of the base's rows; ``where``: rows of a condition; ``key``: on a key."""
        keys, base = list(KEYS[table]), self.base(table) if base is None else base
        log, entry = self.log(table), self._entry(table)
        kept = (lambda df: df.where(where)) if where is not None else (lambda df: df)
        if key:
            log = kept(log)
        if base is None:
            return kept(numbered(log, KEYS[table]))
        if not entry["log"]:
            return kept(base)
        touched = log.select(*keys)
        same = kept(base).join(touched, keys, "left_anti")  # the planner broadcasts the log's keys while its files are small
        # the base's rows of the log's keys matter only where a write is older than the base
        old = kept(base) if key else self.base(table)
        met = log if min(self.numbers(table)) > entry["base"]["folded"] else old.join(touched, keys, "left_semi").unionByName(log)
        return same.unionByName(kept(numbered(met, KEYS[table])))

    def table(self, table: str) -> DataFrame:
        """The current rows."""
        if not self.holds(table):
            return self.spark.createDataFrame([], TABLES[table])
        return self._rows(table).where(~F.col(_GONE)).select(*TABLES[table].fieldNames())

    def holds(self, table: str) -> bool:
        """Whether anything was written to the table."""
        entry = self._entry(table)
        return bool(entry["base"] or entry["log"])

    def files_of(self, table: str, column: str, values: Sequence[object]) -> list[str] | None:
        """The base's files that can hold one of the values; none: all of them."""
        base = self._entry(table)["base"]
        if base is None or not base["ranges"] or column not in RANGED[table] or len(values) > MOST_VALUES:
            return None
        if not values:
            return []
        ranges = self.spark.read.parquet(f"{self.root}/{table}/{base['ranges']}")
        asked = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", TABLES[table][column].dataType)]))
        meets = (F.col(f"least_{column}") <= F.col("v")) & (F.col("v") <= F.col(f"most_{column}"))
        found = ranges.join(F.broadcast(asked), meets, "left_semi")  # at most MOST_VALUES rows
        return [f"{self.root}/{table}/{r.file}" for r in found.select("file").collect()]

    def lookup(self, table: str, column: str, values: Sequence[object]) -> DataFrame:
        """The current rows whose ``column`` is one of the values; of a base in its order only the files that can hold one are read."""
        values = sorted({v for v in values if v is not None})
        base = self.base(table, self.files_of(table, column, values))
        rows = self._rows(table, base, F.col(column).isin(values), column in KEYS[table])
        return rows.where(~F.col(_GONE)).select(*TABLES[table].fieldNames())


class Transaction(Snapshot):
    """Writes that become visible together when it is committed, at the end of its ``with``; its own reads see them at once.

    numbers: the first and last number that are this transaction's own: what was written under them before (``tables``: to these tables) is
    replaced. None: new numbers.
    """

    def __init__(self, store: Store, numbers: tuple[int, int] | None = None, tables: tuple[str, ...] | None = None):
        start = store.manifest()
        super().__init__(store.spark, store.root, deepcopy(start))
        self.store, self.start, self.own, self.only = store, start, numbers, tables
        self.staged: dict[str, list[tuple[int, str]]] = {}
        self.seen: set[str] = set()
        self.bases: dict[str, dict] = {}
        if numbers:
            self._hide(self.manifest)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.commit() if kind is None else self.abort()

    def _hide(self, manifest: dict) -> bool:
        """Takes what was written under the transaction's numbers out of a manifest; whether there was any."""
        (lo, hi), found = self.own, False
        for entry in (e for t, e in manifest["tables"].items() if self.only is None or t in self.only):
            log = [x for x in entry["log"] if not lo <= x[0] <= hi]
            found |= len(log) < len(entry["log"])
            entry["log"] = log
            base = entry["base"]
            if base is not None and lo <= base["folded"] and [lo, hi] not in base["masked"]:
                base["masked"].append([lo, hi])
                found = True
        return found

    def snapshot(self) -> Snapshot:
        """What the transaction sees now; later writes of it aren't in it."""
        return Snapshot(self.spark, self.root, deepcopy(self.manifest))

    def table(self, table: str) -> DataFrame:
        self.seen.add(table)
        return super().table(table)

    def lookup(self, table: str, column: str, values: Sequence[object]) -> DataFrame:
        self.seen.add(table)
        return super().lookup(table, column, values)

    def next(self, table: str) -> int:
        """A number after all that the table has."""
        base = self._entry(table)["base"]
        return max([*self.numbers(table), base["folded"] if base else 0]) + 1

    def _put(self, rows: DataFrame, table: str, seq: int | None, gone: bool) -> int:
        if seq is None:
            seq = self.own[0] if self.own else self.next(table)
            self.seen |= set() if self.own else {table}  # a new number is one that nobody else has taken
        base = self._entry(table)["base"]
        if base is not None and seq <= base["sealed"]:
            raise Sealed(f"{table}: {seq} is sealed, as all numbers to {base['sealed']}")
        full = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields), F.lit(gone).alias(_GONE), F.lit(seq).cast("long").alias(_SEQ))
        folder = f"write={seq}-{uuid.uuid4().hex}"
        full.write.partitionBy(*LAID_BY.get(table, ())).parquet(f"{self.root}/{table}/{folder}")
        self.staged.setdefault(table, []).append((seq, folder))
        self.manifest["tables"].setdefault(table, {"base": None, "log": []})["log"].append([seq, folder])
        return seq

    def upsert(self, table: str, rows: DataFrame, seq: int | None = None) -> int:
        """Adds rows; those with a known key replace the old ones. Returns the write's number."""
        return self._put(rows, table, seq, False)

    def insert_or_ignore(self, table: str, rows: DataFrame, seq: int | None = None) -> int:
        return self._put(insert_new(self.table(table), rows, KEYS[table]), table, seq, False)

    def delete(self, table: str, where: Column | DataFrame, seq: int | None = None) -> int:
        """Deletes by condition, or by a table of key columns; returns how many rows went. Unknown keys are ignored."""
        now = self.table(table)
        if not self.holds(table):
            return 0
        gone = now.where(where) if isinstance(where, Column) else now.join(where.distinct(), where.columns, "left_semi")
        n = gone.count()
        if n:
            keyed = gone.select(*KEYS[table])
            blank = [f.name for f in TABLES[table].fields if f.name not in KEYS[table]]
            self._put(keyed.select("*", *(F.lit(None).alias(c) for c in blank)), table, seq, True)
        return n

    def compact(self, table: str, through: int | None = None, seal: bool = False, file_rows: int = FILE_ROWS) -> None:
        """Folds the writes (to the number ``through``) into a new base; rows keep the numbers of their writes. ``seal``: without tombstones."""
        entry = self._entry(table)
        folded = [x for x in entry["log"] if through is None or x[0] <= through]
        if not folded and not seal and not (entry["base"] and entry["base"]["masked"]):
            return
        self.seen.add(table)
        part = Snapshot(self.spark, self.root, {"version": 0, "tables": {table: {**entry, "log": folded}}})
        rows = part._rows(table)
        if seal:
            rows = rows.where(~F.col(_GONE))
        tag = uuid.uuid4().hex
        where, order = f"{self.root}/{table}", CLUSTERED[table]
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in BLOOMS.get(table, ())} | {"parquet.bloom.filter.adaptive.enabled": "true"}
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.write.options(**blooms).option("maxRecordsPerFile", file_rows).partitionBy(*LAID_BY.get(table, ())).parquet(f"{where}/base={tag}")
        of = F.substring_index(F.col("_metadata.file_path"), f"/{table}/base=", -1)
        ends = [f(F.col(c)).alias(f"{name}_{c}") for c in RANGED[table] for f, name in ((F.min, "least"), (F.max, "most"))]
        written = self.spark.read.schema(_schema(table)).option("basePath", where).parquet(f"{where}/base={tag}")
        files = written.groupBy(F.concat(F.lit("base="), of).alias("file")).agg(*ends, F.count(F.lit(1)).alias("n"))
        files.write.parquet(f"{where}/ranges={tag}")
        top = max([x[0] for x in folded] + ([entry["base"]["folded"]] if entry["base"] else [0]))
        sealed = top if seal else entry["base"]["sealed"] if entry["base"] else -1
        base = {"path": f"base={tag}", "ranges": f"ranges={tag}", "folded": top, "sealed": sealed, "masked": []}
        self.bases[table] = base
        self.manifest["tables"][table] = {"base": base, "log": [x for x in entry["log"] if x not in folded]}

    def commit(self) -> int:
        """Makes the writes visible; returns the version. Conflict: another writer changed a table that this one has read."""
        while True:
            now = self.store.manifest()
            new = self.manifest
            if now["version"] != self.start["version"]:
                changed = {t for t in {*now["tables"], *self.start["tables"]} if now["tables"].get(t) != self.start["tables"].get(t)}
                if changed & self.seen:
                    self.abort()
                    raise Conflict(f"changed meanwhile: {', '.join(sorted(changed & self.seen))}")
                new = deepcopy(now)
                if self.own:
                    self._hide(new)
                for t, base in self.bases.items():  # their tables have been read, so nobody changed them
                    new["tables"][t] = deepcopy(self.manifest["tables"][t])
                for t, writes in self.staged.items():
                    entry = new["tables"].setdefault(t, {"base": None, "log": []})
                    if t not in self.bases:
                        entry["log"] += [list(x) for x in writes]
            if new["tables"] == now["tables"]:
                return now["version"]
            new["version"] = now["version"] + 1
            if self.store.files.put_if_absent(self.store.version_file(new["version"]), json.dumps(new)):
                self.manifest = self.start = new
                return new["version"]

    def abort(self) -> None:
        """Deletes what was written and never became visible."""
        for table, writes in self.staged.items():
            for _, folder in writes:
                self.store.files.remove(f"{self.root}/{table}/{folder}")
        for table, base in self.bases.items():
            for name in (base["path"], base["ranges"]):
                self.store.files.remove(f"{self.root}/{table}/{name}")


class Store:
    """The tables of one index under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)

    def version_file(self, version: int) -> str:
        return f"{self.root}/_versions/{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n, _ in self.files.names(f"{self.root}/_versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (none: the newest) is made of."""
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "tables": {}}
        return json.loads(self.files.text(self.version_file(known[-1] if version is None else version)))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one, to be read from as it is now."""
        return Snapshot(self.spark, self.root, self.manifest(version))

    def transaction(self, first: int | None = None, last: int | None = None, *tables: str) -> Transaction:
        """A transaction under new numbers, or under those from ``first`` to ``last``, whose earlier writes (to ``tables``, or to all) it replaces."""
        return Transaction(self, None if first is None else (first, first if last is None else last), tables or None)

    def create(self) -> None:
        """Makes the store, if it isn't there."""
        if not self.versions():
            self.files.put_if_absent(self.version_file(1), json.dumps({"version": 1, "tables": {t: {"base": None, "log": []} for t in TABLES}}))

    def exists(self) -> bool:
        return bool(self.versions())

    def table(self, table: str) -> DataFrame:
        """The current rows."""
        return self.snapshot().table(table)

    def log(self, table: str) -> DataFrame:
        return self.snapshot().log(table)

    def base(self, table: str) -> DataFrame | None:
        return self.snapshot().base(table)

    def lookup(self, table: str, column: str, values: Sequence[object]) -> DataFrame:
        return self.snapshot().lookup(table, column, values)

    def remove(self, path: str) -> None:
        """Deletes a folder, if it is there."""
        self.files.remove(path)

    def upsert(self, table: str, rows: DataFrame, seq: int | None = None) -> int:
        with self.transaction(seq, seq, table) as t:
            return t.upsert(table, rows, seq)

    def insert_or_ignore(self, table: str, rows: DataFrame, seq: int | None = None) -> int:
        with self.transaction(seq, seq, table) as t:
            return t.insert_or_ignore(table, rows, seq)

    def delete(self, table: str, where: Column | DataFrame, seq: int | None = None) -> int:
        with self.transaction(seq, seq, table) as t:
            return t.delete(table, where, seq)

    def compact(self, table: str, through: int | None = None, file_rows: int = FILE_ROWS) -> None:
        """Folds the log into a new base. Older versions stay readable until ``vacuum``."""
        with self.transaction() as t:
            t.compact(table, through, file_rows=file_rows)

    def tidy(self, most: int = 8, last: int = 0) -> None:
        """Compacts the tables that have more than ``most`` writes since their base, but for numbers from ``last`` on (0: the newest)."""
        with self.transaction() as t:
            for table in TABLES:
                numbers = t.numbers(table)
                if len(numbers) > most:
                    t.compact(table, through=(last or numbers[-1]) - 1)

    def vacuum(self, keep: int = 1, older_ms: int = 86_400_000, tombstones: bool = True) -> int:
        """Drops tombstones and seals their numbers; deletes all versions but the last ``keep``, and folders that those don't name and that haven't
        changed for ``older_ms``. Returns how many folders went. Readers of older versions, and writers that have been at it for longer, fail."""
        if tombstones:
            with self.transaction() as t:
                for table in TABLES:
                    base = t._entry(table)["base"]
                    if t.numbers(table) or base and base["folded"] > base["sealed"]:
                        t.compact(table, seal=True)
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        now = max((m for _, m in self.files.names(f"{self.root}/_versions")), default=0)
        gone = 0
        for table in TABLES:
            named = set()
            for m in kept:
                entry = m["tables"].get(table, {"base": None, "log": []})
                named |= {p for _, p in entry["log"]} | ({entry["base"]["path"], entry["base"]["ranges"]} if entry["base"] else set())
            for name, changed in self.files.names(f"{self.root}/{table}"):
                if name not in named and changed <= now - older_ms:
                    self.files.remove(f"{self.root}/{table}/{name}")
                    gone += 1
        for v in known[:-keep]:
            self.files.remove(self.version_file(v))
        return gone
