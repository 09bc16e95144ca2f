"""Incremental indexing: a history's stream in micro-batches, each from the index's cursor."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.relational import remaining
from spindrift.operators.store import Store
from spindrift.plans import learned
from spindrift.plans.indexing import advance, index_batch, own_numbers
from spindrift.schemas import EXPERTS
from spindrift.sources import history
from spindrift.sources.git import UnknownCommitError

#: Versions of an index that stay readable after a run.
KEPT_VERSIONS = 64


def contents_at(path: str, kind: str = "git", command: str | None = None):
    """Reads files of a workspace at a revision, in partitions of their paths."""

    def read(paths: DataFrame, revision: str) -> DataFrame:
        def run(frames):
            import pandas as pd

            own = history.provider(kind, command)
            for f in frames:
                yield pd.DataFrame(list(own.contents(path, f["file_path"].tolist(), revision)), columns=["file_path", "content"])

        return paths.select("file_path").mapInPandas(run, history.SCHEMAS["content"])

    return read


@dataclass(frozen=True)
class _Run:
    """What a run goes through: the ``n`` changelists before ``target`` that aren't before one of the frontier (the heads whose changelists are all
    indexed), from place ``at`` on. ``listed``: how many all earlier runs went through. No list of ids is held."""

    frontier: list[str]
    target: str | None
    listed: int
    n: int
    at: int

    def moved(self, own: history.Provider, path: str, to: int) -> dict:
        """The cursor's columns at the place ``to``: within the run, or with the target in the frontier in place of what comes before it."""
        if to < self.n:
            return {"frontier": self.frontier, "target": self.target, "listed": self.listed, "place": to}
        before = own.ancestors(path, self.frontier, self.target)
        return {"frontier": [*(f for f in self.frontier if f not in before), self.target], "target": None, "listed": self.listed + self.n, "place": None}


def _run(store: Store, name: str, own: history.Provider, path: str, subdirs: tuple[str, ...], start_after: str | None) -> _Run:
    """The run that was under way, or one to the head as it is now."""
    row = store.table("experts").where(F.col("name") == name).first()
    if start_after is not None:
        head = own.head(path)
        place = own.place_of(path, start_after, subdirs, head) if head else None
        if place is None:
            raise UnknownCommitError(start_after)
        return _Run([], head, 0, own.count_ids(path, subdirs, head), place + 1)
    frontier, listed = list(row.frontier or []), row.listed or 0
    target = row.target or own.head(path)
    n = own.count_ids(path, subdirs, target, tuple(frontier)) if target else 0
    at = row.place or 0
    if row.target is None and not frontier and row.last_processed and target:  # an index from before there were frontiers
        place = own.place_of(path, row.last_processed, subdirs, target)
        at = place + 1 if place is not None else 0
    return _Run(frontier, target, listed, n, at)


def index_workspace(
    spark: SparkSession, store: Store, name: str, path: str, subdirs: tuple[str, ...] = (), batch_size: int = 500, max_commits: int = 10_000,
    start_after: str | None = None, model: str = "hashing", sanitize: bool = True, kind: str = "git", command: str | None = None,
) -> int:
    """Indexes what is new in a workspace; returns how many changelists.

    What is new is what comes before the head and not before the heads that are indexed, so an older branch that is merged later is not missed, wherever a listing has it. Each batch
    is a run of a stream from the index's cursor, which moves in the same commit as the batch's tables; its end is set beforehand, so a limit
    skips nothing. The run's checkpoint lies beside the tables: a batch that was cut off is replayed under its own number.
    """
    history.register(spark)
    own, model = history.provider(kind, command), learned.use(spark, model)
    store.create()
    if store.table("experts").where(F.col("name") == name).isEmpty():
        known = {"name": name, "workspace_path": path, "vcs_type": kind, "subdirs": list(subdirs), "max_commits": max_commits, "embedder": model}
        store.upsert("experts", spark.createDataFrame([tuple(known.get(c) for c in EXPERTS.fieldNames())], EXPERTS))
    done, indexed = 0, store.table("changelists").count()
    run = _run(store, name, own, path, subdirs, start_after)

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        rows = batch.persist()
        ends = rows.agg(F.max_by("id", "ordinal"), F.min("ordinal")).first()
        if ends[0] is not None:
            revision = run.target if run.frontier else ends[0]  # what a merge brings is older than what is indexed: files are as the head has them
            # git says itself which files aren't there; Perforce is asked first
            tracked = None if kind == "git" else spark.createDataFrame([(p,) for p in own.tracked(path, revision, subdirs)], "file_path string")
            # numbered by position, so a replay and a restart with another checkpoint write in the order of the history
            done += index_batch(store, rows, ends[1] + 1, name, contents_at(path, kind, command), tracked, model, sanitize, run.moved(own, path, stop), revision)
        else:  # nothing in it can be described
            last = own.ids_between(path, stop - 1, stop, subdirs, run.target, tuple(run.frontier))[0]
            advance(store, name, last, last, **run.moved(own, path, stop))
        rows.unpersist()

    options = {"provider": kind, **({"command": command} if command else {}), "path": path, "subdirs": ",".join(subdirs), "batch_size": str(batch_size)}
    while run.at < run.n and (room := remaining(max_commits, run.listed + run.n, indexed + done)) > 0:
        at, stop = run.at, min(run.at + min(batch_size, room), run.n)
        own_options = {"until": run.target, "known": ",".join(run.frontier), "base": str(run.listed), "start": str(at), "stop": str(stop)}
        stream = spark.readStream.format("spindrift_history").options(**options, **own_options).load()
        checkpoint = f"{store.root}/_run-{run.listed + at}-{run.listed + stop}"
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        store.remove(checkpoint)
        store.tidy(last=own_numbers(run.listed + at + 1)[0])
        # at the run's end the head is asked for anew: it may have moved
        run = replace(run, at=stop) if stop < run.n else _run(store, name, own, path, subdirs, None)
    store.vacuum(keep=KEPT_VERSIONS, tombstones=False)  # what compactions left a day ago and longer
    return done
