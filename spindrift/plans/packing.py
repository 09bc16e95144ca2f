"""Batches of a model's inputs, packed greedily in order, in parallel: also one group of all rows is dealt to many tasks.

The packer (``models.Packer``) goes through a group in order: an item joins the open batch if the batch's cost stays within the capacity, else it opens the next one; an item
that is over the capacity alone gets a batch of its own and leaves the open one open. Where a batch ends depends on where it began, so on all rows
before. But what a piece of consecutive rows does depends on one number alone, the open batch's cost: it fixes which row of the piece opens the first batch, and from there
on each opening row fixes the next (a search in the prefix sums; by pointer doubling the last one that is reached inside the piece). As every item costs at least one unit,
only the rows of the first capacity's worth can be first: a piece is a small table, from first opening row to cost, openings and number at its end. Tables of consecutive pieces
compose to one of the same size. So pieces are summed up in parallel, their tables composed level by level, ``FAN`` at a time, and the states
go down again to the pieces, which number their rows. All sums are of integers: the answer is the sequential packer's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spindrift.functions.models import UNIT_TOKENS
from spindrift.plans.scratch import folder

#: Rows of a piece, give or take the sampling of ranges; pieces whose tables are composed in one task.
PIECE_ROWS, FAN = 500_000, 1_000
_LONGS = T.ArrayType(T.LongType())
_TABLE = [("room", _LONGS), ("used", _LONGS), ("opened", _LONGS), ("last", _LONGS), ("total", T.LongType()), ("alone", T.LongType())]
_STATE = [("used_in", T.LongType()), ("before", T.LongType()), ("open_no", T.LongType())]


@dataclass
class Piece:
    """What consecutive rows do: for the k-th candidate of the first row that opens a batch (which it is if the room left is under ``room[k]`` and not under
    ``room[k - 1]``) the open batch's cost at the end, how many batches were opened, and the number of the last of them among the piece's new batches. ``total``: cost of all
    rows that aren't alone; ``alone``: how many rows are over the capacity."""

    room: np.ndarray
    used: np.ndarray
    opened: np.ndarray
    last: np.ndarray
    total: int
    alone: int

    def enter(self, capacity: int, used: int, before: int, open_no: int) -> tuple[int, int, int]:
        """The state after the rows: the open batch's cost, batches so far, its number."""
        k = int(np.searchsorted(self.room, capacity - used, side="right"))
        if k == len(self.room):
            return used + self.total, before + self.alone, open_no
        return int(self.used[k]), before + int(self.opened[k]) + self.alone, before + int(self.last[k])

    def then(self, other: Piece, capacity: int) -> Piece:
        """This piece and the next as one."""
        k = np.searchsorted(other.room, capacity - self.used, side="right")
        ends, at = k == len(other.room), np.minimum(k, max(0, len(other.room) - 1))
        pick = lambda a: a[at] if len(a) else np.zeros(len(at), np.int64)
        used = np.where(ends, self.used + other.total, pick(other.used))
        opened = self.opened + np.where(ends, 0, pick(other.opened))
        last = np.where(ends, self.last, self.opened + self.alone + pick(other.last))
        m = 0  # candidates of the next piece, where this one opens none
        if self.total <= capacity:
            m = int(np.searchsorted(np.concatenate([[0], other.room[:-1]]) + self.total, capacity, side="right")) if len(other.room) else 0
        join = lambda a, b: np.concatenate([a, b[:m]])
        return Piece(join(self.room, other.room + self.total), join(used, other.used), join(opened, other.opened), join(last, other.last + self.alone), self.total + other.total, self.alone + other.alone)

    def row(self) -> dict:
        return {"room": self.room.tolist(), "used": self.used.tolist(), "opened": self.opened.tolist(), "last": self.last.tolist(), "total": self.total, "alone": self.alone}

    @staticmethod
    def of(row: dict) -> Piece:
        return Piece(*(np.array(row[c], np.int64) for c in ("room", "used", "opened", "last")), row["total"], row["alone"])


def _costs(tokens: np.ndarray) -> np.ndarray:
    """Attention's cost in whole numbers: the square of the tokens, at least of one unit."""
    return np.maximum(tokens, UNIT_TOKENS) ** 2


def _split(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the costs of the rows that aren't alone, their places, and how many are alone before each."""
    # beyond any capacity a row is alone, however long: no square overflows
    costs = _costs(np.minimum(tokens, math.isqrt(capacity) + UNIT_TOKENS + 1))
    shared = costs <= capacity
    at = np.flatnonzero(shared)
    return np.cumsum(costs[at]), at, np.cumsum(~shared)[at] if len(at) else np.zeros(0, np.int64)


def _next(prefix: np.ndarray, capacity: int) -> np.ndarray:
    """For each row the one that opens the next batch if this one opens a batch; the number of rows if none does."""
    return np.searchsorted(prefix, np.concatenate([[0], prefix[:-1]]) + capacity, side="right") if len(prefix) else np.zeros(0, np.int64)


def summed_up(tokens: np.ndarray, capacity: int) -> Piece:
    """The table of consecutive rows."""
    prefix, _, alone = _split(tokens, capacity)
    n, then = len(prefix), _next(prefix, capacity)
    final, opened, jump = np.where(then == n, np.arange(n), then), np.ones(n + 1, np.int64), np.append(then, n)
    opened[n] = 0
    while (jump[:n] < n).any():  # pointer doubling: how many openings follow, and which is the last
        opened = opened + opened[jump]
        jump, final = jump[jump], final[final]
    m = int(np.searchsorted(np.concatenate([[0], prefix[:-1]]), capacity, side="right")) if n else 0
    used = (prefix[-1] - np.concatenate([[0], prefix])[final[:m]]) if n else np.zeros(0, np.int64)
    return Piece(prefix[:m], used, opened[:m], opened[:m] - 1 + alone[final[:m]] if n else np.zeros(0, np.int64), int(prefix[-1]) if n else 0, len(tokens) - n)


def numbers(tokens: np.ndarray, capacity: int, used: int, before: int, open_no: int) -> np.ndarray:
    """The batch of each row, from the state before the first."""
    prefix, at, alone = _split(tokens, capacity)
    then = _next(prefix, capacity)
    starts, i = [], int(np.searchsorted(prefix, capacity - used, side="right"))
    while i < len(prefix):
        starts.append(i)
        i = int(then[i])
    out = np.zeros(len(tokens), np.int64)
    opened = np.zeros(len(prefix), np.int64)
    opened[starts] = 1
    nth = np.cumsum(opened)
    own = before + np.arange(len(starts)) + alone[starts] if starts else np.zeros(0, np.int64)
    out[at] = np.where(nth > 0, own[np.maximum(nth - 1, 0)] if starts else 0, open_no)
    single = np.ones(len(tokens), bool)
    single[at] = False
    events = np.zeros(len(tokens), np.int64)
    events[at[starts] if starts else []] = 1
    events[single] = 1
    out[single] = before + np.cumsum(events)[single] - 1
    return out


def batch_numbers(df: DataFrame, group: str, order: str, tokens: str, most_tokens: int, piece_rows: int = PIECE_ROWS, fan: int = FAN) -> DataFrame:
    """group, order and batch_no of every row, packed in order (rows of one place by their tokens) inside its group; a null number of tokens is 0."""
    spark, capacity = df.sparkSession, most_tokens * UNIT_TOKENS
    own = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("t"))
    kind, place = own.schema["g"].dataType, own.schema["o"].dataType
    pieces = max(1, math.ceil(own.count() / piece_rows))
    at = folder(spark, "pieces")
    own.repartitionByRange(pieces, "g", "o", "t").withColumn("piece", F.spark_partition_id().cast("long")).write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")

    def table(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField("g", kind), T.StructField("piece", T.LongType()), *(T.StructField(*f) for f in fields)])

    def sum_up(t: pa.Table) -> pa.Table:
        t = t.sort_by([("o", "ascending"), ("t", "ascending")])
        return pa.Table.from_pylist([{"g": t.column("g")[0].as_py(), "piece": t.column("piece")[0].as_py(), **summed_up(t.column("t").to_numpy(), capacity).row()}], schema=to_arrow_schema(table(*_TABLE)))

    def compose(t: pa.Table) -> pa.Table:
        parts = t.sort_by("piece").to_pylist()
        whole = Piece.of(parts[0])
        for p in parts[1:]:
            whole = whole.then(Piece.of(p), capacity)
        return pa.Table.from_pylist([{"g": parts[0]["g"], "piece": parts[0]["above"], **whole.row()}], schema=to_arrow_schema(table(*_TABLE)))

    def go_down(t: pa.Table) -> pa.Table:
        parts = t.sort_by("piece").to_pylist()
        state, out = tuple(parts[0][c] for c, _ in _STATE), []
        for p in parts:
            out.append({"g": p["g"], "piece": p["piece"], **dict(zip((c for c, _ in _STATE), state, strict=True))})
            state = Piece.of(p).enter(capacity, *state)
        return pa.Table.from_pylist(out, schema=to_arrow_schema(table(*_STATE)))

    def number(t: pa.Table) -> pa.Table:
        t = t.sort_by([("o", "ascending"), ("t", "ascending")])
        made = numbers(t.column("t").to_numpy(), capacity, *(t.column(c)[0].as_py() for c, _ in _STATE))
        return pa.table([t.column("g"), t.column("o"), pa.array(made.astype(np.int32))], schema=to_arrow_schema(out))

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{at}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{at}/{name}")

    out = T.StructType([T.StructField("g", kind), T.StructField("o", place), T.StructField("batch_no", T.IntegerType())])
    levels = [kept(rows.groupBy("g", "piece").applyInArrow(sum_up, table(*_TABLE)), "level0")]
    while levels[-1].groupBy("g").count().agg(F.max("count")).first()[0] not in (None, 1):
        above = levels[-1].withColumn("above", F.floor(F.col("piece") / fan).cast("long"))
        levels.append(kept(above.groupBy("g", "above").applyInArrow(compose, table(*_TABLE)), f"level{len(levels)}"))
    # before a group's first row no batch is open: as if a full one were
    states = levels[-1].select("g", "piece", F.lit(capacity).cast("long").alias("used_in"), F.lit(0).cast("long").alias("before"), F.lit(-1).cast("long").alias("open_no"))
    for i in range(len(levels) - 2, -1, -1):
        above = states.withColumnRenamed("piece", "above").withColumnRenamed("g", "h")
        level = levels[i].withColumn("above", F.floor(F.col("piece") / fan).cast("long"))
        met = level.join(above.withColumnRenamed("above", "over"), F.col("g").eqNullSafe(F.col("h")) & (F.col("above") == F.col("over"))).drop("h", "over")
        states = kept(met.groupBy("g", "above").applyInArrow(go_down, table(*_STATE)), f"states{i}")
    known = states.withColumnRenamed("g", "h").withColumnRenamed("piece", "p")
    both = rows.join(known, F.col("g").eqNullSafe(F.col("h")) & (F.col("piece") == F.col("p"))).drop("h", "p")
    return both.groupBy("g", "piece").applyInArrow(number, out).toDF(group, order, "batch_no")
