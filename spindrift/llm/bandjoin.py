"""Numeric band join: every item's nearest lines by price, with counts and sums over all lines in its band.

Amounts in cents are ``floor(100 * x + 0.5)``. A line's unit price is u, the nearest integer to amount / quantity, halves up, in exact
integers. An item of price p pairs with every line of another item_id whose gap |u - p| is at most ``least`` or ``per_mille`` thousandths of p.

Lines shrink before anything else: equal (u, item_id) to counts and their first ``k`` lines, these to one leaf for each distinct u.
Leaves are dealt to range shards of u, whose width is a fixed function of u (no quantiles, no driver). In a shard a segment tree stands over its
leaves; a node holds sums and two top-k lists (u rising and u falling), *diversified*: at most ``k`` lines of one item, 2 * k in all, so k are left
whichever one item is excluded. Each distinct price is one interval query on the shards that it meets: its canonical nodes' sums add
up, their lists are merged in the order of the gap. Items then take their price's answer without their own lines, whose sums come by an
equi-join on item_id. So a hot item, line or price costs a row a task, and no step gathers what grows with the lines.

Defined cases: lines without sale_id, item_id, quantity or amount, with a quantity under 1, or with an amount that isn't finite or is 1e13 or
more, pair with nothing; so do items without item_id or price or with such a price. A null line_no counts as smallest and is empty in the
CRC's text. Repeated lines each count and take a rank each; repeated items each get their rows. Empty tables give one row an item, or
none. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

LINE = T.StructType([T.StructField("u", T.LongType()), T.StructField("sale_id", T.LongType()), T.StructField("line_no", T.LongType()), T.StructField("item", T.LongType())])
ANSWER = T.StructType([
    T.StructField("p", T.LongType()), T.StructField("n", T.LongType()), T.StructField("gaps", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("near", T.ArrayType(LINE)),
])
#: Shards are so many units of u wide below 2 ** FLAT_BITS, and a 2 ** -OCTAVE_BITS part of their octave above: a band of 4 thousandths meets three at most.
WIDTH_BITS, OCTAVE_BITS, FLAT_BITS = 9, 7, 16


def cents(value: Column) -> Column:
    """Null where the value isn't finite or too large for exact sums."""
    x = F.floor(value.cast("double") * 100.0 + 0.5)
    return F.when(~F.isnan(value) & (F.abs(value) < 1e13), x.cast("long"))


def floor_div(a: Column, b: Column) -> Column:
    """Exact integer quotient, rounded down; ``b`` is positive. (The ``/`` of columns is one of doubles.)"""
    rest = F.pmod(a, b)
    return F.call_function("div", a - rest, b)


def shard(u: Column) -> Column:
    """The range shard of u: rising with u, without gaps between neighbours."""
    at = F.when(u < 0, -1 - u).otherwise(u)
    k = F.length(F.bin(at)) - 1
    per = 1 << OCTAVE_BITS
    far = (k - FLAT_BITS).cast("long") * per + F.call_function("div", at - F.call_function("shiftleft", F.lit(1).cast("long"), k), F.call_function("shiftleft", F.lit(1).cast("long"), k - OCTAVE_BITS))
    n = F.when(at < (1 << FLAT_BITS), F.call_function("div", at, F.lit(1 << WIDTH_BITS).cast("long"))).otherwise(far + (1 << (FLAT_BITS - WIDTH_BITS)))
    return F.when(u < 0, -1 - n).otherwise(n)


def priced_lines(lines: DataFrame) -> DataFrame:
    """item, u, sale_id, line_no, crc of the lines that can pair."""
    a, q = cents(F.col("amount")), F.col("quantity").cast("long")
    rows = lines.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("item_id").cast("long").alias("item"), q.alias("q"), a.alias("a"))
    rows = rows.where("sale_id is not null and item is not null and a is not null and q >= 1")
    text = F.concat(F.col("sale_id").cast("string"), F.lit(","), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.lit(","), F.col("item").cast("string"))
    return rows.select("item", floor_div(2 * F.col("a") + F.col("q"), 2 * F.col("q")).alias("u"), "sale_id", "line_no", F.crc32(text.cast("binary")).alias("crc"))


def leaves(lines: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(item, u, n, crc of every item and u; u, n, crc, first of every u), from ``priced_lines``.

    ``first``: the first 2 * k lines of the u with at most k of an item. Both limits are ranks under a bound, which Spark applies
    before it shuffles.
    """
    sums = written(lines.groupBy("item", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc")), "band-sums")
    order = [F.col("sale_id"), F.col("line_no").asc_nulls_first(), F.col("item")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = lines.select("item", "u", "sale_id", "line_no").withColumn("r", rank("item", "u")).where(F.col("r") <= k).drop("r")
    few = few.withColumn("r", rank("u")).where(F.col("r") <= 2 * k)
    line = F.struct("r", "sale_id", "line_no", "item")
    first = few.groupBy("u").agg(F.array_sort(F.collect_list(line)).alias("first"))
    return sums, sums.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).join(first, "u")


class SegmentTree:
    """A segment tree over the distinct u of a shard; node 1 is the root, node i has the children 2 * i and 2 * i + 1.

    ``n``, ``total`` (of u), ``crc`` are sums; ``up`` and ``down`` a node's diversified lists of (u, sale_id, line_no, item) with u rising
    and falling.
    """

    def __init__(self, u: np.ndarray, n: np.ndarray, crc: np.ndarray, first: list[list[tuple]], k: int):
        self.k, self.u = k, u
        self.size = 1 << max(0, len(u) - 1).bit_length()
        sums = np.zeros((2 * self.size, 3), np.int64)
        sums[self.size : self.size + len(u)] = np.stack([n, n * u, crc], axis=1)
        self.up: list[list[tuple]] = [[] for _ in range(2 * self.size)]
        self.up[self.size : self.size + len(u)] = first
        self.down = list(self.up)
        for i in range(self.size - 1, 0, -1):
            sums[i] = sums[2 * i] + sums[2 * i + 1]
            self.up[i] = self.diverse(self.up[2 * i], self.up[2 * i + 1])
            self.down[i] = self.diverse(self.down[2 * i + 1], self.down[2 * i])
        self.sums = sums

    def diverse(self, *parts: list[tuple]) -> list[tuple]:
        """The first 2 * k of the lists, one after the other, with at most k of an item."""
        held: dict[int, int] = {}
        out: list[tuple] = []
        for part in parts:
            for line in part:
                of = held.get(line[3], 0)
                if of < self.k:
                    held[line[3]] = of + 1
                    out.append(line)
                    if len(out) == 2 * self.k:
                        return out
        return out

    def canonical(self, lo: int, hi: int) -> list[int]:
        """The nodes that make up the leaves lo to hi - 1, from left to right."""
        left, right = [], []
        lo, hi = lo + self.size, hi + self.size
        while lo < hi:
            if lo & 1:
                left.append(lo)
                lo += 1
            if hi & 1:
                hi -= 1
                right.append(hi)
            lo, hi = lo >> 1, hi >> 1
        return left + right[::-1]

    def band(self, p: int, reach: int) -> tuple[int, int, int, list[tuple]]:
        """Count, sum of gaps, sum of CRCs, and the diversified nearest lines of the u within ``reach`` of p."""
        lo, mid, hi = np.searchsorted(self.u, [p - reach, p, p + reach + 1]).tolist()
        below, above = self.canonical(lo, mid), self.canonical(mid, hi)
        a, b = self.sums[below].sum(axis=0).tolist(), self.sums[above].sum(axis=0).tolist()
        near = self.diverse(*(self.down[i] for i in reversed(below))) + self.diverse(*(self.up[i] for i in above))
        return a[0] + b[0], p * a[0] - a[1] + b[1] - p * b[0], a[2] + b[2], nearest(near, p, self.k)


def nearest(lines: list[tuple], p: int, k: int) -> list[tuple]:
    """The first 2 * k lines by gap, u, sale_id, line_no, item, with at most k of an item."""
    held: dict[int, int] = {}
    out = []
    for line in sorted(lines, key=lambda x: (abs(x[0] - p), x[0], x[1], x[2] is not None, x[2] or 0, x[3])):
        of = held.get(line[3], 0)
        if of < k:
            held[line[3]] = of + 1
            out.append(line)
    return out[: 2 * k]


def _answers(k: int):
    arrow = to_arrow_schema(ANSWER)

    def run(queries: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("u")
        u, n, crc = (own.column(c).to_numpy() for c in ("u", "n", "crc"))
        first = [[(x, r["sale_id"], r["line_no"], r["item"]) for r in rows] for x, rows in zip(u.tolist(), own.column("first").to_pylist(), strict=True)]
        tree = SegmentTree(u, n, crc, first, k)
        out = []
        for p, reach in zip(queries.column("p").to_pylist(), queries.column("reach").to_pylist(), strict=True):
            count, gaps, crcs, near = tree.band(p, reach)
            if count:
                out.append({"p": p, "n": count, "gaps": gaps, "crc": crcs, "near": [dict(zip(("u", "sale_id", "line_no", "item"), x, strict=True)) for x in near]})
        return pa.Table.from_pylist(out, schema=arrow)

    return run


def near_lines(items: DataFrame, lines: DataFrame, k: int = 5, least: int = 10, per_mille: int = 2) -> DataFrame:
    """For each row of ``items`` (item_id, price) its first ``k`` pairs with ``lines`` (sale_id, line_no, item_id, quantity, amount) by gap, u, sale_id,
    line_no, line_item_id, a row each: item_id, rank (from 1), gap, u, sale_id, line_no, line_item_id, and over all its pairs n_pairs, gap_sum, lines_crc.
    Items without pairs: one row with rank 0."""
    sums, own = leaves(priced_lines(lines), k)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.when(F.col("item_id").isNotNull(), cents(F.col("price"))).alias("p"))
    reach = F.greatest(F.lit(least).cast("long"), floor_div(F.col("p") * per_mille, F.lit(1000).cast("long")))
    queries = asked.where("p is not null").select("p").distinct().withColumn("reach", reach)
    met = F.explode(F.sequence(shard(F.col("p") - F.col("reach")), shard(F.col("p") + F.col("reach"))))
    answers = queries.withColumn("shard", met).groupBy("shard").cogroup(own.withColumn("shard", shard(F.col("u"))).groupBy("shard")).applyInArrow(_answers(k), ANSWER)
    # a band meets three shards at most, so an answer has that many parts; as a table, so that the items of a hot price can be split in their join
    parts = answers.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps"), F.sum("crc").alias("crc"), F.flatten(F.collect_list("near")).alias("near"))
    parts = written(parts, "band-answers")
    x = sums.select(F.col("item").alias("item_id"), "u", F.col("n").alias("m"), F.col("crc").alias("c"))
    keyed = asked.where("p is not null").distinct().withColumn("reach", reach)
    gap = F.abs(F.col("u") - F.col("p"))
    mine = keyed.join(x, "item_id").where(gap <= F.col("reach"))
    mine = mine.groupBy("item_id", "p").agg(F.sum("m").alias("m"), F.sum(gap * F.col("m")).alias("g"), F.sum("c").alias("c"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    both = asked.join(parts, "p", "left").join(mine, ["item_id", "p"], "left")
    others = F.filter("near", lambda l: l["item"] != F.col("item_id"))
    ranked = F.transform(others, lambda l: F.struct(F.abs(l["u"] - F.col("p")).alias("gap"), l["u"].alias("u"), l["sale_id"].alias("sale_id"), l["line_no"].alias("line_no"), l["item"].alias("line_item_id")))
    out = both.select("item_id", (zero("n") - zero("m")).alias("n_pairs"), (zero("gaps") - zero("g")).alias("gap_sum"), (zero("crc") - zero("c")).alias("lines_crc"), F.posexplode_outer(F.slice(F.array_sort(ranked, _by_place), 1, k)).alias("at", "l"))
    return out.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).alias("rank"), "l.gap", "l.u", "l.sale_id", "l.line_no", "l.line_item_id", "n_pairs", "gap_sum", "lines_crc")


def _by_place(a: Column, b: Column) -> Column:
    """Order of two pairs."""
    out = F.lit(0)
    for c in ("line_item_id", "line_no", "sale_id", "u", "gap"):
        x, y = a[c], b[c]
        if c == "line_no":  # null comes first
            x, y = F.coalesce(x, F.lit(-(1 << 62))), F.coalesce(y, F.lit(-(1 << 62)))
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


#: DuckDB SQL for the registered query. The CRC is worked out byte by byte: the texts are ASCII.
ORACLE = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
l AS (
  SELECT sale_id, line_no, item_id, (n - ((n % d) + d) % d) // d AS u, CAST(sale_id AS VARCHAR) || ',' || coalesce(CAST(line_no AS VARCHAR), '') || ',' || CAST(item_id AS VARCHAR) AS s
  FROM (SELECT *, 2 * CAST(floor(100 * amount + 0.5) AS BIGINT) + quantity AS n, 2 * quantity AS d FROM sale_lines
        WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity >= 1 AND isfinite(amount) AND abs(amount) < 1e13)),
texts AS (SELECT s, list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM (SELECT DISTINCT s FROM l)),
crcs AS (SELECT s, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM texts, crc_table),
i AS (SELECT row_number() OVER () AS nth, item_id, CASE WHEN isfinite(price) AND abs(price) < 1e13 THEN CAST(floor(100 * price + 0.5) AS BIGINT) END AS p FROM items),
w AS (SELECT *, p - greatest(10, 2 * p // 1000) AS lo, p + greatest(10, 2 * p // 1000) AS hi FROM i),
pairs AS (SELECT w.nth, w.item_id, abs(l.u - w.p) AS gap, l.u, l.sale_id, l.line_no, l.item_id AS line_item_id, crcs.crc
          FROM w JOIN l ON l.u BETWEEN w.lo AND w.hi AND l.item_id <> w.item_id JOIN crcs USING (s)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM pairs),
sums AS (SELECT nth, count(*) AS n_pairs, sum(gap) AS gap_sum, sum(crc) AS lines_crc FROM pairs GROUP BY nth)
SELECT i.item_id, CAST(coalesce(r.rank, 0) AS INTEGER) AS rank, CAST(r.gap AS BIGINT) AS gap, CAST(r.u AS BIGINT) AS u, r.sale_id, CAST(r.line_no AS BIGINT) AS line_no, r.line_item_id,
  CAST(coalesce(n_pairs, 0) AS BIGINT) AS n_pairs, CAST(coalesce(gap_sum, 0) AS BIGINT) AS gap_sum, CAST(coalesce(lines_crc, 0) AS BIGINT) AS lines_crc
FROM i LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r USING (nth) LEFT JOIN sums USING (nth)
"""
