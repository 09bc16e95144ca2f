"""Mixing sources to target weights: blocks of a fixed number of words, drawn per output shard.

Every source's documents are laid end to end (by bucket, then doc_id) and cut into blocks of ``block`` words.
Targets come from the weights by filling up: no source is asked for more than ``most`` times its size, what it
would get above that goes to the others by weight. Every output shard draws how many of its slots each source gets: the whole part of
the expected count is given, the rest is a multinomial draw over the sources' fractions, so counts are right on average and
stray by a few slots a shard. A source's slots are numbered through all shards; slot j takes the block at place j modulo n
of a pseudorandom permutation of its n blocks (a Feistel network with cycle walking, keyed by the source), so a block comes back
only when all others have been taken. Slots and blocks meet in an equi-join on (source, block).

DataFrame functions only. Prefix sums are two-level, so no task sees a whole source: only one row per (source, bucket) and per
(source, chunk of shards) goes through a window of a source. Slots are made in tasks dealt by source and chunk.

Null texts have size 0; a null source is a source of its own, last in order; sources are matched null-safely.
Documents without words are kept with taken 0. Rows with equal or null doc_id are documents of their own. An empty table
gives no rows. Extra columns are ignored by ``mix`` and kept by ``mixture``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

BLOCK = 64
#: Slots of an output shard, and shards of a chunk.
SLOTS, CHUNK = 4096, 1024
MOST = 3
#: Parts of a source that are laid end to end; fixed, so that the result doesn't depend on the session's settings.
BUCKETS = 4096
#: Rounds of the Feistel network; steps of the cycle walk, of which the first two nearly always do.
FEISTEL, WALK = 4, 24


ROW = ("n", "bucket", "k")


def word_count(text: str = "text") -> Column:
    """Number of words, without an array of them: places where a word begins."""
    squeezed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\f\r", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, weight, target for a table with one row per source (source, source_size).

    With sources in order of most * size / weight the level is closed-form: the first source whose cap lies over
    the level that the rest would get sets it for all that follow.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(rank)).withColumn("weight", w.cast("double"))
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(cap / F.col("weight"), "n")
    before, rest, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("cap", cap).withColumn("level", level)
    found = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("level")))).over(all_)
    target = F.least("cap", F.coalesce(found["level"] * F.col("weight"), F.col("cap")))
    return filled.withColumn("target", target).select("source", "source_size", "n", "weight", "target")


def _fraction(*of: Column | int) -> Column:
    """A number from 0 to 1 (exclusive) that hangs on the values alone."""
    return F.pmod(F.xxhash64(*(x if isinstance(x, Column) else F.lit(x) for x in of)), F.lit(1 << 52)) / float(1 << 52)


def _network(x: Column, wide: Column, high: Column, key: Column, seed: int) -> Column:
    """A bijection of 0 .. wide * high - 1: a Feistel network over x % wide and x / wide."""
    left, right = F.pmod(x, wide), F.floor(x / wide)
    for r in range(FEISTEL):
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(seed * 31 + r)), wide), wide)
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(seed * 31 + r)), high), high)
    return right * wide + left


def _permuted(rows: DataFrame, place: str, blocks: str, key: str, out: str, seed: int) -> DataFrame:
    """Adds ``out``: where a permutation of 0 .. blocks - 1, keyed by ``key``, sends ``place``.

    The network's domain is the least rectangle with ``blocks`` cells, so fewer than sqrt(blocks) lie outside. From those the walk goes on:
    at most as many steps as lie outside, so all of them for fewer than WALK ** 2 blocks; with more, WALK steps outside
    one after the other are as likely as blocks ** (-WALK / 2), under 1e-33.
    """
    n = F.col(blocks)
    wide = F.ceil(F.sqrt(n.cast("double")))
    rows = rows.withColumn("__wide", wide).withColumn("__high", F.ceil(n / F.col("__wide")))
    step = lambda x: _network(x, F.col("__wide"), F.col("__high"), F.col(key), seed)
    rows = rows.withColumn("__once", step(F.col(place)))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("__once"), lambda x, _: F.when(x >= n, step(x)).otherwise(x))
    return rows.withColumn(out, F.when(F.col("__once") < n, F.col("__once")).otherwise(walked)).drop("__wide", "__high", "__once")


def draw(per: DataFrame, slots: int = SLOTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """n, block of every slot of the mix. ``per``: n, blocks, wanted (expected slots), one row per source.

    A source gets the whole part of its expected count in every shard. What is left of the shard are some slots (rounded at
    random, so that their number is right on average); each falls to a source with the probability of its fraction. Every row of
    (source, shard) reads its own share of these throws, so nothing is dealt by shard. Slots beyond ``most`` times the blocks are left out.
    """
    order, all_ = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    per = per.where(F.col("blocks") > 0).withColumn("shards", F.greatest(F.ceil(F.sum("wanted").over(all_) / slots), F.lit(1)).cast("long"))
    per = per.withColumn("base", F.floor(F.col("wanted") / F.col("shards"))).withColumn("part", F.col("wanted") / F.col("shards") - F.col("base"))
    per = per.withColumn("hi", F.sum("part").over(order)).withColumn("parts", F.sum("part").over(all_))
    per = per.select("n", "blocks", "shards", "base", (F.col("hi") - F.col("part")).alias("lo"), "hi", "parts")
    chunks = per.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shards") - 1) / CHUNK))))
    # two-level prefix sums, and slots are made where their chunk is
    chunks = chunks.repartition("n", "chunk")
    first, last = F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + CHUNK, F.col("shards")) - 1
    rows = chunks.withColumn("shard", F.explode(F.sequence(first, last)))
    thrown = F.floor(F.col("parts") + _fraction(F.col("shard"), seed)).cast("int")
    throws = F.transform(F.sequence(F.lit(1), thrown), lambda i: _fraction(F.col("shard"), i, seed + 1) * F.col("parts"))
    mine = F.size(F.filter(throws, lambda x: (x >= F.col("lo")) & (x < F.col("hi"))))
    rows = rows.withColumn("count", (F.col("base") + F.when(thrown > 0, mine).otherwise(0)).cast("long"))
    upto = Window.partitionBy("n").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("n", "chunk").agg(F.sum("count").alias("held")).select("n", "chunk", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("n", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(before.hint("merge"), ["n", "chunk"]).where(F.col("count") > 0)
    at = F.col("before") + F.col("first")
    each = rows.select("n", "blocks", F.explode(F.sequence(at, at + F.col("count") - 1)).alias("slot")).where(F.col("slot") < F.col("blocks") * most)
    placed = _permuted(each.withColumn("place", F.col("slot") % F.col("blocks")), "place", "blocks", "n", "block", seed)
    return placed.select("n", "block")


def plan(docs: DataFrame, seed: int = 7, block: int = BLOCK, slots: int = SLOTS, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): documents with their row number and place; pieces of them that the mix takes.

    documents: ROW, doc_id, source, size, source_size, target. pieces: ROW, lo, hi (words [lo, hi) of the
    document) and times (how often the mix takes them). ROW (source number, bucket, place in the bucket) is
    unique even where doc_id is not.
    """
    sized = docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    named = F.when(F.col("doc_id").isNull(), F.xxhash64("tie", F.lit(seed + 1))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    sized = sized.withColumn("bucket", F.pmod(named, F.lit(BUCKETS)))
    sized = written(sized, "mix-sizes")
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("rows"))
    sizes = by_bucket.groupBy("source").agg(F.sum("held").alias("source_size"))
    per = targets(sizes, weights, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    per = per.withColumn("blocks", blocks)
    #: slots that would give the target, were all blocks as long as the source's mean block
    wanted = F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    per = written(per.withColumn("wanted", wanted), "mix-sources")
    start = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_bucket.withColumn("base", F.coalesce(F.sum("held").over(start), F.lit(0)))
    begins = begins.alias("b").join(per.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    begins = begins.select("p.n", "p.source_size", "p.target", F.col("b.source").alias("source"), "b.bucket", "b.base")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = sized.withColumn("until", F.sum("size").over(inside)).withColumn("k", F.row_number().over(inside))
    s, b = laid.alias("s"), begins.alias("b")
    laid = s.join(b.hint("merge"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.bucket") == F.col("b.bucket")))
    laid = laid.select(
        "b.n", "s.bucket", "s.k", "s.doc_id", "s.source", "s.tie", "s.size", "b.source_size", "b.target",
        (F.col("b.base") + F.col("s.until") - F.col("s.size")).alias("at"),
    )
    placed = written(laid, "mix-places")

    taken = draw(per.select("n", "blocks", "wanted"), slots, most, seed).groupBy("n", "block").agg(F.count(F.lit(1)).alias("times"))

    cut = placed.where(F.col("size") > 0).select(
        *ROW, "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"),
    )
    lo = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    hi = F.least(F.col("block") * block + block - F.col("at"), F.col("size"))
    pieces = cut.select(*ROW, "block", lo.alias("lo"), hi.alias("hi")).join(taken.hint("merge"), ["n", "block"]).select(*ROW, "lo", "hi", "times")
    return placed.drop("at"), pieces


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK, weights: tuple[int, ...] = (1, 2, 3), text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    placed, pieces = plan(docs, seed, block, weights=weights, text=text)
    taken = pieces.groupBy(*ROW).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    out = placed.join(taken.hint("merge"), list(ROW), "left")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, seed: int = 7, block: int = BLOCK, weights: tuple[int, ...] = (1, 2, 3), text: str = "text") -> DataFrame:
    """``docs`` as mixed: a row for each pass over a document that takes words of it, ``text`` holding the words taken.

    A pass that takes all words keeps the text as it is; otherwise the words are joined by one space. The rows of a source are
    as many words as its mix takes. Documents without words are taken by no pass.
    """
    placed, pieces = plan(docs, seed, block, weights=weights, text=text)
    each = pieces.select(*ROW, "lo", "hi", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("pass"))
    spans = each.groupBy(*ROW, "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("words"))
    tie, again, id_, source, words = unused(docs.columns, "tie", "again", "id", "from", "words")
    keys = F.col("doc_id"), F.col("source"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumns({id_: keys[0], source: keys[1], tie: keys[2]})
    keyed = keyed.withColumn(again, F.row_number().over(Window.partitionBy(id_, source, tie).orderBy(F.lit(0))))
    order = Window.partitionBy("doc_id", "source", "tie").orderBy("bucket", "k")
    taken = placed.withColumn("again", F.row_number().over(order)).join(spans.hint("merge"), list(ROW))
    taken = taken.select("doc_id", "source", "tie", "again", "size", "spans", "words")
    d, t = keyed.alias("d"), taken.alias("t")
    pairs = ((id_, "doc_id"), (source, "source"), (tie, "tie"), (again, "again"))
    same = F.lit(True)
    for mine, theirs in pairs:
        same = same & F.col(f"d.{mine}").eqNullSafe(F.col(f"t.{theirs}"))
    whole = F.col("t.words") == F.col("t.size")
    split = F.array_remove(F.split(F.col(f"d.`{text}`"), r"[\x20\x09-\x0D]+"), "")
    # a generator, so that the words are split once a row and not once a span
    rows = d.join(t.hint("merge"), same).select(*(F.col(f"d.`{c}`") for c in docs.columns), whole.alias(tie), F.col("t.spans").alias(again), F.explode(F.array(F.when(~whole, split))).alias(words))
    cut = F.flatten(F.transform(again, lambda s: F.slice(words, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))))
    made = F.when(F.col(tie), F.col(f"`{text}`")).otherwise(F.array_join(cut, " "))
    return rows.select(*(made.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))
