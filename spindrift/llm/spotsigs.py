"""Document fingerprints by spot signatures, with DataFrame functions only.

A text's words are its lower-cased runs of letters and digits. Every common word (an anchor) starts a chain of the
next ``chain`` content words (words that are no anchors); the 32-bit hashes of anchor and chain are the text's set of
spot signatures, and the sorted set in hexadecimal digits is its fingerprint. A text with words but no
anchor starts a chain at each of its words. A text without words has the empty fingerprint; two empty sets are alike (1).

``near_duplicates`` compares all documents: equal sets collapse to a representative first, sets are dealt to
partitions by length so that only neighbouring lengths meet, candidates share one of the rarest
signatures of both, and what length alone rules out is never intersected.

Null texts count as empty. ``with_next`` defines the order for tied and null doc_ids (null last, ties by text). Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

#: Anchors: very common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it not of on or that the this to was were which with you "
    "als auf aus bei das dem den der des die ein eine er es für im ist mit nach nicht sich sie und von wie zu zum "
    "au avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "al como con del el los las lo más no o para pero por su sus una y"
).split()
CHAIN = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds ``out``: the sorted distinct 32-bit signatures of ``text``."""
    w, c, a = (f"{out}_{x}" for x in ("words", "content", "anchors"))
    anchor = lambda x: x.isin(*sorted(set(ANCHORS)))
    at = F.filter(F.transform(w, lambda x, i: F.when(anchor(x), i)), lambda i: i.isNotNull())
    df = df.withColumn(w, words(F.col(text))).withColumn(a, at)
    df = df.withColumn(c, F.when(F.size(a) > 0, F.filter(w, lambda x: ~anchor(x))).otherwise(F.col(w)))
    # the k-th anchor, at word p, has p - k content words before it; without anchors every word starts a chain
    start = F.when(F.size(a) > 0, F.col(a)).otherwise(F.transform(w, lambda x, i: i))
    skip = F.when(F.size(a) > 0, F.lit(0)).otherwise(F.lit(1))
    df = df.withColumn(f"{out}_skip", skip).withColumn(a, start)  # skip looks at the anchors, not at the starts
    before = F.when(F.col(f"{out}_skip") == 0, F.lit(1)).otherwise(F.lit(0))
    sig = F.transform(a, lambda p, k: F.hash(F.get(w, p), *(F.get(F.col(c), p - k * before + F.col(f"{out}_skip") + j) for j in range(chain))))
    return df.withColumn(out, F.array_sort(F.array_distinct(sig))).drop(w, c, a, f"{out}_skip")


def fingerprint(signatures: Column) -> Column:
    """The set as a string: eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets, 0 to 1; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def with_next(docs: DataFrame, carried: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``next_<c>`` of each carried column: its value in the next document, descending doc_id, the first after the last.

    Rows with null doc_id come last; ties go by text. Ids are cut into ranges at quantiles of theirs; the first row of each range
    is dealt to the range above as well, where it only ends the order, so no task needs more than its range.
    """
    spark = docs.sparkSession
    ranges = ranges or min(16384, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / ranges for i in range(1, ranges)]
    quantiles, top = docs.agg(F.percentile_approx("doc_id", cuts or [0.5], max(2000, 4 * ranges)), F.max("doc_id")).first()
    splits = sorted(set(quantiles or []) - {top}) if cuts else []
    step = max(1, round(len(splits) ** 0.5))
    coarse = F.array(*map(F.lit, splits[::step])).cast("array<bigint>") if splits else None
    fine = F.array(*(F.array(*map(F.lit, splits[i : i + step])).cast("array<bigint>") for i in range(0, len(splits), step))) if splits else None
    if splits:  # how many splits lie under the id: the coarse ones first, then those after the last coarse one
        over = F.size(F.filter(coarse, lambda s: s < F.col("doc_id")))
        own = F.when(over == 0, F.lit(0)).otherwise((over - 1) * step + F.size(F.filter(F.get(fine, over - 1), lambda s: s < F.col("doc_id"))))
        head = F.array_contains(F.get(fine, F.greatest(F.size(F.filter(coarse, lambda s: s <= F.col("doc_id"))) - 1, F.lit(0))), F.col("doc_id"))
    else:
        own, head = F.lit(0), F.lit(False)
    own = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(own)
    own_, head_, copy, range_, ghost = unused([*docs.columns, *(f"next_{c}" for c in carried)], "own", "head", "copy", "range", "ghost")
    dealt = docs.withColumn(own_, own.cast("int")).withColumn(head_, F.coalesce(head, F.lit(False)))
    copies = F.array(
        F.struct(F.col(own_).alias(range_), F.lit(0).alias(ghost)),
        F.when(F.col(head_), F.struct((F.col(own_) + 1).alias(range_), F.lit(1).alias(ghost))),
        F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("bigint")), F.struct(F.lit(0).alias(range_), F.lit(2).alias(ghost))),
    )
    dealt = dealt.withColumn(copy, F.explode(F.filter(copies, lambda x: x.isNotNull())))
    dealt = dealt.select(*docs.columns, f"{copy}.{range_}", f"{copy}.{ghost}")
    order = Window.partitionBy(range_).orderBy(F.col(ghost) == 2, F.col("doc_id").desc_nulls_last(), F.col("text"))
    follow = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return follow.where(F.col(ghost) == 0).drop(range_, ghost)


def edited_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(with_signatures(d, "text", "sigs"), ["text", "sigs"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut)))
    d = with_signatures(d.drop("next_text"), "edited", "edited_sigs")
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has doc_id and rep (smallest doc_id with an equal set); pairs has left < right
    representatives and their likeness, at least ``threshold``. Empty sets and null doc_ids take no part.
    """
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs").where((F.size("sigs") > 0) & F.col("doc_id").isNotNull())
    sets = written(sets.select("doc_id", "sigs", F.sha2(fingerprint(F.col("sigs")), 256).alias("fp")), "spots")
    reps = sets.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    members = sets.select("doc_id", "fp").join(reps, "fp").select("doc_id", "rep")
    unique = sets.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    unique = written(unique.select("doc_id", "sigs", F.size("sigs").alias("n")), "spot-sets")
    spread = unique.select("doc_id", "n", F.explode("sigs").alias("sig"))
    common = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    shared = spread.join(common, "sig").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    # signatures of one document only come first in the order and meet nobody, so they only use up places
    prefix = shared.withColumn("room", (keep - (F.col("n") - F.size("s"))).cast("int")).where("room > 0")
    prefix = prefix.select("doc_id", "n", F.explode(F.slice("s", 1, F.col("room"))).alias("p")).select("doc_id", "n", "p.sig")
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    left = prefix.withColumn("part", length)
    right = left.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = left.alias("a"), right.alias("b")
    meet = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.doc_id") != F.col("b.doc_id"))
    size_fits = (F.col("b.n") >= F.col("a.n") * threshold) & ((F.col("b.n") < F.col("a.n")) | (F.col("b.n") == F.col("a.n")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    found = a.join(b, meet & size_fits).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()
    full = unique.select("doc_id", "sigs")
    pairs = found.join(full.toDF("x", "x_sigs"), "x").join(full.toDF("y", "y_sigs"), "y")
    pairs = pairs.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), likeness(F.col("x_sigs"), F.col("y_sigs")).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= threshold)
