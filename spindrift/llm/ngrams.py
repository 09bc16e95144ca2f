"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and their connected components.

1. Every text becomes its set of n-gram hashes; texts with equal sets collapse to the smallest doc_id.
2. A screen keeps the documents that can link at all: of the first n - ceil(t n) + k n-grams by hash, two linked
   documents share k (5 % of the smaller set) or more.
3. Among the kept representatives n-grams are counted; those of a single document take up the first places of its order and
   never meet. The rest is ordered rare first; documents meet on n-grams of their prefixes, if their lengths fit and the
   positions leave room for the overlap.
4. First every document is compared only with the most central document of each of its groups (the one with the fewest n-grams of its
   own), so large groups of near copies become one component with a comparison or two a document. Then all remaining candidates,
   those between different components that weren't compared yet, meet once each, by n-gram and class of lengths. A suffix filter (n-grams left and right by class of hash) drops pairs whose
   sets must differ too much, before sets travel; the rest is verified on the whole sets.

Links inside a component that are not needed to find it are not listed. Null and empty texts and texts
without words have no n-grams and link with nothing. Rows with null doc_id, and all but one of the rows that repeat a doc_id, link with
nothing: their component is their doc_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import mix, released, written
from .graph import components
from .shared import Entries, buckets_for, pieces, repeated_places, unique_documents, word_hashes

N, PERCENT = 5, 80
#: Classes of hashes that the suffix filter counts.
CLASSES = 64


def sets_of(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(doc_ids, sorted distinct n-gram hashes of each) for batches of doc_id, text (bytes)."""
    for rows, raw, offsets in pieces(batches, 1):
        words, first = word_hashes(raw, offsets, lower=True)
        total = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            total = mix(total + words[j : j + len(total)])
        sets = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= n:
                sets.append(np.unique(total[lo : hi - n + 1]))
            elif hi > lo:
                x = np.full(1, hi - lo, np.uint64)
                for w in words[lo:hi]:
                    x = mix(x + w)
                sets.append(x)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield rows.column(0).to_numpy(zero_copy_only=False), sets


def _least(n: int | Column, percent: int) -> int | Column:
    """ceil(percent * n / 100)."""
    return F.floor((n * percent + 99) / 100) if isinstance(n, Column) else -(-n * percent // 100)


def sizes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n (size of the set), s1, s2 (a 128-bit digest of it)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n", "s1", "s2")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in sets_of(batches, n):
            s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            s2 = np.array([np.bitwise_xor.reduce(mix(~s), initial=0) for s in sets], np.uint64).view(np.int64)
            columns = [ids.astype(np.int64), np.array([len(s) for s in sets], np.int64), s1, s2]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=to_arrow_schema(schema))

    return docs.mapInArrow(released(run), schema)


def _screen(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id and ``shared``: how many of a document's first n-grams by hash stand in other documents too."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[Entries]:
        for ids, sets in sets_of(batches, n):
            heads = [s[: len(s) - _least(len(s), percent) + max(1, len(s) // 20)] for s in sets]
            count = np.array([len(h) for h in heads])
            yield np.concatenate(heads), np.repeat(ids.astype(np.int64), count), np.zeros(count.sum(), np.int64)

    buckets = buckets_for(docs, 6 / (1.05 - percent / 100))
    return repeated_places(docs, keys, buckets).groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


def _tokens(docs: DataFrame, n: int) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in sets_of(batches, n):
            columns = [np.repeat(ids.astype(np.int64), [len(s) for s in sets]), np.concatenate(sets).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=to_arrow_schema(schema))

    return docs.mapInArrow(released(run), schema)


SETS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("own", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())),
     T.StructField("classes", T.ArrayType(T.ShortType())), T.StructField("set", T.BinaryType())]
)


def _ordered(shared: DataFrame, percent: int) -> DataFrame:
    """SETS rows of documents that have room in their prefix after the n-grams that only they have (``own``).

    ``set``: sorted hashes of the n-grams that other documents have too; the others matter to no intersection.
    """
    grouped = shared.groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "h")).alias("s"))
    grouped = grouped.where(F.size("s") >= _least(F.col("n"), percent)).select("doc_id", "n", F.col("s.df").alias("df"), F.col("s.h").alias("h"))
    schema = to_arrow_schema(SETS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], []]
            own = []
            for size, df, h in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                df, h = df.values.to_numpy(), h.values.to_numpy()
                own.append(size - len(h))
                order = np.lexsort((h, df))[: max(0, size - _least(size, percent) + 1 - own[-1])]
                rows[0].append(h[order])
                rows[1].append(np.minimum(np.bincount(h & (CLASSES - 1), minlength=CLASSES), 32767).astype(np.int16))
                rows[2].append(np.sort(h).tobytes())
            columns = [b.column(0), b.column(1), pa.array(own, pa.int64()), pa.array(rows[0], pa.list_(pa.int64())), pa.array(rows[1], pa.list_(pa.int16())), pa.array(rows[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return grouped.mapInArrow(run, SETS)


def _overlap(n1: Column, n2: Column, percent: int) -> Column:
    """The least intersection of two linked sets: ceil(percent * (n1 + n2) / (100 + percent))."""
    return F.floor(((n1 + n2) * percent + 99 + percent) / (100 + percent))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filter for prefix rows a, b: n, at (position in the order), own, classes."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n1, n2 = c(a, "n"), c(b, "n")
    need = _overlap(n1, n2, percent)
    length = (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)
    positions = F.least(n1 - c(a, "at"), n2 - c(b, "at")) >= need
    apart = F.aggregate(F.zip_with(c(a, "classes"), c(b, "classes"), lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    return length & positions & (apart + c(a, "own") + c(b, "own") <= n1 + n2 - 2 * need)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y of the pairs that link."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("set").alias(f"set_{c}"))
    full = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "n_x", "n_y", "set_x", "set_y")
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = b.column(2).to_numpy() + b.column(3).to_numpy()
            common = np.array(
                [len(np.intersect1d(np.frombuffer(p.as_py(), np.int64), np.frombuffer(q.as_py(), np.int64), assume_unique=True)) for p, q in zip(b.column(4), b.column(5), strict=True)], np.int64
            )
            ok = pa.array(100 * common >= percent * (both - common))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], schema=to_arrow_schema(schema))

    return full.mapInArrow(run, schema)


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links) for unique documents (doc_id, text bytes). members: doc_id, n_shingles, rep (smallest doc_id with the
    same set). links: x, y, verified links between representatives, enough for all components.
    """
    meta = written(sizes(docs, n), "ngram-sizes")
    # as a table, so that the join is one of two plain shuffles, of which large groups of equal sets can be split
    reps = written(meta.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "ngram-reps")
    members = meta.join(reps, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    members = written(members, "ngram-members")
    k = F.greatest(F.lit(1), F.floor(_least(F.col("n_shingles"), percent) / 20))
    kept = members.where((F.col("doc_id") == F.col("rep")) & (F.col("n_shingles") > 0)).join(_screen(docs, n, percent), "doc_id").where(F.col("shared") >= k)
    kept = written(kept.select("doc_id", F.col("n_shingles").alias("n")), "ngram-kept")
    tokens = written(_tokens(docs.join(kept.select("doc_id"), "doc_id", "left_semi"), n), "ngram-tokens")
    df = written(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "ngram-counts")
    shared = tokens.join(df, "h").join(kept, "doc_id")
    sets = written(_ordered(shared, percent), "ngram-sets")
    prefix = sets.select("doc_id", "n", "own", "classes", F.posexplode("prefix").alias("i", "token"))
    prefix = prefix.select("doc_id", "n", "own", "classes", "token", (F.col("own") + F.col("i")).alias("at"))

    hubs = prefix.groupBy("token").agg(F.min(F.struct("own", "doc_id")).alias("hub"), F.count(F.lit(1)).alias("docs")).where("docs > 1").select("token", "hub.doc_id")
    hubs = hubs.join(prefix, ["token", "doc_id"])
    a, b = hubs.alias("a"), prefix.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.doc_id") != F.col("b.doc_id")) & _may_link("a", "b", percent))
    tried = written(pairs.select(F.least("a.doc_id", "b.doc_id").alias("x"), F.greatest("a.doc_id", "b.doc_id").alias("y")).distinct(), "ngram-pairs")
    first = written(_verified(tried, sets, percent), "ngram-links")
    label = components(first)
    known = prefix.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    known = written(known, "ngram-prefixes")
    mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rest = written(known.join(mixed, "token", "left_semi"), "ngram-rest")
    # the shorter of two linked sets is in the other's class of lengths or in the one below
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    a = rest.withColumn("length", F.explode(F.array(length, length + 1))).alias("a")
    b = rest.withColumn("length", length).alias("b")
    shorter = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.length") == F.col("b.length")) & shorter & (F.col("a.component") != F.col("b.component"))
    pairs = a.join(b, meet & _may_link("a", "b", percent)).select(F.least("a.doc_id", "b.doc_id").alias("x"), F.greatest("a.doc_id", "b.doc_id").alias("y")).distinct()
    second = written(_verified(pairs.join(tried, ["x", "y"], "left_anti"), sets, percent), "ngram-links")
    return members, first.union(second)


def groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of ``docs`` (doc_id, text)."""
    main, rest = unique_documents(docs)
    members, links = join(main, n, percent)
    label = components(links).select(F.col("node").alias("rep"), "component")
    out = members.join(label, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    if rest is None:
        return out
    numbered = rest.withColumn("none", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    parts = [numbered.where(F.col("none") == x).select("doc_id", "text") for x in (False, True)]
    given = sizes(parts[0], n).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    null = F.lit(None).cast("long")
    return out.union(given).union(sizes(parts[1], n).select(null, F.col("n"), null))


#: DuckDB SQL for ``groups`` of four words at 85 %.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM w) WHERE i + 3 <= n OR (n < 4 AND i = 1)),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""
