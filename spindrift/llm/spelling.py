"""Spelling variants: words that differ by one code point, and the frequent form that each stands for.

Words are counted natively. For words a code point apart, at least one half of either is whole in the other: the first half as its prefix or
the second as its suffix. So every word is cut into two segments, and each segment goes to the shard of its hash, which builds an Aho-Corasick
automaton over its segments. A word is scanned in the shards that can hold a segment of a near word (prefixes and suffixes of four lengths at
most). A match counts if it stands at the word's begin or end, as its segment did, and if the lengths of the words differ by one at most. The
distance is verified without comparing all words of a segment: what follows (or precedes) the half is one code point away if both agree after one
is taken out at the same place (replaced), or if one without a code point is the other (inserted, deleted). Those are look-ups, so a
segment that many words share costs what it yields. No pair leaves a shard: a word's partial counts and its best near word do.

A segment of more than ``HOT`` words is dealt to several shards, and the words to be scanned go to all of them.

Defined cases: texts that are null, empty or without such runs have no words. A null doc_id counts as empty in the hash. Repeated rows count as often as
they are there. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, DELETE_EVERY, TIMES = 7, 2, 31, 10
#: Entries of a shard, give or take the hash; words of one segment from which it is dealt to several.
SHARD, HOT = 20_000, 50_000

FOUND = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_near", T.LongType()), T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType())])


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """word and n: runs of letters, only A-Z lower-cased; where ``delete_every`` divides the CRC of ``<doc_id>:<run>`` the code point at CRC % length
    goes. Words of ``least_chars`` and ``least_count`` occurrences. Counted in part before the shuffle."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("r"))
    ascii = F.octet_length("r") == F.length("r")  # then lower() takes A-Z alone, and is quick
    runs = runs.select("d", F.when(ascii, F.lower("r")).otherwise(F.translate("r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("r"))
    runs = runs.select("r", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("r")).cast("int")
    cut = F.concat(F.substring("r", 1, at), F.substring("r", at + 2, F.length("r")))
    made = runs.select(F.when(F.col("h") % delete_every == 0, cut).otherwise(F.col("r")).alias("word"))
    return made.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _entries(counted: DataFrame) -> DataFrame:
    """Rows of a word as holder of its two halves, and as text at the prefixes and suffixes that a near word's half can be.

    key: the half's text; side: it is the first half. The text's rows are those of words one shorter, as long and one longer.
    """
    n = F.length("word")
    half = lambda size: F.floor(size / 2).cast("int")
    first = lambda size: F.substring("word", 1, half(size))
    second = lambda size: F.substring("word", n - (size - half(size)) + 1, size - half(size))
    row = lambda key, side, holder: F.struct(key.alias("key"), F.lit(side).alias("side"), holder.alias("holder"))
    own = [row(first(n), True, F.lit(True)), row(second(n), False, F.lit(True))]
    # of the sizes n - 1, n, n + 1 two neighbours always share a half's length; the holder's row serves as text as well
    other = [row(F.when(half(n - 1) == half(n), first(n + 1)).otherwise(first(n - 1)), True, F.lit(False)), row(F.when(half(n) == half(n + 1), second(n + 1)).otherwise(second(n - 1)), False, F.lit(False))]
    return counted.select("word", "n", F.inline(F.array(*own, *other)))


def _dealt(entries: DataFrame, shards: int, hot: int) -> DataFrame:
    """The entries with their shard: by the key's hash; the holders of a key of over ``hot`` words by their own hash to as many shards as it takes, its texts to all of those."""
    often = entries.where("holder").groupBy("key", "side").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > hot).select("key", "side", F.ceil(F.col("held") / hot).cast("int").alias("of"))
    each = entries.join(often, ["key", "side"], "left").withColumn("of", F.coalesce("of", F.lit(1)))
    mine = F.pmod(F.xxhash64("word"), F.col("of")).cast("int")
    each = each.select("key", "side", "word", "n", F.col("holder").alias("whole"), mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part"))
    rows = each.select("key", "side", (F.col("whole") & (F.col("mine") == F.col("part"))).alias("holder"), "word", "n", F.pmod(F.xxhash64("key", "side", "part"), F.lit(shards)).alias("shard"), "part")
    return rows


def _outs(rest: str) -> list[str]:
    """The distinct texts that ``rest`` is without one code point."""
    return [rest[:i] + rest[i + 1 :] for i in range(len(rest)) if not i or rest[i] != rest[i - 1]]


class _Segment:
    """The words that hold one segment, by what they have beside it."""

    def __init__(self) -> None:
        self.whole: dict[str, tuple[str, int]] = {}
        self.shorter: dict[str, list[tuple[str, int]]] = defaultdict(list)  # without one code point: the words it comes from
        self.holes: dict[tuple[int, str], list[tuple[str, int]]] = defaultdict(list)

    def add(self, rest: str, word: str, n: int) -> None:
        self.whole[rest] = (word, n)
        for out in _outs(rest):
            self.shorter[out].append((word, n))
        for i in range(len(rest)):
            self.holes[i, rest[:i] + rest[i + 1 :]].append((word, n))

    def near(self, rest: str) -> list[tuple[str, int]]:
        """The words whose rest is one code point away from ``rest``; each once."""
        found = [x for i in range(len(rest)) for x in self.holes.get((i, rest[:i] + rest[i + 1 :]), ())]
        own = self.whole.get(rest)
        if own is not None and len(rest):
            found = [x for x in found if x[0] != own[0]]
        found += [self.whole[out] for out in _outs(rest) if out in self.whole]
        return found + self.shorter.get(rest, [])


def _scan(table: pa.Table) -> pa.Table:
    keys, sides, parts, holders, texts, counts = (table.column(c).to_pylist() for c in ("key", "side", "part", "holder", "word", "n"))
    held: dict[tuple[str, bool, int], _Segment] = {}
    automaton = ahocorasick.Automaton()
    for key, side, part, holder, word, n in zip(keys, sides, parts, holders, texts, counts, strict=True):
        if holder:
            segment = held.get((key, side, part))
            if segment is None:
                segment = held[key, side, part] = _Segment()
                automaton.add_word(key, (*automaton.get(key, ()), (side, segment, len(key))))
            segment.add(word[len(key) :] if side else word[: -len(key)], word, n)
    if held:
        automaton.make_automaton()
    out: dict[str, list] = {}
    for word, n in dict(zip(texts, counts, strict=True)).items():
        size, near, best = len(word), 0, (0, "")
        for end, segments in automaton.iter(word) if held else ():
            for side, segment, length in segments:
                if end + 1 != length if side else end + 1 != size:
                    continue  # not where the segment stands in its own words
                for other, m in segment.near(word[length:] if side else word[: size - length]):
                    # the second half speaks only where the first isn't whole as well
                    if abs(len(other) - size) <= 1 and (side or not word.startswith(other[: len(other) // 2])):
                        near += 1
                        if m > best[0] or m == best[0] and other < best[1]:
                            best = (m, other)
        out[word] = [n, near, best[0], best[1] or None]
    del held, automaton
    give_back()
    columns = list(zip(*out.values(), strict=True)) if out else [[]] * 4
    return pa.table([pa.array(list(out), pa.string()), *(pa.array(c, f.type) for c, f in zip(columns, list(to_arrow_schema(FOUND))[1:], strict=True))], schema=to_arrow_schema(FOUND))


def near_words(counted: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """word, n, n_near, best (the near word of largest n, ties to the smallest), best_n of every row of ``counted`` (word, n; each word once)."""
    entries = _entries(counted)
    shards = max(1, math.ceil(4 * counted.count() / shard))
    found = _dealt(entries, shards, hot).groupBy("shard").applyInArrow(_scan, FOUND)
    best = F.min_by(F.struct("best_n", "best"), F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b")))
    each = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("x"))
    return each.select("word", "n", "n_near", F.col("x.best").alias("best"), F.col("x.best_n").alias("best_n"))


def roots(links: DataFrame, hops: int) -> DataFrame:
    """word and root of ``links`` (word, form; no cycles): the last form that forms lead to, by doubling, for chains of at most ``hops``."""
    at = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, hops - 1).bit_length()):
        then = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return at


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text). form: the near word of largest n (ties: the smallest in code-point order), if
    that n is at least ``times`` the word's; root: where forms lead to in the end, the word itself if it has none."""
    counted = written(words(docs), "spelling-words")
    near = near_words(counted)
    is_form = F.col("best_n") >= times * F.col("n")
    out = written(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-near")
    most = out.agg(F.max("n")).first()[0] or 1
    last = roots(out.where("form is not null").select("word", "form"), int(math.log(most, times)) + 1 if times > 1 else 63)
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL for the registered query. The CRC is worked out byte by byte; all code points are below U+0100 here.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
counted AS (SELECT d, r, count(*) AS times FROM runs GROUP BY 1, 2),
bytes AS (SELECT *, flatten(list_transform(string_split(d || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS b FROM counted),
hashed AS (SELECT r, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc_table),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, times FROM hashed),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
o AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT DISTINCT * FROM (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM o a JOIN o b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM o a JOIN w b ON a.rest = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM o a JOIN w b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM pairs GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next),
last AS (SELECT word, here AS root FROM walk WHERE next IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN last USING (word)
"""
