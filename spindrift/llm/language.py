"""Language identification by compression.

One raw-content zstandard dictionary per language is cut from a bounded sample of labelled rows, whose whole texts
compete for its bytes in pieces. A text is
compressed with each of them; the language whose dictionary gives the smallest frame wins. When the runner-up
is closer than ``min_margin`` (a share of its size), the answer is marked as not reliable.

Null texts and texts without a letter give ``und`` with score 0. Rows without language teach nothing. Without any
labelled row every text is ``und``. Repeated rows are answered one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, map_arrow, mix, released, text_bytes

#: Labelled rows of each language that are sampled, and code points of the pieces that their texts are cut into.
SAMPLE_ROWS, PIECE_CHARS = 300, 100
#: Bytes of a dictionary.
DICTIONARY_BYTES = 24 << 10
#: Lower levels skip short matches, and lose three points of accuracy.
LEVEL = 6


def plain(text: str) -> bytes:
    """Lower-cased words with one space between them: what is compressed, of samples and of texts."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace")


def pieces(text: str, h: int, chars: int, most: int) -> list[str]:
    """A whole text in pieces of whole words, ``chars`` code points at most, in an order by hash; as many as fill ``most`` bytes."""
    cut = [p for x in re.findall(rf".{{1,{chars}}}(?: |$)|.{{{chars}}}", plain(text).decode("utf-8")) if (p := x.strip())]
    with np.errstate(over="ignore"):
        order = np.argsort(mix(np.uint64(h & (1 << 64) - 1) + np.arange(len(cut), dtype=np.uint64)), kind="stable")
    out, size = [], 0
    for i in order:
        if size >= most:
            break
        out.append(cut[i])
        size += len(cut[i].encode()) + 1
    return out


def learn(labelled: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``labelled`` (text, lang).

    At most ``rows`` rows of a language are taken, those with the smallest hashes of their key, so the sample is
    the same whatever the partitions. Their whole texts are cut into pieces, which fill the dictionary in turns: one of
    each row, then the next of each, at places chosen by hash, and no piece twice. The driver gets ``DICTIONARY_BYTES``
    and a piece of each language at most.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    have = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not have:
        return {}
    # a share by hash that holds more than enough rows of each language, so the ranks below see few
    share = F.create_map(*(F.lit(x) for lang, n in have.items() for x in (lang, min(1.0, (4 * rows + 100) / n))))
    some = known.select("lang", F.xxhash64(F.col(key).cast("string"), F.length("text")).alias("h"), F.xxhash64("text").alias("tie"), text_bytes().alias("text")).where(
        F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    )
    schema = T.StructType([*(some.schema[c] for c in ("lang", "h", "tie")), T.StructField("parts", T.ArrayType(T.StringType()))])
    most = DICTIONARY_BYTES

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [pieces(v.as_py().decode("utf-8", "replace"), h, chars, most) for h, v in zip(b.column(1).to_pylist(), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(parts, pa.list_(pa.string()))], names=["lang", "h", "tie", "parts"])

    picked = (
        some.mapInArrow(cut, schema)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "tie")))
        .where(F.col("rank") <= rows)
        .select("lang", "rank", F.posexplode("parts").alias("turn", "part"))
        .groupBy("lang", "part")
        .agg(F.min(F.struct("turn", "rank")).alias("at"))
        .withColumn("upto", F.sum(F.octet_length("part") + 1).over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce("upto", F.lit(0)) < most)
        .select("lang", "at", "part")
    )
    parts: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.at), reverse=True):
        parts.setdefault(r.lang, []).append(r.part)
    return {lang: " ".join(p).encode()[-DICTIONARY_BYTES:] for lang, p in sorted(parts.items())}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.002) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and reliable (false where the margin is narrow) to every row."""
    added = ("lang_pred", "score", "reliable")
    keep = [c for c in docs.columns if c not in (*added, text)]
    fields = [T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, langs = to_arrow_schema(schema), sorted(dictionaries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import zstandard as zstd

        letter = regex.compile(r"\p{L}").search
        tools = []
        for lang in langs:
            d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append(zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False).compress)
        for batch in batches:
            best, score, sure = [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                s = value.as_py().decode("utf-8", "replace")
                if not langs or not letter(s):
                    best.append("und")
                    score.append(0.0)
                    sure.append(False)
                    continue
                raw = plain(s)
                sizes = sorted((len(f(raw)), lang) for f, lang in zip(tools, langs, strict=True))
                margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                best.append(sizes[0][1])
                score.append(0.5 + 0.5 * margin / (margin + 0.02))
                sure.append(margin >= min_margin)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema=arrow)

    return map_arrow(docs.select(*map(column, keep), text_bytes(text).alias(text)), released(run), schema)
