"""The corpus pipeline: reject toxic documents, drop repeated lines, keep one of each group of near copies, mix the
sources to their weights, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the shared
folder and rereads them as the next one's docs. All stages but the last return the columns of documents.
Null and empty texts and empty tables pass every stage; extra columns are dropped at the start.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, linededup, mixing, ngrams, toxicity
from spindrift.llm.common import documents, drop_written, held_out, marked, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic. It learns from the labels as ``op8`` does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~held_out()))
    return _columns(toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later document repeats; every document stays, if need be with an empty text."""
    return _columns(linededup.dedup(docs.select(*COLUMNS)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8) the document with the smallest doc_id.

    Documents without words are in no group and stay. Rows with null doc_id stay; of rows that repeat a
    doc_id all stay that are in the kept document's place.
    """
    named = ngrams.groups(docs.select("doc_id", "text"))
    copies = named.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: for each time that a document is taken a row with the words taken, whole texts as they are."""
    return _columns(mixing.mixture(docs.select(*COLUMNS)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids (little-endian unsigned 32-bit integers) of every row, and a digest of the decoded bytes."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", one_of_each),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Trained models and draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are a table in the shared folder; when they are written, the stage's other tables
    and the rows that it read are deleted."""
    docs, mark = documents(spark, sf_dir).select(*COLUMNS), marked()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, mark, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
