"""The registered queries of the subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bandjoin, bpe, language, linededup, mixing, ngrams, recompression, spelling, spotsigs, suffixes, topk, toxicity, warc
from .common import documents, held_out, pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(documents(spark, sf_dir))


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_with_next(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.groups(documents(spark, sf_dir), n=4, percent=85)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(documents(spark, sf_dir), digest=True)


def op7_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir), digest=True)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    dictionaries = language.learn(docs.where(~held_out()))
    out = language.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), dictionaries)
    return out.select("doc_id", "held_out", "lang_pred", "score", "reliable")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~held_out()))
    return toxicity.score(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op11_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandjoin.near_lines(spark.read.parquet(f"{sf_dir}/items.parquet"), spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(pages(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_spot_signatures": op2_spot_signatures,
    "op3_ngram_join": op3_ngram_join,
    "op4_top_k": op4_top_k,
    "op5_recompression": op5_recompression,
    "op7_suffix_family": op7_suffix_family,
    "op6_language": op6_language,
    "op8_toxicity": op8_toxicity,
    "op10_mixing": op10_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op11_band_join": op11_band_join,
    "op12_warc": op12_warc,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op3_ngram_join": ngrams.ORACLE,
    "op4_top_k": topk.ORACLE,
    "op5_recompression": recompression.ORACLE,
    "op7_suffix_family": suffixes.ORACLE,
    "op11_band_join": bandjoin.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
