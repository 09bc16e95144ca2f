from __future__ import annotations

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spindrift.llm.common import written
from spindrift.llm.queries import ORACLES, QUERIES
from spindrift.llm import bpe, toxicity

from . import brute
from .sql import same_as_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same_as_sql(spark, QUERIES[name], ORACLES[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == columns
    toxic, lines, near, mixed, coded = (kept[n] for n, _ in corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in toxic.collect()]
    want = {i: k.decode() for i, _, _, k in brute.lines(rows)}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    parts = brute.components(list(want.items()), 5, 80)
    assert {r.doc_id for r in near.collect()} == {c for _, c in parts.values()}
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    assert coded.count() == mixed.count() and coded.where("n_tokens > 0").count() > 0
    whole = mixed.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    assert sorted(map(tuple, whole.collect())) == sorted((r.doc_id, r.decoded_sha256) for r in coded.collect())


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_run_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, extra and clashing columns; no model can be learned."""
    line, long = "this line stands in many of the documents", "word for word the same text that is long enough to have shingles"
    rows = [(i, f"{long} {i}\n{line}" if i < 6 else long, "en", f"s{i % 2}") for i in range(12)]
    rows += [(20, long, "en", None), (20, long, "en", None), (21, None, None, "s0"), (22, "", "de", "s1"), (None, f"an id is missing here\n{line}", "en", "s0"), (None, None, "en", "s0"), (23, "x " * 3000, "en", "s1")]
    full = [(*r, len(r[1] or ""), 7, "tie", 1.5) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, again int, tie string, raw double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, k.decode()) for i, _, _, k in brute.lines([r[:2] for r in rows])]
    named = [(i, t) for i, t in kept if i is not None and i != 20]
    parts = brute.components([*named, (20, long)], 5, 80)
    stay = {c for _, c in parts.values()} | {None}
    sizes = {(i, t): brute.word_size(t) for i, t in kept if i in stay}
    assert {r.doc_id for r in got} <= {i for (i, _), n in sizes.items() if n}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    whole = {hashlib.sha256(t.encode()).hexdigest(): len(encoding.encode_ordinary(t)) for _, t in kept}
    for r in got:
        assert r.n_tokens == len(r.ids) // 4
        if r.decoded_sha256 in whole:
            assert r.n_tokens == whole[r.decoded_sha256]
    assert sum(r.decoded_sha256 in whole for r in got) > 0
    words = sum(sizes.values())
    taken = sum(brute.word_size(encoding.decode_bytes(np.frombuffer(r.ids, "<u4").tolist()).decode()) for r in got)
    assert abs(taken - words) <= 0.1 * words + 128


def test_rejection_against_the_operator(spark):
    """The stage keeps exactly what the model of its own input doesn't predict to be toxic, and some of it is rejected."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf).collect()}
    predicted = {r.doc_id: r.predicted for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    assert kept == {i for i, p in predicted.items() if p == 0} and 0 < len(predicted) - len(kept) < 0.2 * len(predicted)


def test_toxic_share(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    kept = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id")
    assert kept.where("toxic = 0 and predicted = 1").count() <= 1 and kept.where("toxic = 1 and predicted = 1").count() > 0
