"""The learned embedder: near copies by brute force, the factorisation against numpy, files, an index that uses it."""

from __future__ import annotations

import numpy as np

from spindrift.functions import models
from spindrift.operators.store import Store
from spindrift.plans import learned
from spindrift.plans.search import Engine, QueryParams
from spindrift.streaming.feed import index_workspace

SF = "/root/testdata/sf0.001"


def test_near_copies_rank_first(spark, tmp_path):
    """For nine of ten documents with a near copy (word sets by brute force, 0.8) the nearest vector is one's; words that never occur have a place too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = learned.learn(docs, dimension=48, width=64, rounds=2)
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    sets = [set(t.lower().split()) for t in texts]
    x = np.array(model.embed_batch(texts))
    g = x @ x.T
    np.fill_diagonal(g, -9)
    hits = asked = 0
    for i, a in enumerate(sets):
        good = {j for j, b in enumerate(sets) if j != i and len(a & b) >= 0.8 * len(a | b)} if len(a) >= 5 else ()
        asked, hits = asked + bool(good), hits + (bool(good) and int(g[i].argmax()) in good)
    assert asked >= 20 and hits >= 0.9 * asked
    assert model.embed_batch(["", "  ", "?"]) == [[0.0] * 48] * 3 and abs(sum(v * v for v in model.embed_batch(["qqqqzzzz"])[0]) - 1) < 1e-6
    column = docs.select(learned.embedding(docs.text, model).alias("v"), "doc_id").orderBy("doc_id").collect()
    assert np.allclose([r.v for r in column], x, atol=1e-5)
    learned.save(spark, model, str(tmp_path / "model"))
    name = learned.use(spark, f"learned:{tmp_path}/model")
    again = models.create(models.EMBEDDERS, name)
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.scale, model.scale) and learned.use(spark, "hashing") == "hashing"
    del models.EMBEDDERS[name]


def test_directions_are_those_of_the_counts(spark):
    """The leading directions against an eigendecomposition of the whole matrix, with few buckets."""
    texts = ["red green blue"] * 9 + ["north south east west"] * 7 + ["one two three red"] * 5 + ["", "one"]
    model = learned.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), dimension=3, width=12, rounds=4, buckets=64)
    rows = np.zeros((len(texts), 64))
    for r, t in zip(rows, texts, strict=True):
        at, w = learned.row_of(t.split(), learned._Buckets(64))
        r[at] = w * model.scale[at]
    rows = rows[[bool(t) for t in texts]]
    rows /= np.sqrt((rows**2).sum(axis=1))[:, None]
    values, vectors = np.linalg.eigh(rows.T @ rows)
    want = vectors[:, ::-1][:, :3]
    found = model.vectors / np.sqrt((model.vectors**2).sum(axis=0))
    assert np.allclose(np.abs((want * found).sum(axis=0)), 1, atol=1e-3)


def test_an_index_with_a_learned_embedder(spark, workspace, tmp_path):
    texts = spark.createDataFrame([("change parser part",), ("add scheduler notes",), ("rename module",), ("delete module one",)], "text string")
    learned.save(spark, learned.learn(texts, dimension=16, width=24, rounds=2, buckets=4096), str(tmp_path / "model"))
    store, name = Store(spark, str(tmp_path / "index")), f"learned:{tmp_path}/model"
    assert index_workspace(spark, store, "w", str(workspace), model=name) == 9
    assert store.table("experts").first().embedder == name
    best = Engine(spark, store.root, name).search(QueryParams("scheduler notes", max_changes=1, scope="metadata", reranker=None)).collect()
    assert [r.message for r in best] == ["Add scheduler notes"]
    del models.EMBEDDERS[name]
