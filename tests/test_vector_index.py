"""The approximate index: recall against the exact scan over all vectors, files read, inserts and tombstones, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import vector
from spindrift.operators.store import Store
from spindrift.plans import vector_index

SF = "/root/testdata/sf0.1"


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("vectors") / "store"))
    store.create()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.lit("diffs").alias("collection"), F.col("vec_id").cast("string").alias("id"), "embedding")
    store.upsert("vectors", rows, 1)
    store.compact("vectors", file_rows=50)
    assert vector_index.build(store, "diffs", file_rows=40) > 10
    return store


def recall(at, collection, queries, share, k=10):
    """Share of the exact ``k`` best that the index finds, reading ``share`` of the cells."""
    rows = at.table("vectors").where(F.col("collection") == collection).select("id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    codec, hits = vector_index.load(at, collection), 0
    for i in queries(rows):
        least = np.sort(x @ x[i])[-k]
        found = vector_index.top_k(at, collection, list(rows[i].embedding), k, max(1, round(share * len(codec.centres))), codec=codec).collect()
        assert len(found) == k
        hits += sum(r.score >= least - 1e-6 for r in found)
    return hits / k / len(queries(rows))


def test_recall_over_all_vectors(spark, indexed):
    """Vectors of this table are independent draws: nothing is near anything, so the ten nearest are spread over many cells, and codes of six cells of ten are
    read (a tenth of the vectors' bytes at that)."""
    queries = lambda rows: [i for i, r in enumerate(rows) if int(r.id) % 100 == 0]
    assert recall(indexed.snapshot(), "diffs", queries, 0.6) >= 0.9


def test_recall_of_vectors_in_clusters(spark, tmp_path):
    """Where vectors have neighbours, a tenth of the cells does."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(60, 32)) * 2)[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 32))
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    store.upsert("vectors", spark.createDataFrame([("files", str(i), row.tolist()) for i, row in enumerate(x)], "collection string, id string, embedding array<float>"))
    vector_index.build(store, "files")
    assert recall(store.snapshot(), "files", lambda rows: list(range(0, len(rows), 200)), 0.1) >= 0.9


def test_reads_cells_and_not_the_collection(spark, indexed):
    at = indexed.snapshot()
    codec = vector_index.load(at, "diffs")
    q = list(at.lookup("vectors", "id", ["150"]).first().embedding)
    every = len(at.base("vector_codes").inputFiles())
    read = len(vector_index.candidates(at, codec, "diffs", q, 50, 3).inputFiles())
    assert every >= 40 and read <= 0.35 * every
    found = vector_index.top_k(at, "diffs", q, 5, 3, refine=2, codec=codec)
    assert found.first().id == "150" and len(found.inputFiles()) < len(at.base("vectors").inputFiles())


def test_all_cells_and_candidates_give_the_exact_answer(spark, indexed):
    at = indexed.snapshot()
    q = list(at.lookup("vectors", "id", ["77"]).first().embedding)
    exact = vector.top_k(at.table("vectors").select("id", "embedding"), q, 10).collect()
    assert [tuple(r) for r in vector_index.top_k(at, "diffs", q, 10, 10_000, refine=400).collect()] == [tuple(r) for r in exact]


def test_inserts_changes_and_tombstones(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24))
    frame = lambda rows: spark.createDataFrame([("files", str(i), [float(v) for v in row] if row is not None else None) for i, row in rows], "collection string, id string, embedding array<float>")
    odd = [(900, [0.0] * 24), (901, None), (902, [1.0, 2.0]), (903, [float("nan")] * 24)]
    store.upsert("vectors", frame([*enumerate(x), *odd]), 1)
    assert vector_index.build(store, "none") == 0 and vector_index.load(store.snapshot(), "none") is None
    q = [float(v) for v in x[5]]
    assert ids(vector_index.top_k(store.snapshot(), "files", q, 3, 4)) == ids(vector.top_k(store.table("vectors").select("id", "embedding"), q, 3))  # no index yet: the scan
    assert vector_index.build(store, "files", cells=12, parts=6) == 12
    with store.transaction(100, 199) as t:
        t.upsert("vectors", frame([(500, x[5] * 2), (7, x[5] + 0.01), (501, x[200])]))
        vector_index.maintain(t, 100)
        assert ids(vector_index.top_k(t, "files", q, 3, 12))[:2] == ["5", "500"]
        assert "500" not in ids(vector_index.top_k(store.snapshot(), "files", q, 3, 12))  # not before the commit
    best = ids(vector_index.top_k(store.snapshot(), "files", q, 3, 1, refine=100))
    assert best == ["5", "500", "7"]  # 7 has moved to the query's cell
    with store.transaction() as t:
        gone = spark.createDataFrame([("files", "5"), ("files", "7")], "collection string, id string")
        t.delete("vectors", gone)
        t.delete("vector_codes", gone)
    assert ids(vector_index.top_k(store.snapshot(), "files", q, 2, 12, refine=100))[0] == "500"
    whole = ids(vector_index.top_k(store.snapshot(), "files", q, 400, 12, refine=2))
    assert set(whole) == {r.id for r in store.table("vectors").collect()} and {"900", "901", "902", "903"} <= set(whole)
    vector_index.build(store, "files", cells=5, parts=6)  # learned anew: the old cells are gone
    assert store.table("vector_cells").count() == 5 and store.table("vector_codes").count() == store.table("vectors").count()
    assert ids(vector_index.top_k(store.snapshot(), "files", [0.0] * 24, 2, 3)) == ids(vector.top_k(store.table("vectors").select("id", "embedding"), [0.0] * 24, 2))


def test_codec():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 5
    x = (centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16)) * 0.3).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    codec = vector_index.Codec.learn(x, 8, 4)
    cells, codes = codec.encode(x)
    scores, tables = codec.tables(x[0])
    about = scores[cells] + tables[np.arange(4), codes].sum(axis=1)
    assert np.abs(about - x @ x[0]).mean() < 0.02 and codes.dtype == np.uint8
    few = vector_index.Codec.learn(x[:3], 8, 40)  # fewer rows than centres, more parts than components
    assert len(few.centres) == 3 and len(few.books) == 16
