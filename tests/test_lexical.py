"""BM25 by postings against scores of all documents, skipped blocks, odd texts, the reranker."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from spindrift.functions import models
from spindrift.functions.models import rerank
from spindrift.operators.store import Store
from spindrift.plans import lexical
from spindrift.plans.search import Engine, QueryParams
from spindrift.streaming.feed import index_workspace

RNG = random.Random(8)


def plain(rows, query):
    """{id: score} of (id, text) rows."""
    words = {i: re.findall(r"[a-z0-9]+", (t or "").lower()) for i, t in rows}
    mean, out = sum(map(len, words.values())) / len(words), Counter()
    for term in set(re.findall(r"[a-z0-9]+", query.lower())):
        counts = {i: w.count(term) for i, w in words.items() if term in w}
        rare = math.log(1 + (len(words) - len(counts) + 0.5) / (len(counts) + 0.5))
        for i, n in counts.items():
            out[i] += rare * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
    return out


def corpus():
    common = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(RNG.choices(common, k=RNG.randint(1, 120)))) for i in range(600)]
    rows += [(1000 + i, f"Rare-{i % 3} {rows[i][1]} needle needle") for i in range(5)] + [(2000, None), (2001, ""), (2002, "?!"), (2003, "W1 w1, W1"), (2004, "w2 " * 9000)]
    return rows


def test_search(spark, tmp_path):
    rows = corpus()
    index = lexical.build(spark.createDataFrame(rows, "n long, body string").repartition(4), str(tmp_path / "i"), "n", "body", segment=8)
    assert index.documents == len(rows)
    for query, k in (("needle w3 rare", 4), ("w1 w1 W2", 10), ("w5", 700), ("Needle", 50), ("nothing of it", 3), ("", 3)):
        want = plain(rows, query)
        order = sorted(want, key=lambda i: (-round(want[i], 9), i))[:k]
        found = lexical.search(lexical.load(spark, index.path), query, k, first=6)
        got = [(r.id, round(r.score, 6)) for r in found.rows.collect()]
        assert [i for i, _ in got] == order and [s for _, s in got] == [round(want[i], 6) for i in order], query
        assert found.read <= found.blocks
        if query == "needle w3 rare":
            assert 0 < found.read < 0.7 * found.blocks  # segments without the rare words are skipped
    nothing = lexical.build(spark.createDataFrame([], "id long, text string"), str(tmp_path / "none"))
    assert lexical.search(nothing, "w1", 3).rows.collect() == []


def test_blocks_are_read_by_term(spark, tmp_path):
    index = lexical.build(spark.createDataFrame(corpus(), "id long, text string"), str(tmp_path / "i"))
    plan = index.blocks.where("term in ('w1', 'w2')").select("term", "segment", "impact")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w1,w2])]" in plan and "length" not in plan


def test_reranker(spark, workspace, tmp_path):
    rows = corpus()
    index = lexical.build(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "i"))
    name = lexical.use(spark, f"bm25:{index.path}", "needle w3")
    want = plain(rows, "needle w3")
    got = rerank(spark.createDataFrame(rows, "id long, text string"), "needle w3", "id", "text", name, slice_chars=1 << 30).collect()
    assert {r.id: round(r.rerank_score, 6) for r in got} == {i: round(want[i], 6) for i, _ in rows}
    del models.RERANKERS[name]
    assert lexical.use(spark, "lexical", "x") == "lexical" and lexical.use(spark, None, "x") is None
    store = Store(spark, str(tmp_path / "index"))
    index_workspace(spark, store, "w", str(workspace))
    own = lexical.build(store.table("changelists"), str(tmp_path / "own"), "id", "message")
    best = Engine(spark, store.root).search(QueryParams("scheduler notes", max_changes=1, scope="metadata", reranker=f"bm25:{own.path}", min_score=0)).collect()
    assert [r.message for r in best] == ["Add scheduler notes"] and not any(n.startswith("bm25:") for n in models.RERANKERS)


def test_building_shuffles_texts_alone(spark, tmp_path):
    """What is shuffled grows with the texts, not with their postings; files are ordered by term."""
    rows = [(i, " ".join(f"w{(i * j) % 997}" for j in range(1, 200))) for i in range(400)]
    texts = spark.createDataFrame(rows, "id long, text string")
    status = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(status.executorList(False).apply(i).totalShuffleWrite() for i in range(status.executorList(False).size()))
    before = shuffled()
    index = lexical.build(texts, str(tmp_path / "i"), segment=16)
    assert shuffled() - before < sum(len(t) for _, t in rows)
    assert {r.id: round(r.score, 6) for r in lexical.search(index, "w1 w2 w996", 500).rows.collect()} == {i: round(x, 6) for i, x in plain(rows, "w1 w2 w996").items()}
    blocks = index.blocks.select(F.input_file_name().alias("file"), "term", "segment", "documents", F.size("id").alias("size")).collect()
    for file in {b.file for b in blocks}:
        own = [(b.term, b.segment) for b in blocks if b.file == file]
        assert own == sorted(set(own))
    assert all(b.documents == b.size for b in blocks)
