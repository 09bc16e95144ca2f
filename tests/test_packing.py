"""Packing in pieces against the packer that goes through its rows one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spindrift.functions.models import RERANKERS, Packer, rerank
from spindrift.plans import packing

RNG = random.Random(9)


def in_order(tokens, most):
    packer = Packer(most)
    return [packer.place(t) for t in tokens]


def test_pieces_compose():
    """Random sequences cut at random places: states handed on, and tables composed in any order, give what the whole gives."""
    for _ in range(400):
        most = RNG.choice([256, 300, 512, 24 * 256, 96 * 256])
        tokens = [RNG.choice([0, 1, 100, 256, 257, 300, 700, 1200, 1300, 5000, 10**6, 2**40]) for _ in range(RNG.randint(0, 60))]
        capacity, cuts = most * 256, sorted(RNG.sample(range(len(tokens) + 1), min(len(tokens), RNG.randint(0, 6))))
        parts = [np.array(tokens[a:b], np.int64) for a, b in zip([0, *cuts], [*cuts, len(tokens)], strict=True)]
        tables, state, got = [packing.summed_up(p, capacity) for p in parts], (capacity, 0, -1), []
        for p, t in zip(parts, tables, strict=True):
            got += packing.numbers(p, capacity, *state).tolist()
            state = t.enter(capacity, *state)
        assert got == in_order(tokens, most)
        while len(tables) > 1:
            i = RNG.randrange(len(tables) - 1)
            tables[i : i + 2] = [tables[i].then(tables[i + 1], capacity)]
        assert tables[0].enter(capacity, capacity, 0, -1) == state and len(tables[0].room) <= most // 256 + 2
        assert packing.Piece.of(tables[0].row()).enter(capacity, capacity, 0, -1) == state


@pytest.mark.parametrize(("piece_rows", "fan"), [(10**6, 1000), (60, 3)])
def test_groups_of_every_size(spark, piece_rows, fan):
    """One group of most rows in many pieces and three levels, others of a row or a few, one without a name, unknown numbers of tokens."""
    rows = [(g, i, RNG.choice([None, 0, 100, 300, 700, 1200, 1300, 5000])) for g, n in (("a", 1500), ("b", 1), ("c", 37), (None, 55)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, n long, t long").repartition(5)
    want = {}
    for g in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        want |= {(g, r[1]): b for r, b in zip(own, in_order([r[2] or 0 for r in own], 24 * 256), strict=True)}
    found = packing.batch_numbers(df, "k", "n", "t", 24 * 256, piece_rows, fan)
    assert found.columns == ["k", "n", "batch_no"] and {(r.k, r.n): r.batch_no for r in found.collect()} == want
    assert packing.batch_numbers(df.limit(0), "k", "n", "t", 256).count() == 0


class Told:
    """A reranker that scores a text by how many came with it."""

    def scores(self, query, texts):
        return [float(len(texts))] * len(texts)


def test_the_reranker_gets_batches_of_tokens(spark, monkeypatch):
    monkeypatch.setitem(RERANKERS, "told", Told)
    rows = spark.createDataFrame([(i, "x" * 2000) for i in range(9)] + [(9, "y" * 30)], "id long, text string").coalesce(1)
    got = {r.id: r.rerank_score for r in rerank(rows, "q" * 400, "id", "text", "told", most_tokens=256 * 24).collect()}
    # a text of 500 tokens after a query of 100 costs (600 / 256) ** 2 = 5.5 units of 24: four at a time
    assert [got[i] for i in range(10)] == [4.0] * 8 + [2.0] * 2
