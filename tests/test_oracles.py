"""Every registered query of the engine against its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pytest

from spindrift.plans.catalog import ORACLES, QUERIES
from spindrift.plans.registry import FIXED, FIXED_ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted({*QUERIES, *FIXED}))
def test_query(spark, name):
    got = (QUERIES | FIXED)[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql((ORACLES | FIXED_ORACLES)[name]).select(*(f'"{c}"' for c in columns))
    assert cells(map(tuple, got.select(*columns).collect())) == cells(want.fetchall())
