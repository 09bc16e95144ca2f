"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob

import duckdb

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, query, sql, sf=SF):
    got, con = query(spark, sf), duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    columns = sorted(got.columns)
    want = con.sql(sql).select(*(f'"{c}"' for c in columns)).fetchall()
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert found and sorted(map(repr, found)) == sorted(map(repr, want))
