"""Every query with SQL gives what DuckDB gives, on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import SparkSession

from logweft.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> object:
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


def rows(columns: list[str], found: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark: SparkSession, sf: str, name: str) -> None:
    query, sql = QUERIES[name]
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.sql(sql)
    assert got == rows(found.columns, found.fetchall())


def test_entry(spark: SparkSession) -> None:
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["agent", "path", "status", "error_msg", "start_time", "end_time", "n_lines"]
    assert set(e.oracle_sql()) <= set(e.queries())
