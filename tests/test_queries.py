"""Every registered query against its SQL twin in DuckDB, values and types alike."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row))


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    res = duck.execute(oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = ordered(tuple(row[names.index(c)] for c in cols) for row in res.fetchall())
    assert not any(isinstance(v, float) and math.isnan(v) for row in got for v in row)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs_without_sql(spark, name):
    assert queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["y", "x", "out_r", "out_g", "out_b"]
