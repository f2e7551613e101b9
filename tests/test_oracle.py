"""Every registered query of the library against its DuckDB SQL: same columns, same rows."""

import datetime
import math

import duckdb
import pytest

from tapeloom.plans import oracle, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.ORACLE)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_rows(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(oracle.ORACLE[name])
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    mine = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: mine[t] for c, t in df.dtypes} == kinds
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({oracle.ORACLE[name]})").fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
