"""Every registered core query against its SQL twin."""

import os

import duckdb
import pytest

from tracequarry.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def shown(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == sorted(tuple(shown(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())


def test_flagship():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)
