"""Every query of the catalogue against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallywick.plans import catalogue, oracles


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sql, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rel = sql.execute(oracles.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), names)


def test_every_query_is_registered():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(oracles.ORACLES) <= set(entry.oracle_sql())
