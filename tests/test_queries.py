"""Every query that has SQL gives the same rows as the SQL."""

import math

import duckdb
import pytest

from cadenza.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value + 0.0:.8f}" if isinstance(value, float) else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    found = QUERIES[name](spark, DATA)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    if name not in ORACLE_SQL:
        assert got
        return
    relation = oracle.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == sorted(found.columns)
    assert got == rows(relation.columns, relation.fetchall())


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
