"""Registered queries against their SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
NAMES = sorted(n for n in ORACLES if not n.startswith("op"))  # those of op queries are tested in tests/llm


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in order) for r in relation.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[-4:] == ["crop", "predicted", "base_value", "contributions"]
    assert df.where("predicted < 0").isEmpty() and not df.isEmpty()
