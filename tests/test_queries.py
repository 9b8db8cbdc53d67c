import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, engine, name):
    df = contract.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = engine.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert found == expected and found


def test_every_oracle_has_a_query():
    assert set(QUERIES) - set(ORACLES) == {"neardup_scored", "code_duplication"}
    assert set(contract.queries()) >= set(QUERIES) and set(contract.oracle_sql()) >= set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
