"""Every query against its oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import check
from vettica.plans.derived import TABLES

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_its_oracle(spark, database, name):
    query = contract.queries()[name]
    assert check.compare(spark, database, FOLDER, name, query, ORACLES.get(name))


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(contract.queries())


def test_entry_has_rows_and_no_raw_secret(spark):
    rows = contract.entry(spark).collect()
    assert rows
    assert not any("AKIA0" in str(row) for row in rows)
