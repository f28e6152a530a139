import duckdb
import pytest

import __spark_entry__ as entry
import check

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "label", "keywords"] and df.count() == 200


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, small, name):
    df = QUERIES[name](spark, small)
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.normal(df.collect(), df.columns) == check.normal(cursor.fetchall(), columns)
