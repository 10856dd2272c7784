"""Every registered query against its DuckDB equivalent, on the smallest driver tables."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from attestor.plans.fixtures import TABLES
from attestor.plans.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def canonical(rows):
    def value(v):
        return round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


def test_every_operator_is_registered_with_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert len(ORACLE) == 163  # the operators of the survey and four more


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db):
    df = entry.queries()[name](spark, FOLDER)
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    ours = canonical(tuple(row[n] for n in names) for row in df.collect())
    assert ours == canonical(result.fetchall())


def test_entry_has_one_row_per_schema(spark):
    df = entry.entry(spark)
    assert df.count() == df.select("schema_id").distinct().count() > 0
