"""Every query that has SQL gives the same rows as DuckDB, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from textloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    return value if value is None or isinstance(value, int) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_names_and_guard():
    import __spark_entry__

    assert catalogue.FLAGSHIP in catalogue.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
