"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import pytest

from plumbline.plans import catalogue
from tests.compare import connect, difference, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalogue.all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("query", QUERIES, ids=[q.name for q in QUERIES])
def test_query(spark, duck, query):
    got = spark_rows(query.run(spark, FOLDER))
    assert got[0]
    if query.sql is not None:
        assert difference(got, duck_rows(duck, query.oracle())) == ""


def test_entry_points(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    df = entry.entry(spark)
    assert df.columns == ["period", "total_anomalies", "anomaly_score", "is_anomaly"] and df.count() > 0
