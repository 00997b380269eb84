"""Every query of the catalogue against its SQL."""

import os

import duckdb
import pytest

from heronry.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "embeddings", "benchmark", "labels", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    cursor = db.execute(catalogue.SQL[name])
    names = [d[0] for d in cursor.description]
    expected = rows(names, cursor.fetchall())
    assert sorted(got.columns) == sorted(names)
    assert found == expected
    assert found, "a query without rows shows nothing"
