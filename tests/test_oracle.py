"""Every query with SQL agrees with DuckDB on the same tables."""

import math

import duckdb
import pytest

from newsgraph.plans import story_queries  # noqa: F401  (registers its queries)
from newsgraph.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    assert _rows(tuple(r[c] for c in columns) for r in got.collect()) == _rows(tuple(r[i] for i in places) for r in expected.fetchall())
