"""Registered queries against their SQL, on the small tables."""

import duckdb
import pytest

from newsgraph.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    plain = base.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in plain.description)
    expected = [tuple(dict(zip((d[0] for d in plain.description), row, strict=True))[c] for c in columns) for row in plain.fetchall()]
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == columns
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(expected, key=key) and len(expected) > 0
