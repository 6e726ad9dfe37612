"""Every registered operator that SQL can express, against its SQL on the given tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tokenloom.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected
    assert expected
