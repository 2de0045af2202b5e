"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import pytest

from wakeflow.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for table in ("events", "orders"):
        con.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df, names: sorted(map(repr, (tuple(plain(r[names.index(c)]) for c in columns) for r in df)))
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_all_queries_are_registered():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) - set(ORACLE_SQL) == {"track_simplification", "situation_reports", "forest_predictions", "boosted_predictions"}
