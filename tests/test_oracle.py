"""Layer 1: every registered query with a DuckDB twin matches it (sf0.001)."""

import duckdb
import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES
from tessera.sources.tables import TABLES
from tools.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE_SQL[name])
    drows = cur.fetchall()
    res = compare(sdf.columns, srows, [d[0] for d in cur.description], drows)
    assert res["cols_match"], (sorted(sdf.columns), [d[0] for d in cur.description])
    assert res["rows"][0] == res["rows"][1]
    assert res["exact"], name


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
