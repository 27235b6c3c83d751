"""Registered queries against their DuckDB twins, and the contract columns."""

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tools.oracle_check import compare

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE_SQL[name])
    res = compare(sdf.columns, rows, [d[0] for d in cur.description], cur.fetchall())
    assert res["exact"], (name, res)


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name,columns", [
    ("op7_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op8_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    ("op9_jaccard_join", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}),
    ("op1_topk_search", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}),
])
def test_contract_columns(spark, name, columns):
    assert dict(QUERIES[name](spark, SF).dtypes) == columns
