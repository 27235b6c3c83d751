"""Inverted-file index (R4) against exact search."""

import numpy as np

from tessera.operators import ann, vector


def vectors(spark, n, dim, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim)) * 3
    x = (centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")


def test_index_reaches_the_floor_and_reads_few_cells(spark, tmp_path):
    df = vectors(spark, 3000, 20)
    asked = df.where("id % 50 = 0").selectExpr("id as query_id", "embedding")
    index = ann.build(df, str(tmp_path / "ix"), cells=40, subspaces=5)
    assert sum(index.sizes.values()) == 3000
    probes, seen = ann.probes_for(index, df, asked, 10, 0.95, "id", "embedding", "query_id", "embedding", sample=30)
    assert probes < 40 and seen >= 0.95
    exact = vector.knn(df, asked, k=10)
    found = ann.search(index, asked, 10, probes)
    got = ann.recall(found, exact).agg({"hits": "sum", "k": "sum"}).first()
    assert got["sum(k)"] == 600 and got["sum(hits)"] >= 0.9 * 600
    one = asked.where("query_id = 100")
    plan = ann.search(index, one, 10, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_all_cells_and_a_wide_rerank_are_exact(spark, tmp_path):
    df = vectors(spark, 400, 7, seed=2)
    asked = df.where("id % 40 = 0").selectExpr("id as query_id", "embedding")
    index = ann.build(df, str(tmp_path / "ix"), cells=9, subspaces=3)
    found = ann.search(ann.AnnIndex(spark, str(tmp_path / "ix")), asked, 5, probes=9, rerank=400)
    exact = vector.knn(df, asked, k=5)
    rows = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 4)) for r in d.collect())
    assert rows(found) == rows(exact)
    assert {r["cell"] for r in index.rows.select("cell").distinct().collect()} <= set(range(9))


def test_awkward_vectors(spark, tmp_path):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(300)]     # one group of equal vectors in one cell
    odd = [(900, None), (901, []), (902, [1.0]), (903, [1.0, float("nan"), 2.0]), (904, [1.0, None, 2.0]), (None, [1.0, 2.0, 3.0]), (905, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(same + odd, "id long, embedding array<float>")
    index = ann.build(df, str(tmp_path / "ix"))
    assert sum(index.sizes.values()) == 301
    asked = df.where("id >= 900 or id = 7 or id is null").selectExpr("id as query_id", "embedding")
    got = [(r["query_id"], r["rank"], r["id"]) for r in ann.search(index, asked, 3, probes=9, rerank=400).orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 0), (7, 2, 1), (7, 3, 2), (905, 1, 905), (905, 2, 0), (905, 3, 1)]
    empty = ann.build(df.limit(0), str(tmp_path / "none"))
    assert ann.search(empty, asked, 3).count() == 0
    assert ann.search(index, asked.limit(0), 3).count() == 0


def test_vectors_are_not_broadcast(spark, tmp_path):
    df = vectors(spark, 500, 8)
    index = ann.build(df, str(tmp_path / "ix"), cells=6, subspaces=4)
    found = ann.search(index, df.where("id % 50 = 0").selectExpr("id as query_id", "embedding"), 5, 3)
    plan = found._jdf.queryExecution().executedPlan()
    assert found.count() == 50
    joins = [line for line in plan.toString().splitlines() if "Join" in line and ("v_id" in line or "a_q" in line)]
    assert joins and not [line for line in joins if "Broadcast" in line]
