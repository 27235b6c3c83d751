"""P8 in two scans: against exact quantiles and pandas, with brackets forced on small tables."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import summary
from tessera.plans.quantiles import exact_quantiles


def _numeric(df, column):
    return {r["stat"]: r["number"] for r in summary.summary_statistics(df).collect() if r["section"] == "numeric" and r["column"] == column}


@pytest.mark.parametrize("whole", [summary.WHOLE, 50])
def test_quantiles_equal_the_exact_ones(spark, monkeypatch, whole):
    monkeypatch.setattr(summary, "WHOLE", whole)
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 2.0, float("inf"), float("-inf"), float("nan"), None]), rng.randrange(4)) for _ in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c int").repartition(7)
    want = exact_quantiles(df, ["a", "b", "c"], list(summary.PROBS))
    for c in "abc":
        got = _numeric(df, c)
        for p in summary.PROBS:
            assert got[f"{p:.0%}"] == want[(c, p)] or math.isnan(want[(c, p)]), (c, p)


def test_missed_brackets_fall_back_to_exact_selection(spark, monkeypatch):
    monkeypatch.setattr(summary, "_brackets", lambda row, i: [(-2.0, -1.0)])
    df = spark.createDataFrame([(float(i),) for i in range(101)], "a double")
    assert [_numeric(df, "a")[s] for s in ("25%", "50%", "75%")] == [25.0, 50.0, 75.0]


def test_sections_against_pandas(spark):
    rows = [(i % 7, "x" if i % 3 else None, f"2024-01-{1 + i % 9:02d}", str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "n int, word string, order_date string, wide string")
    out = summary.summary_statistics(df).collect()
    want = pd.Series([r[0] for r in rows]).describe()
    got = {r["stat"]: r["number"] for r in out if r["section"] == "numeric"}
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want.index)
    assert {r["stat"]: r["text"] or r["number"] for r in out if r["section"] == "range"} == {
        "earliest": "2024-01-01", "latest": "2024-01-09", "span_days": 8.0}
    # 500 different values of "wide" are no distribution; missing cells are no value
    assert [(r["column"], r["stat"], r["number"]) for r in out if r["section"] == "distribution"] == [
        ("word", "x", float(sum(r[1] is not None for r in rows)))]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "a double, t string, d_date date")
    out = {(r["section"], r["stat"]): r["number"] for r in summary.summary_statistics(df).collect()}
    assert out[("numeric", "count")] == 0 and out[("numeric", "50%")] is None
    assert {s for s, _ in out} == {"numeric"}
    text = summary.summary_statistics(spark.createDataFrame([("q",), ("q",)], "t string")).collect()
    assert [(r["section"], r["stat"], r["number"]) for r in text] == [("distribution", "q", 2.0)]


def test_duplicates_by_fingerprint(spark):
    from tessera.operators import profile
    rows = [(None, "a", 1.0), ("a", None, 1.0), ("a", None, 1.0), (None, None, float("nan")), (None, None, float("nan")),
            ("x", "y", 0.0), ("x", "y", -0.0), ("f1", "n", 2.0)]
    df = spark.createDataFrame(rows, "f1 string, `a.b` string, n double")
    assert profile.duplicate_rows(df).first()[0] == 3
    assert profile.duplicate_rows(df.unionAll(df)).first()[0] == 3 + len(rows)
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0
    flagged = {(r["check"], r["column"]) for r in profile.validate(df.select("f1", F.lit(None).cast("int").alias("gone"))).collect() if r["flagged"]}
    assert flagged == {("empty_column", "gone"), ("null_percent", "gone"), ("duplicate_rows", None)}


def test_only_fingerprints_are_shuffled_for_unique_rows(spark):
    from tessera.operators import profile
    plan = profile.duplicate_rows(spark.range(10).withColumn("t", F.lit("x")))._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("f1" in line and "f2" in line for line in first)
