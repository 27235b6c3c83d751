"""Correlation of many columns against pandas, pairwise-complete."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import wide_correlation as wide


def frame(rows=400, cols=23):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(rows, 4))
    x = base @ rng.normal(size=(4, cols)) + 0.3 * rng.normal(size=(rows, cols)) + 1e6 * np.arange(cols)
    df = pd.DataFrame(x, columns=[f"col `{i}`" if i == 3 else f"v{i}" for i in range(cols)])
    df.iloc[::7, 5] = np.nan
    df.iloc[::3, 11] = np.nan
    df.iloc[1::2, 12] = np.nan
    df["flat"] = 2.5
    df["none"] = np.nan
    return df


def matrix(rows):
    return {(r["col_a"], r["col_b"]): r["r"] for r in rows.collect()}


@pytest.mark.parametrize("strip", [1 << 27, 3000])
def test_against_pandas(spark, monkeypatch, strip):
    monkeypatch.setattr(wide, "STRIP_BYTES", strip)    # the small bound makes several strips
    pdf = frame()
    got = matrix(wide.wide_correlation(spark.createDataFrame(pdf).repartition(5), list(pdf.columns), tile=4))
    want = pdf.corr()
    assert len(got) == len(pdf.columns) ** 2
    for (a, b), r in got.items():
        if np.isnan(want.loc[a, b]):
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-7), (a, b)


def test_edges(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, float("inf"), 2), (None, 3.0, 9)], "x double, y double, z long")
    got = matrix(wide.wide_correlation(df))
    assert got["x", "z"] == pytest.approx(1.0) and got["x", "x"] == pytest.approx(1.0)
    assert got["x", "y"] is None and got["y", "y"] is None and len(got) == 9
    assert set(matrix(wide.wide_correlation(df.limit(0))).values()) == {None}
    # each column varies, but not on the rows that both have
    part = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (2.0, None), (None, 7.0)], "x double, y double")
    assert matrix(wide.wide_correlation(part))["x", "y"] is None
    with pytest.raises(ValueError, match="at least two"):
        wide.wide_correlation(df, ["x"])
