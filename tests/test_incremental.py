"""Documents as files arrive: equal to documents of the whole table after every update."""

import pytest

from tessera.operators import documents, incremental
from tessera.sources.store import read_store, store_version

SCHEMA = "file string, date date, product string, region string, sales double, units long"


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA.replace("date date", "date string")).selectExpr(
        "file", "cast(date as date) as date", "product", "region", "sales", "units")


def docs(df):
    return {(r["doc_type"], r["key"]): (r["n_rows"], r["page_content"]) for r in df.collect()}


def check(spark, folder, *parts):
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    assert docs(incremental.group_documents(spark, folder)) == docs(documents.group_documents(whole.drop("file")))


def test_arrivals_replacement_and_removal(spark, tmp_path):
    folder = str(tmp_path / "kb")
    a = rows(spark, ("a", "2024-01-05", "tea", "north", 10.25, 1), ("a", None, "tea", " ", None, 2), ("a", "2024-02-01", None, "south", 1e30, 3))
    b = rows(spark, ("b", "2024-01-09", "nuts", "north", 0.1, None), ("b", "2024-03-09", "nuts", "west", float("nan"), 4))
    c = rows(spark, ("c", "2024-01-09", "tea", "south", 0.2, 7), ("c", "2024-01-09", "tea", "south", 0.2, 7))
    assert incremental.apply_files(spark, folder, a) == 5
    check(spark, folder, a)
    incremental.apply_files(spark, folder, b.unionByName(c))    # two files in one update
    check(spark, folder, a, b, c)
    first = {(r["doc_type"], r["key"]): r["version"] for r in read_store(spark, folder).collect()}
    b2 = rows(spark, ("b", "2024-03-10", "nuts", "west", float("inf"), 5))
    assert incremental.apply_files(spark, folder, b2) == 5
    check(spark, folder, a, b2, c)
    then = {(r["doc_type"], r["key"]): r["version"] for r in read_store(spark, folder).collect()}
    assert {k for k in then if then[k] != first.get(k)} == {("time_period", "2024-01"), ("time_period", "2024-03"),
                                                           ("product", "nuts"), ("region", "north"), ("region", "west")}
    # an infinite value leaves no trace, nor does one too large for the exact sum
    b3 = rows(spark, ("b", "2024-03-10", "nuts", "west", 2.5, 5))
    incremental.apply_files(spark, folder, b3)
    a2 = rows(spark, ("a", "2024-02-01", None, "south", 0.3, 3))
    incremental.apply_files(spark, folder, a2)
    check(spark, folder, a2, b3, c)
    gone = spark.createDataFrame([("c",), ("unknown",)], "file string")
    incremental.apply_files(spark, folder, removed=gone)
    check(spark, folder, a2, b3)
    incremental.apply_files(spark, folder, c, removed=gone)     # arrives again
    check(spark, folder, a2, b3, c)


def test_errors_and_failed_update(spark, tmp_path):
    folder = str(tmp_path / "kb")
    a = rows(spark, ("a", "2024-01-05", "tea", "north", 10.25, 1))
    with pytest.raises(ValueError, match="No files"):
        incremental.apply_files(spark, folder)
    with pytest.raises(ValueError, match="column"):
        incremental.apply_files(spark, folder, a.select("file", "units"))
    incremental.apply_files(spark, folder, a)
    before = store_version(spark, folder)
    with pytest.raises(ValueError, match="same columns"):
        incremental.apply_files(spark, folder, a.drop("units"))
    with pytest.raises(Exception, match="without a file name"):
        incremental.apply_files(spark, folder, rows(spark, (None, "2024-01-05", "tea", "north", 1.0, 1)))
    assert store_version(spark, folder) == before
    check(spark, folder, a)
    incremental.apply_files(spark, folder, a.limit(0))          # nothing arrived
    check(spark, folder, a)
    incremental.apply_files(spark, folder, removed=spark.createDataFrame([("a",)], "file string"))
    assert incremental.group_documents(spark, folder).count() == 0
