"""The store's versions: a failed write, pinned readers, removal of old ones."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import store


def test_failed_write_leaves_the_version_before(spark, tmp_path):
    d = str(tmp_path / "kb")
    one, two = spark.range(3), spark.range(5).withColumn("x", F.raise_error(F.lit("stop")))
    store.write_store(d, documents=one, chunks=one)
    with pytest.raises(Exception, match="stop"):
        store.write_store(d, documents=spark.range(9), chunks=two)      # documents are written, chunks fail
    assert store.read_store(spark, d).count() == 3 and store.read_store(spark, d, "chunks").count() == 3
    store.write_store(d, documents=spark.range(4), chunks=spark.range(4))
    assert store.read_store(spark, d).count() == 4


def test_readers_keep_their_version(spark, tmp_path):
    d = str(tmp_path / "kb")
    store.write_store(d, documents=spark.range(2), chunks=spark.range(20))
    pinned, before = store.store_version(spark, d), store.read_store(spark, d)
    store.write_store(d, documents=before.unionAll(spark.range(1)), chunks=spark.range(30))    # reads what it replaces
    assert before.count() == 2 and store.read_store(spark, d).count() == 3
    assert store.read_store(spark, d, "chunks", version=pinned).count() == 20


def test_removal_of_old_versions(spark, tmp_path):
    d = str(tmp_path / "kb")
    assert store.remove_old_versions(spark, d) == []
    for n in (1, 2, 3):
        store.write_store(d, documents=spark.range(n))
    assert len(store.remove_old_versions(spark, d, keep=2)) == 1 and len(store.remove_old_versions(spark, d)) == 1
    shown = lambda part: [n for n in os.listdir(f"{d}/{part}") if not n.startswith(".")]  # noqa: E731  (local checksum files)
    assert store.read_store(spark, d).count() == 3 and len(shown("versions")) == len(shown("complete")) == 1
    with pytest.raises(ValueError):
        store.remove_old_versions(spark, d, keep=0)


def test_tables_without_versions_are_read(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "old" / "documents"))
    assert store.read_store(spark, str(tmp_path / "old")).count() == 6
