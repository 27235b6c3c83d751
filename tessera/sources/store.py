"""Knowledge-base store and result sinks.

The store is a directory of versions, each a set of Parquet tables (documents,
chunks, vectors), and of pointers to the complete ones: a failed write
leaves the version before it as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

EXPORT_FORMATS = ("parquet", "csv", "json")
_VERSIONS, _POINTERS = "versions", "complete"     # folders of a store


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _committed(spark: SparkSession, directory: str) -> list[tuple[int, str]]:
    """(number, version folder name) of the complete versions, oldest first."""
    fs, p = _fs(spark, f"{directory.rstrip('/')}/{_POINTERS}")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n.split("-")[0]), n) for n in names)


def write_store(directory: str, **tables: DataFrame) -> str:
    """Replace the store with the given tables; the store's folder is returned.

    Every write is a version folder of its own, one sub-folder a table; it counts
    once its pointer, an empty file of the same name, is there, and that is
    written last.  Nothing is renamed or overwritten: a write that fails leaves the
    version before it, and readers of an older version are not disturbed.
    The highest number is current; of writers at the same time the one with the
    greater random part wins, always with tables of one write.
    """
    if not tables:
        raise ValueError("No vector store to save")
    spark = next(iter(tables.values())).sparkSession
    base = directory.rstrip("/")
    done = _committed(spark, base)
    version = f"{(done[-1][0] if done else 0) + 1:012d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{_VERSIONS}/{version}/{name}")
    fs, pointer = _fs(spark, f"{base}/{_POINTERS}/{version}")
    fs.create(pointer, False).close()
    return directory


def store_version(spark: SparkSession, directory: str) -> str | None:
    """The current version's name, to read several tables of one write; None without one."""
    done = _committed(spark, directory)
    return done[-1][1] if done else None


def read_store(spark: SparkSession, directory: str, table: str = "documents", version: str | None = None) -> DataFrame:
    """Reopen a table of a persisted store, of the given version or of the current one.

    The files are fixed when this is called, so later writes do not change what is read.  A folder
    of tables without versions is read as it is."""
    base = directory.rstrip("/")
    version = version or store_version(spark, base)
    path = f"{base}/{_VERSIONS}/{version}/{table}" if version else f"{base}/{table}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Directory not found: {directory}")
    return spark.read.parquet(path)


def remove_old_versions(spark: SparkSession, directory: str, keep: int = 1) -> list[str]:
    """Delete all complete versions but the newest ``keep`` and what failed writes left with
    numbers up to the oldest kept; names of the deleted.

    A pointer goes before its tables, so a version is never current while it is incomplete.  Readers
    pinned to a deleted version fail; keep as many versions as they need."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    base = directory.rstrip("/")
    done = _committed(spark, base)
    kept = done[-keep:]
    if not kept:
        return []
    fs, folder = _fs(spark, f"{base}/{_VERSIONS}")
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
    gone = [n for n in names if int(n.split("-")[0]) <= kept[0][0] and n not in {v for _, v in kept}]
    for n in gone:
        for part in (_POINTERS, _VERSIONS):
            fs_, p = _fs(spark, f"{base}/{part}/{n}")
            fs_.delete(p, True)
    return gone


def cleanup_store(spark: SparkSession, directory: str) -> bool:
    """Delete the persisted store (recursive); False when absent."""
    fs, p = _fs(spark, directory)
    return bool(fs.exists(p)) and bool(fs.delete(p, True))


def write_report(df: DataFrame, path: str) -> None:
    """Evaluation report as CSV with a header (no index column)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read an S8 report back with the writer's quoting and whitespace rules."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .schema(schema).csv(path))


def export_chart_data(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S9 re-aimed: write a chart's data; unknown formats raise."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    getattr(w, fmt)(path)
