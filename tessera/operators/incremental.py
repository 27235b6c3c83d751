"""Group documents kept up to date as files arrive (D2-D5 as a maintained view).

``apply_files`` takes the files that arrived, changed or went and brings the
documents of ``documents.group_documents`` up to date without reading the other
files again.

State, in one folder:

* ``partials/batch=<id>``: the partial states of the files of one update, a row for each file and group: rows, and
  for each numeric column the count, the exact sum, how many values that sum holds, and the sum in doubles.  Written
  once, never changed.
* a versioned store (``sources.store``) of ``files`` (which batch holds a
  file's state), ``groups`` (states of all groups), ``documents`` and the
  ``shape`` of the files.  A version counts once its pointer is written, so a
  failed update leaves the last one, and readers of a version see its tables together.

An update aggregates the new content, takes the replaced files' stored partials
with the sign -1, adds both to the stored groups and renders the groups of that
delta; all other documents are carried over as they are.  Sums in decimals are
exact, so adding and taking away leaves no trace.  Where a group holds a value
that a decimal cannot (its sum is in doubles then), that column's sums of the
touched groups are added up again from the partials of all files.

One writer at a time: of two updates at once the later pointer wins and the
other's files are missing from it.  File names, keys and states stay in Spark.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rolling import materialize
from ..sources.store import read_store, store_version, write_store
from . import documents, stats

_KEY = ["doc_type", "key"]
_PARTS = ("n", "k", "t", "f")    # values, values in the exact sum, exact sum, sum in doubles
_NAMED = "key is not null and (doc_type = 'time_period' or trim(key) <> '')"


def _state_columns(num: list[str]) -> list[str]:
    return ["n_rows"] + [f"{p}{i}" for i in range(len(num)) for p in _PARTS]


def _partial(df: DataFrame, num: list[str], kinds: list, file_col: str) -> DataFrame:
    """(file, doc_type, key, state) of every group, rows without a key included."""
    keys = [F.struct(F.lit(kind).alias("doc_type"), key.alias("key")) for kind, _, _, key in kinds]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i in range(len(num)):
        v = stats.present(F.col(f"_v{i}"))
        d = v.try_cast(stats.EXACT)
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(d.cast("double") == v.cast("double")).alias(f"k{i}"),
                 F.coalesce(F.sum(d), F.lit(0)).cast(stats.EXACT).alias(f"t{i}"),
                 F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias(f"f{i}")]
    name = F.coalesce(F.col(file_col), F.raise_error(F.lit("A row without a file name")).cast("string"))
    rows = df.select(name.alias("file"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"_v{i}") for i, c in enumerate(num)],
                     F.explode(F.array(*keys)).alias("g")).select("*", "g.doc_type", "g.key")
    return rows.groupBy("file", *_KEY).agg(*aggs)


def _sum(states: DataFrame, num: list[str]) -> DataFrame:
    return states.groupBy(*_KEY).agg(*[
        (F.sum(c).cast(stats.EXACT) if c[0] == "t" else F.sum(c)).alias(c) for c in _state_columns(num)])


def _render(groups: DataFrame, kinds: list, num: list[str]) -> DataFrame:
    """Documents (doc_type, key, n_rows, page_content) of group states."""
    g = groups
    for i in range(len(num)):
        exact = F.when(F.col(f"n{i}") > 0, F.col(f"t{i}").cast("double"))
        g = (g.withColumn(f"_t{i}", F.when(F.col(f"k{i}") == F.col(f"n{i}"), exact).otherwise(F.col(f"f{i}")))
              .withColumn(f"_n{i}", F.col(f"n{i}")))
    text = F.lit(None).cast("string")
    for kind, title, source, _ in kinds:
        text = F.when(F.col("doc_type") == kind, documents.group_text(title, F.col("key"), num, source)).otherwise(text)
    return g.select(*_KEY, "n_rows", text.alias("page_content"))


def _partials(spark: SparkSession, directory: str, num: list[str]) -> DataFrame:
    states = "".join(f", n{i} long, k{i} long, t{i} {stats.EXACT}, f{i} double" for i in range(len(num)))
    return spark.read.schema(f"file string, doc_type string, key string, n_rows long{states}, batch string").parquet(f"{directory}/partials")


def apply_files(spark: SparkSession, directory: str, arrived: DataFrame | None = None, file_col: str = "file",
                removed: DataFrame | None = None, roles: dict | None = None) -> int:
    """Bring the documents up to date; the number of documents rendered comes back.

    ``arrived`` holds the rows of all files that arrived or changed, with the
    file's name in ``file_col``: a name the state knows replaces that file, other
    files stay.  ``removed`` names files that went, in a column ``file``; unknown
    names and files that also arrive are passed over.  All files need the same
    columns and roles (an error otherwise), and every row a name."""
    base = directory.rstrip("/")
    now = store_version(spark, base)
    if arrived is None and (now is None or removed is None):
        raise ValueError("No files to make documents of")
    files = read_store(spark, base, "files", now) if now else spark.createDataFrame([], "file string, batch string")
    shape = json.loads(read_store(spark, base, "shape", now).first()["shape"]) if now else None
    if arrived is not None:
        got = [list(x) for x in arrived.drop(file_col).dtypes]
        if shape not in (None, got):
            raise ValueError("All files need the same columns")
        shape = got
    content = arrived.drop(file_col) if arrived is not None else spark.createDataFrame(
        [], ", ".join("`" + c.replace("`", "``") + f"` {t}" for c, t in shape))
    num, kinds = stats.numeric_columns(content), documents.group_keys(content, roles)
    if not kinds:
        raise ValueError("No date, product or region column")
    cols, batch = _state_columns(num), uuid.uuid4().hex
    if arrived is not None:
        _partial(arrived, num, kinds, file_col).write.parquet(f"{base}/partials/batch={batch}")
    stored = _partials(spark, base, num)
    new = stored.where(F.col("batch") == batch)
    changed = new.select("file").distinct()
    if removed is not None:
        changed = changed.unionByName(removed.select("file")).distinct()
    replaced = files.join(changed, "file", "left_semi")
    listed = files.join(changed, "file", "left_anti").unionByName(
        new.select("file").distinct().withColumn("batch", F.lit(batch)))
    minus = stored.join(replaced, ["batch", "file"], "left_semi").select(
        *_KEY, *[(-F.col(c)).cast(stored.schema[c].dataType).alias(c) for c in cols])
    delta = materialize(_sum(new.select(*_KEY, *cols).unionByName(minus).where(_NAMED), num))

    groups = read_store(spark, base, "groups", now) if now else delta.limit(0)
    ours = groups.join(delta.select(*_KEY), _KEY, "left_semi")
    # a group whose last row went has no document
    touched = _sum(ours.unionByName(delta), num).where("n_rows > 0")
    if now and num:
        # sums in doubles cannot be taken back: those still needed are added up again, the others start from the exact sum
        rough = touched.where(" or ".join(f"k{i} <> n{i}" for i in range(len(num)))).select(*_KEY)
        live = stored.join(listed, ["batch", "file"], "left_semi").join(rough, _KEY, "left_semi")
        again = live.groupBy(*_KEY).agg(*[F.sum(f"f{i}").alias(f"g{i}") for i in range(len(num))])
        sums = {f"f{i}": F.when(F.col(f"k{i}") == F.col(f"n{i}"), F.col(f"t{i}").cast("double")).otherwise(F.col(f"g{i}"))
                for i in range(len(num))}
        touched = touched.join(again, _KEY, "left").select(*_KEY, *[sums.get(c, F.col(c)).alias(c) for c in cols])
    touched = materialize(touched)
    groups = groups.join(delta.select(*_KEY), _KEY, "left_anti").unionByName(touched)
    rendered = _render(touched, kinds, num).withColumn("version", F.lit(batch))
    if now:
        rendered = read_store(spark, base, "documents", now).join(delta.select(*_KEY), _KEY, "left_anti").unionByName(rendered)
    write_store(base, files=listed, groups=groups, documents=rendered,
                shape=spark.createDataFrame([(json.dumps(shape),)], "shape string"))
    return touched.count()


def group_documents(spark: SparkSession, directory: str) -> DataFrame:
    """The documents of the current version: (doc_type, key, n_rows, page_content)."""
    return read_store(spark, directory, "documents").select("doc_type", "key", "n_rows", "page_content")
