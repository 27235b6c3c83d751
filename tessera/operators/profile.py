"""Metadata, profiling and validation.

Column-wise measures are one wide aggregation turned into long rows with
``inline``; value counts are a long-form ``groupBy(column, value)``.  Plan
size grows with the number of columns, never columns x rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window


def _c(name):
    return F.col(f"`{name}`")


def column_roles(df: DataFrame) -> dict:
    """date = name contains 'date'; numeric = numeric type; categorical
    = the rest (a numeric column named '...date...' is in both lists)."""
    date = [c for c in df.columns if "date" in c.lower()]
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    cat = [c for c in df.columns if c not in num and c not in date]
    return {"date": date, "numeric": num, "categorical": cat}


def metadata(df: DataFrame) -> DataFrame:
    """One row: rows, columns, names, role lists."""
    r = column_roles(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
        F.lit(",".join(r["date"])).alias("date_columns"),
        F.lit(",".join(r["numeric"])).alias("numeric_columns"),
        F.lit(",".join(r["categorical"])).alias("categorical_columns"))


def column_info(df: DataFrame) -> DataFrame:
    """(column, type, non_null, nulls, pos) from one aggregation."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(_c(c)).alias(f"nn{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                      F.lit(i).alias("pos"), F.col(f"nn{i}").alias("non_null"),
                      (F.col("_rows") - F.col(f"nn{i}")).alias("nulls"))
             for i, (c, f) in enumerate(zip(df.columns, df.schema.fields))]
    return wide.select(F.inline(F.array(*items)))


def date_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Earliest, latest and whole-day span per date column; columns
    without a valid date give no row."""
    cols = columns if columns is not None else column_roles(df)["date"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, earliest string, latest string, span_days bigint")

    def as_date(c):
        t = df.schema[c].dataType
        if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
            return _c(c).cast("date")
        return F.to_date(F.try_to_timestamp(_c(c).cast("string"), F.lit("yyyy-MM-dd")))
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(as_date(c)).alias(f"lo{i}"), F.max(as_date(c)).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").cast("string").alias("earliest"),
                      F.col(f"hi{i}").cast("string").alias("latest"),
                      F.datediff(F.col(f"hi{i}"), F.col(f"lo{i}")).cast("bigint").alias("span_days"))
             for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*items))).where(F.col("earliest").isNotNull())


def categorical_topn(df: DataFrame, columns: list[str] | None = None, first: int = 5,
                     max_distinct: int = 100, top: int = 10) -> DataFrame:
    """For the first ``first`` categorical columns with
    0 < distinct < ``max_distinct``, the ``top`` values by count (count
    desc, value asc).  (column, value, n, rank)."""
    cols = (columns if columns is not None else column_roles(df)["categorical"])[:first]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, rank bigint")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in cols])))
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    keep = (counts.groupBy("column").agg(F.count(F.lit(1)).alias("nd"))
                  .where((F.col("nd") > 0) & (F.col("nd") < max_distinct)).select("column"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(keep, "column", "left_semi")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row in every column (NULLs equal); one row out.

    Rows are first counted by a 128-bit fingerprint (two 64-bit hashes of values and NULL marks), so
    16 bytes a row are shuffled.  Whole rows are compared only where fingerprints meet; both counts
    are partial-aggregated, so a row repeated a third of the time is no hot key.  Without repeats
    nothing meets and the second scan is dropped at run time."""
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    marks = [F.col(n).isNull() for n in names]
    # a hash skips NULLs, so the marks tell (NULL, x) from (x, NULL)
    marked = rows.select("*", F.xxhash64(*names, *marks).alias("f1"), F.xxhash64(F.lit("2"), *marks, *names[::-1]).alias("f2"))
    met = marked.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f1", "f2")
    g = marked.join(met, ["f1", "f2"], "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def validate(df: DataFrame, high_null_pct: float = 50.0) -> DataFrame:
    """Every check as a row (check, column, value, flagged,
    message); flagged rows are the reference's issue list.

    One aggregation counts rows and NULLs of all columns and gives both checks of each
    as rows; the duplicates are counted beside it (``duplicate_rows``)."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(_c(c)).alias(f"nn{i}") for i, c in enumerate(df.columns)])
    checks = []
    for i, c in enumerate(df.columns):
        nulls = F.col("_rows") - F.col(f"nn{i}")
        pct = F.try_divide(nulls * F.lit(100.0), F.col("_rows"))
        checks += [F.struct(F.lit("empty_column").alias("check"), F.lit(c).alias("column"), nulls.cast("double").alias("value"),
                            ((F.col(f"nn{i}") == 0) & (F.col("_rows") > 0)).alias("flagged")),
                   F.struct(F.lit("null_percent").alias("check"), F.lit(c).alias("column"), pct.alias("value"),
                            (F.coalesce(pct, F.lit(0.0)) > high_null_pct).alias("flagged"))]
    dup = duplicate_rows(df).select(F.lit("duplicate_rows").alias("check"), F.lit(None).cast("string").alias("column"),
                                    F.col("duplicate_rows").cast("double").alias("value"),
                                    (F.col("duplicate_rows") > 0).alias("flagged"))
    out = wide.select(F.inline(F.array(*checks))).unionByName(dup)
    msg = (F.when(F.col("check") == "empty_column", F.concat(F.lit("Empty column: "), F.col("column")))
            .when(F.col("check") == "null_percent",
                  F.concat(F.lit(f"Column with >{high_null_pct:g}% missing values: "), F.col("column")))
            .otherwise(F.concat(F.lit("Found "), F.col("value").cast("bigint").cast("string"),
                                F.lit(" duplicate rows"))))
    return out.withColumn("message", F.when(F.col("flagged"), msg))


def browse(df: DataFrame, n: int = 20, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows under a declared total order
    (TakeOrderedAndProject: per-partition top-n, then a merge)."""
    return df.orderBy(*[_c(c) for c in (order or df.columns)]).limit(n)
