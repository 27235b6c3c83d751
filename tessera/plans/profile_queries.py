"""Registered ingest and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalize as norm
from ..operators import profile, summary
from ..sources.tables import read_fact, read_table
from .oracle import xavg
from .registry import register

_DUCK_TYPE = ("CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
              "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
              "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({c})) END")


def _as_text(df):
    """The table as an all-text scan would deliver it."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _normalized(spark, sf_dir, table):
    df = norm.normalize(_as_text(read_fact(spark, sf_dir, table)))
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c)
                       for c, t in df.dtypes])


@register("normalize", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def q_normalize(spark, sf_dir):
    return _normalized(spark, sf_dir, "orders")


@register("normalize_customer", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
FROM customer""")
def q_normalize_customer(spark, sf_dir):
    return _normalized(spark, sf_dir, "customer")


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("metadata", f"""
SELECT COUNT(*) AS n_rows, CAST({len(_LI_COLS)} AS BIGINT) AS n_columns,
       '{",".join(_LI_COLS)}' AS column_names, 'l_shipdate' AS date_columns,
       '{",".join(_LI_COLS[:8])}' AS numeric_columns, 'l_returnflag,l_linestatus' AS categorical_columns
FROM lineitem""")
def q_metadata(spark, sf_dir):
    return profile.metadata(read_table(spark, sf_dir, "lineitem"))


@register("column_info", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT {_DUCK_TYPE.format(c=c)} FROM lineitem LIMIT 1) AS type,
        {i} AS pos, COUNT({c}) AS non_null, COUNT(*) - COUNT({c}) AS nulls FROM lineitem"""
    for i, c in enumerate(_LI_COLS)))
def q_column_info(spark, sf_dir):
    return profile.column_info(read_table(spark, sf_dir, "lineitem")).select(
        "column", "type", F.col("pos").cast("int").alias("pos"), "non_null", "nulls")


@register("date_range", """
SELECT 'o_orderdate' AS "column", CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) AS earliest,
       CAST(CAST(MAX(o_orderdate) AS DATE) AS VARCHAR) AS latest,
       CAST(CAST(MAX(o_orderdate) AS DATE) - CAST(MIN(o_orderdate) AS DATE) AS BIGINT) AS span_days
FROM orders HAVING MIN(o_orderdate) IS NOT NULL""")
def q_date_range(spark, sf_dir):
    return profile.date_ranges(read_table(spark, sf_dir, "orders"))


@register("categorical_topn", """
WITH long AS (SELECT 'p_name' AS "column", p_name AS value FROM part
              UNION ALL SELECT 'p_brand', p_brand FROM part
              UNION ALL SELECT 'p_type', p_type FROM part),
     c AS (SELECT "column", value, COUNT(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
     keep AS (SELECT "column" FROM c GROUP BY 1 HAVING COUNT(*) > 0 AND COUNT(*) < 100)
SELECT "column", value, n, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
WHERE rank <= 10 AND "column" IN (SELECT "column" FROM keep)""")
def q_categorical_topn(spark, sf_dir):
    return profile.categorical_topn(read_table(spark, sf_dir, "part"))


_DUP_SQL = f"""SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY {", ".join(_LI_COLS)})"""


@register("duplicate_rows", _DUP_SQL)
def q_duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(read_table(spark, sf_dir, "lineitem"))


@register("validate", " UNION ALL ".join(
    [f"""SELECT 'empty_column' AS "check", '{c}' AS "column",
               CAST(COUNT(*) - COUNT({c}) AS DOUBLE) AS value,
               COUNT({c}) = 0 AND COUNT(*) > 0 AS flagged,
               CASE WHEN COUNT({c}) = 0 AND COUNT(*) > 0 THEN 'Empty column: {c}' END AS message
        FROM lineitem""" for c in _LI_COLS]
    + [f"""SELECT 'null_percent', '{c}', (COUNT(*) - COUNT({c})) * 100.0 / COUNT(*),
               COALESCE((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 0) > 50,
               CASE WHEN COALESCE((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 0) > 50
                    THEN 'Column with >50% missing values: {c}' END
        FROM lineitem""" for c in _LI_COLS]
    + [f"""SELECT 'duplicate_rows', NULL, CAST(duplicate_rows AS DOUBLE), duplicate_rows > 0,
               CASE WHEN duplicate_rows > 0 THEN 'Found ' || duplicate_rows || ' duplicate rows' END
        FROM ({_DUP_SQL})"""]))
def q_validate(spark, sf_dir):
    return profile.validate(read_table(spark, sf_dir, "lineitem"))


@register("browse", f"""
SELECT * FROM lineitem ORDER BY {", ".join(_LI_COLS)} LIMIT 20""")
def q_browse(spark, sf_dir):
    return profile.browse(read_table(spark, sf_dir, "lineitem"), 20)


def _summary_sql():
    """P5 of the numeric, P6 of the date and P7 of the categorical columns of lineitem."""
    parts = []
    for i, c in enumerate(_LI_COLS[:8]):
        x = f"CAST({c} AS DOUBLE)"
        for j, (stat, e) in enumerate([
                ("count", f"COUNT({c})"), ("mean", xavg(c)), ("std", f"STDDEV_SAMP({x})"), ("min", f"MIN({x})"),
                ("25%", f"QUANTILE_CONT({x}, 0.25)"), ("50%", f"QUANTILE_CONT({x}, 0.5)"),
                ("75%", f"QUANTILE_CONT({x}, 0.75)"), ("max", f"MAX({x})")]):
            parts.append(f"""SELECT 'numeric' AS section, '{c}' AS "column", '{stat}' AS stat, {i * 8 + j} AS pos,
                             ROUND(CAST({e} AS DOUBLE), 6) AS number, NULL AS text FROM lineitem""")
    day = "CAST({f}(l_shipdate) AS DATE)"
    lo, hi = day.format(f="MIN"), day.format(f="MAX")
    for j, (stat, number, text) in enumerate([("earliest", "NULL", f"CAST({lo} AS VARCHAR)"), ("latest", "NULL", f"CAST({hi} AS VARCHAR)"),
                                              ("span_days", f"CAST({hi} - {lo} AS DOUBLE)", "NULL")]):
        parts.append(f"SELECT 'range', 'l_shipdate', '{stat}', {j}, {number}, {text} FROM lineitem HAVING COUNT(l_shipdate) > 0")
    for c in ("l_returnflag", "l_linestatus"):
        parts.append(f"""SELECT 'distribution', '{c}', {c}, CAST(pos AS INTEGER), CAST(n AS DOUBLE), NULL FROM (
            SELECT {c}, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) AS pos, COUNT(*) OVER () AS nd
            FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}) WHERE pos <= 10 AND nd < 100""")
    return " UNION ALL ".join(parts)


@register("summary_statistics", _summary_sql())
def q_summary_statistics(spark, sf_dir):
    """P8 over the whole fact table, in two scans."""
    return summary.summary_statistics(read_fact(spark, sf_dir, "lineitem")).withColumn("number", F.round("number", 6))


_DATE_LOOKS = {"iso": "yyyy-MM-dd", "us": "M/d/yyyy", "dashes": "dd-MM-yyyy", "name": "MMM d, yyyy", "stamp": "yyyy-MM-dd'T'HH:mm:ss"}


@register("normalize_dates", "SELECT o_orderkey AS key, " + ", ".join(
    f"strftime(o_orderdate, '%Y-%m-%d') AS {n}_date" for n in _DATE_LOOKS) + " FROM orders")
def q_normalize_dates(spark, sf_dir):
    """Order dates written in several shapes and read back as dates."""
    o = read_fact(spark, sf_dir, "orders")
    shapes = o.select(F.col("o_orderkey").cast("string").alias("key"),
                      *[F.date_format("o_orderdate", f).alias(f"{n}_date") for n, f in _DATE_LOOKS.items()])
    back = norm.normalize(shapes)
    return back.select("key", *[F.date_format(f"{n}_date", "yyyy-MM-dd").alias(f"{n}_date") for n in _DATE_LOOKS])


@register("csv_scan", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations""")
def q_csv_scan(spark, sf_dir):
    """Conversations written as CSV under the shared folder in two column
    orders (texts hold line breaks) and scanned as one table."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.csv import scan_csv
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    for part, cols in ((0, c.columns), (1, c.columns[::-1])):
        (c.where(F.col("conv_id") % 2 == part).select(*cols).write.mode("append").option("header", True)
          .option("quoteAll", True).option("escape", '"').csv(base))
    return scan_csv(spark, base).select("conv_id", "turn", "role", "text")


@register("describe_text", """
WITH v AS (SELECT 0 AS i, 'c_name' AS "column", c_name AS v FROM customer
           UNION ALL SELECT 1, 'c_mktsegment', c_mktsegment FROM customer),
c AS (SELECT i, "column", v, COUNT(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
s AS (SELECT i, "column", SUM(n) AS total, COUNT(*) AS u, MAX(n) AS freq FROM c GROUP BY ALL),
t AS (SELECT c.i, MIN(v) AS top FROM c JOIN s ON c.i = s.i AND c.n = s.freq GROUP BY c.i)
SELECT "column", stat, CAST(s.i * 4 + p AS INTEGER) AS pos, value FROM s JOIN t ON s.i = t.i,
LATERAL (VALUES ('count', 0, CAST(total AS VARCHAR)), ('unique', 1, CAST(u AS VARCHAR)), ('top', 2, top),
                ('freq', 3, CAST(freq AS VARCHAR))) x(stat, p, value)""")
def q_describe_text(spark, sf_dir):
    from ..operators.chartdata import describe_text
    return describe_text(read_table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))
