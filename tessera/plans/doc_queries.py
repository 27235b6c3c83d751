"""Registered document queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import documents, incremental
from ..session import ensure_checkpoint_dir
from ..sources.tables import SALES_ROLES, sales_view
from .oracle import fixed, with_sales, xavg, xsum
from .registry import register

_NUM = ["acctbal", "quantity", "sales"]
_TXT = [("order_date", "strftime(order_date, '%Y-%m-%d')"), ("product", "product"),
        ("region", "region"), ("segment", "segment")]
_COLS = "order_date, product, region, segment, acctbal, quantity, sales"

_SUMMARY_CTES = [
    "num AS (SELECT string_agg(l, '' ORDER BY pos) AS t FROM (" + " UNION ALL ".join(
        f"""SELECT {i} AS pos, chr(10) || '{c}: Mean=' || {fixed(xavg(c))}
               || ', Median=' || {fixed(f'MEDIAN(CAST({c} AS DOUBLE))')}
               || ', Std=' || {fixed(f'STDDEV_SAMP(CAST({c} AS DOUBLE))')}
               || ', Min=' || {fixed(f'MIN(CAST({c} AS DOUBLE))')}
               || ', Max=' || {fixed(f'MAX(CAST({c} AS DOUBLE))')} AS l FROM sales"""
        for i, c in enumerate(_NUM)) + "))",
    "long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS col, {i} AS pos, {e} AS value FROM sales" for i, (c, e) in enumerate(_TXT)) + ")",
    "cnt AS (SELECT col, pos, value, COUNT(*) AS n FROM long WHERE value IS NOT NULL GROUP BY col, pos, value)",
    "dis AS (SELECT col, pos, COUNT(*) AS nd FROM cnt GROUP BY col, pos)",
    """top AS (SELECT col, string_agg(value || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rk) AS tv
              FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY n DESC, value) AS rk FROM cnt)
              WHERE rk <= 3 GROUP BY col)""",
    """txt AS (SELECT string_agg(chr(10) || d.col || ': ' || CAST(d.nd AS VARCHAR)
                               || ' unique values. Top values: ' || COALESCE(tv, ''), '' ORDER BY d.pos) AS t
              FROM dis d LEFT JOIN top USING (col))""",
    f"""summary AS (SELECT 'summary' AS doc_type, 'dataframe' AS key,
          'Dataset Overview:' || chr(10) || 'Total Records: ' || CAST((SELECT COUNT(*) FROM sales) AS VARCHAR)
          || chr(10) || 'Columns: {_COLS}' || chr(10) || chr(10) || 'Numeric Columns Statistics:'
          || (SELECT t FROM num) || chr(10) || chr(10) || 'Text/Categorical Columns:'
          || (SELECT t FROM txt) AS page_content)""",
]

_GROUP_CTES = [
    """b AS (SELECT strftime(date_trunc('month', order_date), '%Y-%m') AS km,
                  product AS kp, region AS kr, acctbal, quantity, sales FROM sales)""",
    "g AS (SELECT km, kp, kr, GROUPING(km, kp, kr) AS gid, COUNT(*) AS n_rows, " + ", ".join(
        f"{xsum(c)} AS t{i}, COUNT({c}) AS n{i}" for i, c in enumerate(_NUM))
    + " FROM b GROUP BY GROUPING SETS ((km), (kp), (kr)))",
    "groups AS (" + " UNION ALL ".join(
        f"""SELECT '{kind}' AS doc_type, {k} AS key, n_rows,
               concat_ws(chr(10), '{title}' || {k}, 'Records: ' || CAST(n_rows AS VARCHAR), """
        + ", ".join(f"'{c}: Total=' || {fixed(f'COALESCE(t{i}, 0.0)')} || ', Average=' || {fixed(f't{i} / n{i}')}"
                    for i, c in enumerate(_NUM))
        + f") AS page_content FROM g WHERE gid = {gid} AND {k} IS NOT NULL {extra}"
        for kind, k, title, gid, extra in [
            ("time_period", "km", "Time Period: ", 3, ""),
            ("product", "kp", "Product: ", 5, "AND trim(kp) <> ''"),
            ("region", "kr", "Region: ", 6, "AND trim(kr) <> ''")]) + ")",
]


@register("doc_summary", with_sales("SELECT * FROM summary", *_SUMMARY_CTES))
def q_doc_summary(spark, sf_dir):
    return documents.summary_document(sales_view(spark, sf_dir, materialized=True))


@register("doc_groups", with_sales("SELECT * FROM groups", *_GROUP_CTES))
def q_doc_groups(spark, sf_dir):
    return documents.group_documents(sales_view(spark, sf_dir), SALES_ROLES)


@register("doc_corpus", with_sales("""
SELECT doc_type, key, n_rows, page_content,
       CASE doc_type WHEN 'summary' THEN 0 WHEN 'time_period' THEN 1 WHEN 'product' THEN 2 ELSE 3 END AS part,
       doc_type || ':' || key AS doc_id
FROM (SELECT doc_type, key, CAST(NULL AS BIGINT) AS n_rows, page_content FROM summary
      UNION ALL SELECT * FROM groups)""", *_SUMMARY_CTES, *_GROUP_CTES))
def q_doc_corpus(spark, sf_dir):
    return documents.corpus(sales_view(spark, sf_dir, materialized=True), SALES_ROLES)


@register("doc_groups_incremental", with_sales("SELECT * FROM groups", *_GROUP_CTES))
def q_doc_groups_incremental(spark, sf_dir):
    """The documents of ``doc_groups`` after three arrivals, the second of them with wrong quantities, and its replacement."""
    sales = sales_view(spark, sf_dir, materialized=True)
    at = F.pmod(F.xxhash64(*sales.columns), F.lit(3))
    files = sales.withColumn("file", F.concat(F.lit("part-"), at.cast("string")))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents/{uuid.uuid4().hex}"
    part = lambda i: files.where(F.col("file") == f"part-{i}")
    wrong = part(1).withColumn("quantity", F.col("quantity") + 1).withColumn("region", F.lit("NOWHERE"))
    for arrived in (part(0), wrong, part(2), part(1)):
        incremental.apply_files(spark, folder, arrived, roles=SALES_ROLES)
    return incremental.group_documents(spark, folder)
