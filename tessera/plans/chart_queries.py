"""Registered chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chartdata, wide_correlation
from ..sources.tables import SALES_ROLES, read_fact, read_table, sales_view
from .oracle import with_sales, xavg
from .registry import register

R = SALES_ROLES

_LABEL_SQL = {
    "d": "strftime(order_date, '%Y-%m-%d')",
    "w": "strftime(date_trunc('week', order_date), '%Y-%m-%d') || '/' || "
         "strftime(CAST(date_trunc('week', order_date) AS DATE) + 6, '%Y-%m-%d')",
    "m": "strftime(order_date, '%Y-%m')",
    "q": "CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR)",
    "y": "strftime(order_date, '%Y')",
}


def _trend(p):
    def q(spark, sf_dir):
        return chartdata.sales_trend(sales_view(spark, sf_dir), R["date"], R["sales"], p.upper())
    return q


for _p, _lab in _LABEL_SQL.items():
    register(f"sales_trend_{_p}", with_sales(f"""
SELECT {_lab} AS period, CAST(SUM(sales) AS DOUBLE) AS total_sales
FROM sales WHERE order_date IS NOT NULL GROUP BY 1"""))(_trend(_p))


@register("product_topn", with_sales("""
SELECT product, ROW_NUMBER() OVER (ORDER BY t DESC, product) AS rank, t AS total_sales
FROM (SELECT product, CAST(SUM(sales) AS DOUBLE) AS t FROM sales
      WHERE product IS NOT NULL GROUP BY product)
ORDER BY t DESC, product LIMIT 10"""))
def q_product_topn(spark, sf_dir):
    return chartdata.product_topn(sales_view(spark, sf_dir), R["product"], R["sales"], 10)


@register("product_topn_count", with_sales("""
SELECT product, ROW_NUMBER() OVER (ORDER BY n DESC, product) AS rank, n AS n_rows
FROM (SELECT product, COUNT(*) AS n FROM sales WHERE product IS NOT NULL GROUP BY product)
ORDER BY n DESC, product LIMIT 10"""))
def q_product_topn_count(spark, sf_dir):
    return chartdata.product_topn(sales_view(spark, sf_dir), R["product"], top_n=10, by_count=True)


@register("region_analysis", with_sales("""
SELECT region, CAST(SUM(sales) AS DOUBLE) AS total_sales, COUNT(*) AS n_rows,
       CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sale
FROM sales WHERE region IS NOT NULL GROUP BY region"""))
def q_region_analysis(spark, sf_dir):
    return chartdata.region_analysis(sales_view(spark, sf_dir), R["region"], R["sales"])


@register("region_counts", with_sales("""
SELECT region, COUNT(*) AS n_rows FROM sales WHERE region IS NOT NULL GROUP BY region"""))
def q_region_counts(spark, sf_dir):
    return chartdata.region_analysis(sales_view(spark, sf_dir), R["region"], by_count=True)


@register("histogram", with_sales("""
SELECT bin, lo + (bin - 1) * (hi - lo) / 20 AS bin_lo, lo + bin * (hi - lo) / 20 AS bin_hi,
       COUNT(*) AS n_rows
FROM (SELECT CAST(CASE WHEN hi - lo = 0 THEN 1
                       ELSE LEAST(FLOOR((x - lo) / (hi - lo) * 20) + 1, 20) END AS BIGINT) AS bin,
             lo, hi
      FROM (SELECT CAST(acctbal AS DOUBLE) AS x FROM sales WHERE acctbal IS NOT NULL) v,
           (SELECT MIN(CAST(acctbal AS DOUBLE)) AS lo, MAX(CAST(acctbal AS DOUBLE)) AS hi FROM sales) m) b
GROUP BY bin, lo, hi"""))
def q_histogram(spark, sf_dir):
    return chartdata.histogram(sales_view(spark, sf_dir), R["age"], 20)


@register("gender_pie", with_sales("""
SELECT segment AS value, COUNT(*) AS n_rows, COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sales) / 100.0 AS share
FROM sales WHERE segment IS NOT NULL GROUP BY segment"""))
def q_gender_pie(spark, sf_dir):
    return chartdata.composition(sales_view(spark, sf_dir), R["gender"])


_DESCRIBE_COLS = ["acctbal", "quantity", "sales"]


def _describe_sql(cols, src="sales"):
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        stats = [("count", f"CAST(COUNT({x}) AS DOUBLE)"), ("mean", xavg(c)),
                 ("std", f"STDDEV_SAMP({x})"), ("min", f"MIN({x})"),
                 ("25%", f"QUANTILE_CONT({x}, 0.25)"), ("50%", f"QUANTILE_CONT({x}, 0.5)"),
                 ("75%", f"QUANTILE_CONT({x}, 0.75)"), ("max", f"MAX({x})")]
        for j, (nm, e) in enumerate(stats):
            parts.append(f"SELECT '{c}' AS \"column\", '{nm}' AS stat, {i * 8 + j} AS pos, "
                         f"ROUND({e}, 6) AS value FROM {src}")
    return " UNION ALL ".join(parts)


@register("describe", with_sales(_describe_sql(_DESCRIBE_COLS)))
def q_describe(spark, sf_dir):
    d = chartdata.describe(sales_view(spark, sf_dir, materialized=True), _DESCRIBE_COLS)
    return d.select("column", "stat", F.col("pos").cast("int").alias("pos"),
                    F.round("value", 6).alias("value"))


@register("dashboard", with_sales("""
SELECT 'total_sales' AS panel, 'Total Sales' AS label, CAST(SUM(sales) AS DOUBLE) AS value,
       CAST(1 AS BIGINT) AS rank FROM sales
UNION ALL
SELECT * FROM (SELECT 'top_products', product, t, ROW_NUMBER() OVER (ORDER BY t DESC, product)
               FROM (SELECT product, CAST(SUM(sales) AS DOUBLE) AS t FROM sales
                     WHERE product IS NOT NULL GROUP BY product)
               ORDER BY t DESC, product LIMIT 5)
UNION ALL
SELECT 'region_counts', region, CAST(COUNT(*) AS DOUBLE), CAST(NULL AS BIGINT)
FROM sales WHERE region IS NOT NULL GROUP BY region
UNION ALL
SELECT 'summary', "column" || ':' || stat, value, CAST(pos AS BIGINT) FROM d""",
    "d AS (" + _describe_sql(_DESCRIBE_COLS) + ")"))
def q_dashboard(spark, sf_dir):
    out = chartdata.dashboard(sales_view(spark, sf_dir, materialized=True), R, top_n=5)
    return out.withColumn("value", F.when(F.col("panel") == "summary", F.round("value", 6))
                          .otherwise(F.col("value")))


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    rows = []
    for a in _LI_NUM:
        for b in _LI_NUM:
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                        f"ROUND(CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM lineitem")
    return " UNION ALL ".join(rows)


@register("correlation", _corr_sql())
def q_correlation(spark, sf_dir):
    out = chartdata.correlation(read_fact(spark, sf_dir, "lineitem"), _LI_NUM)
    return out.select("col_a", "col_b", F.round("r", 6).alias("r"))


@register("moving_avg_rows", """
SELECT event_id, value,
  CASE WHEN COUNT(value) OVER w7 = 7 THEN ROUND(AVG(value) OVER w7, 6) END AS ma7,
  CASE WHEN COUNT(value) OVER w30 = 30 THEN ROUND(AVG(value) OVER w30, 6) END AS ma30
FROM events
WINDOW w7 AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def q_moving_avg_rows(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "value")
    out = chartdata.moving_avg_rows(ev, ["ts", "event_id"], "value", (7, 30))
    return out.select("event_id", "value", F.round("ma7", 6).alias("ma7"),
                      F.round("ma30", 6).alias("ma30"))


@register("moving_avg_days", """
SELECT strftime(day, '%Y-%m-%d') AS day, ROUND(daily_total, 6) AS daily_total, n_rows,
  ROUND(AVG(daily_total) OVER (ORDER BY dn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7d,
  ROUND(AVG(daily_total) OVER (ORDER BY dn RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS ma30d
FROM (SELECT CAST(ts AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS dn,
             SUM(value) AS daily_total, COUNT(*) AS n_rows
      FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)""")
def q_moving_avg_days(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("ts", "value")
    out = chartdata.moving_avg_days(ev, "ts", "value", (7, 30))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"),
                      F.round("daily_total", 6).alias("daily_total"), "n_rows",
                      F.round("ma7d", 6).alias("ma7d"), F.round("ma30d", 6).alias("ma30d"))


@register("demographics", with_sales("""
SELECT 'age' AS panel, CAST(bin AS VARCHAR) AS label, COUNT(*) AS n_rows
FROM (SELECT CAST(CASE WHEN hi - lo = 0 THEN 1
                       ELSE LEAST(FLOOR((x - lo) / (hi - lo) * 20) + 1, 20) END AS BIGINT) AS bin
      FROM (SELECT CAST(acctbal AS DOUBLE) AS x FROM sales WHERE acctbal IS NOT NULL) v,
           (SELECT MIN(CAST(acctbal AS DOUBLE)) AS lo, MAX(CAST(acctbal AS DOUBLE)) AS hi FROM sales) m) b
GROUP BY bin
UNION ALL
SELECT 'gender', segment, COUNT(*) FROM sales WHERE segment IS NOT NULL GROUP BY segment"""))
def q_demographics(spark, sf_dir):
    return chartdata.demographics(sales_view(spark, sf_dir), R["age"], R["gender"])


_DIM, _SHIFTS = 64, 8


@register("correlation_wide", f"""
WITH e AS (SELECT row_number() OVER () AS row_no, embedding FROM embeddings),
     x AS (SELECT row_no, i, CAST(embedding[i + 1] AS DOUBLE) AS v
           FROM e, (SELECT unnest(generate_series(0, {_DIM - 1})) AS i)),
     f AS (SELECT row_no, 'v' || i AS c, v FROM x
           UNION ALL
           SELECT a.row_no, 'v' || a.i || '_x' || s, CASE WHEN s < {_SHIFTS - 1} OR a.v > 0 THEN a.v * b.v END
           FROM x a, (SELECT unnest(generate_series(1, {_SHIFTS - 1})) AS s), x b
           WHERE a.row_no = b.row_no AND b.i = (a.i + s) % {_DIM})
SELECT a.c AS col_a, b.c AS col_b, ROUND(CORR(a.v, b.v), 6) AS r
FROM f a JOIN f b USING (row_no) GROUP BY 1, 2""")
def q_correlation_wide(spark, sf_dir):
    """All pairs of 512 columns: the components of each embedding and products of two components, those
    of the last distance only where the first is positive."""
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cols = [v(i).alias(f"v{i}") for i in range(_DIM)]
    for s in range(1, _SHIFTS):
        for i in range(_DIM):
            product = v(i) * v((i + s) % _DIM)
            cols.append((product if s < _SHIFTS - 1 else F.when(v(i) > 0, product)).alias(f"v{i}_x{s}"))
    out = wide_correlation.wide_correlation(read_fact(spark, sf_dir, "embeddings").select(*cols))
    return out.select("col_a", "col_b", F.round("r", 6).alias("r"))
