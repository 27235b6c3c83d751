"""Registered statistics queries (A1-A13) over the canonical sales view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources.tables import SALES_ROLES, read_table, sales_view
from .oracle import fixed, money, with_sales, xavg
from .registry import register

R = SALES_ROLES


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


@register("regional_statistics", with_sales("""
SELECT region, CAST(SUM(sales) AS DOUBLE) AS total_sales,
       CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sale,
       COUNT(*) AS n_rows,
       (SELECT COUNT(DISTINCT region) FROM sales) AS n_regions
FROM sales WHERE region IS NOT NULL GROUP BY region"""))
def q_regional_statistics(spark, sf_dir):
    return stats.regional_statistics(sales_view(spark, sf_dir), R["region"], R["sales"])


@register("regional_frequency", with_sales("""
SELECT region, COUNT(*) AS n_rows, (SELECT COUNT(DISTINCT region) FROM sales) AS n_regions
FROM sales WHERE region IS NOT NULL GROUP BY region"""))
def q_regional_frequency(spark, sf_dir):
    return stats.regional_statistics(sales_view(spark, sf_dir), R["region"], use_sales=False)


@register("sales_statistics", with_sales(f"""
SELECT total_sales, median_sale, ROUND(std_sale, 6) AS std_sale, min_sale, max_sale,
       total_transactions, avg_sale,
       'Sales Statistics:' || chr(10) ||
       'Total Sales: ' || {money('total_sales')} || chr(10) ||
       'Average Sale: ' || {money('avg_sale')} || chr(10) ||
       'Median Sale: ' || {money('median_sale')} || chr(10) ||
       'Standard Deviation: ' || {money('std_sale')} || chr(10) ||
       'Minimum Sale: ' || {money('min_sale')} || chr(10) ||
       'Maximum Sale: ' || {money('max_sale')} || chr(10) ||
       'Total Transactions: ' || CAST(total_transactions AS VARCHAR) AS page_content
FROM (SELECT CAST(SUM(sales) AS DOUBLE) AS total_sales,
             CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sale,
             MEDIAN(CAST(sales AS DOUBLE)) AS median_sale,
             STDDEV_SAMP(CAST(sales AS DOUBLE)) AS std_sale,
             CAST(MIN(sales) AS DOUBLE) AS min_sale, CAST(MAX(sales) AS DOUBLE) AS max_sale,
             COUNT(*) AS total_transactions FROM sales) t"""))
def q_sales_statistics(spark, sf_dir):
    df = stats.sales_statistics(sales_view(spark, sf_dir, materialized=True), R["sales"])
    return df.select("total_sales", "median_sale", _r6("std_sale"), "min_sale", "max_sale",
                     "total_transactions", "avg_sale", "page_content")


_PRODUCT_GROUPS = """
g AS (SELECT product, CAST(SUM(sales) AS DOUBLE) AS total_sales, COUNT(sales) AS n_s,
             COUNT(*) AS n_rows
      FROM sales WHERE product IS NOT NULL GROUP BY product)"""


@register("product_statistics", with_sales("""
SELECT product, total_sales, n_rows, total_sales / n_s AS avg_sale,
       ROW_NUMBER() OVER (ORDER BY total_sales DESC, product) AS rank,
       (SELECT COUNT(*) FROM g) AS n_products
FROM g ORDER BY total_sales DESC, product LIMIT 5""", _PRODUCT_GROUPS))
def q_product_statistics(spark, sf_dir):
    return stats.product_statistics(sales_view(spark, sf_dir), R["product"], R["sales"], top=5)


@register("product_frequency", with_sales("""
SELECT product, n_rows, ROW_NUMBER() OVER (ORDER BY n_rows DESC, product) AS rank,
       (SELECT COUNT(*) FROM g) AS n_products
FROM g ORDER BY n_rows DESC, product LIMIT 5""", _PRODUCT_GROUPS))
def q_product_frequency(spark, sf_dir):
    return stats.product_statistics(sales_view(spark, sf_dir), R["product"], top=5, use_sales=False)


@register("customer_numeric", with_sales(f"""
SELECT ROUND(avg_age, 6) AS avg_age, median_age, min_age, max_age,
       chr(10) || 'Age Demographics:' || chr(10) || 'Average Age: ' || {fixed('avg_age', 1)} ||
       chr(10) || 'Median Age: ' || {fixed('median_age', 1)} ||
       chr(10) || 'Age Range: ' || {fixed('min_age', 0)} || ' - ' || {fixed('max_age', 0)} || chr(10)
       AS page_content
FROM (SELECT {xavg('acctbal')} AS avg_age, MEDIAN(CAST(acctbal AS DOUBLE)) AS median_age,
             MIN(CAST(acctbal AS DOUBLE)) AS min_age, MAX(CAST(acctbal AS DOUBLE)) AS max_age
      FROM sales) t"""))
def q_customer_numeric(spark, sf_dir):
    df = stats.customer_numeric(sales_view(spark, sf_dir, materialized=True), R["age"])
    return df.select(_r6("avg_age"), "median_age", "min_age", "max_age", "page_content")


@register("customer_share", with_sales("""
SELECT segment AS value, COUNT(*) AS n_rows,
       COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sales) AS pct
FROM sales WHERE segment IS NOT NULL GROUP BY segment"""))
def q_customer_share(spark, sf_dir):
    return stats.customer_share(sales_view(spark, sf_dir), R["gender"])


@register("time_range", with_sales("""
SELECT CAST(MIN(order_date) AS VARCHAR) AS earliest, CAST(MAX(order_date) AS VARCHAR) AS latest,
       COUNT(*) AS n_dated, CAST(MAX(order_date) - MIN(order_date) AS BIGINT) AS span_days
FROM sales WHERE order_date IS NOT NULL"""))
def q_time_range(spark, sf_dir):
    df = stats.time_range(sales_view(spark, sf_dir), R["date"])
    return df.select(F.col("earliest").cast("string").alias("earliest"),
                     F.col("latest").cast("string").alias("latest"), "n_dated", "span_days")


@register("monthly_summary", with_sales("""
SELECT CAST(SUM(t) AS DOUBLE) / COUNT(*) AS avg_monthly_sales,
       (SELECT strftime(m, '%Y-%m') FROM mt ORDER BY t DESC, m LIMIT 1) AS best_month,
       CAST(MAX(t) AS DOUBLE) AS best_month_sales,
       (SELECT strftime(m, '%Y-%m') FROM mt ORDER BY t ASC, m LIMIT 1) AS worst_month,
       CAST(MIN(t) AS DOUBLE) AS worst_month_sales,
       COUNT(*) AS n_months
FROM mt""", """
mt AS (SELECT date_trunc('month', order_date) AS m, SUM(sales) AS t
       FROM sales WHERE order_date IS NOT NULL GROUP BY 1)"""))
def q_monthly_summary(spark, sf_dir):
    return stats.monthly_summary(sales_view(spark, sf_dir), R["date"], R["sales"])


_GEN_COLS = ["acctbal", "quantity", "sales"]


@register("general_statistics", with_sales(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {i} AS pos, ROUND({xavg(c)}, 6) AS mean,
        MEDIAN(CAST({c} AS DOUBLE)) AS median, ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std,
        MIN(CAST({c} AS DOUBLE)) AS min, MAX(CAST({c} AS DOUBLE)) AS max FROM sales"""
    for i, c in enumerate(_GEN_COLS))))
def q_general_statistics(spark, sf_dir):
    df = stats.general_statistics(sales_view(spark, sf_dir, materialized=True))
    return df.select("column", F.col("pos").cast("int").alias("pos"), _r6("mean"), "median",
                     _r6("std"), "min", "max")


_FACTS_SQL = """
facts AS (
  SELECT COUNT(*) AS n_rows, CAST(SUM(sales) AS DOUBLE) AS total_sales,
         CAST(SUM(sales) AS DOUBLE) / COUNT(sales) AS avg_sale,
         COUNT(DISTINCT product) AS n_products, COUNT(DISTINCT region) AS n_regions,
         (SELECT product FROM sales WHERE product IS NOT NULL GROUP BY product
          ORDER BY SUM(sales) DESC, product LIMIT 1) AS top_product
  FROM sales)"""


@register("ground_truth", with_sales("SELECT * FROM facts", _FACTS_SQL))
def q_ground_truth(spark, sf_dir):
    return stats.table_facts(sales_view(spark, sf_dir, materialized=True), R)


def _user_turns(spark, sf_dir):
    return (read_table(spark, sf_dir, "conversations")
            .where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question")))


_QUICK_SQL = f"""
SELECT conv_id, turn,
  concat_ws(chr(10),
    'Total Records: ' || CAST(f.n_rows AS VARCHAR),
    CASE WHEN lower(text) LIKE '%sales%' OR lower(text) LIKE '%revenue%'
         THEN 'Total Sales: $' || {money('f.total_sales')} END,
    CASE WHEN lower(text) LIKE '%sales%' OR lower(text) LIKE '%revenue%'
         THEN 'Average Sale: $' || {money('f.avg_sale')} END,
    CASE WHEN lower(text) LIKE '%product%' THEN 'Total Products: ' || CAST(f.n_products AS VARCHAR) END,
    CASE WHEN lower(text) LIKE '%region%' OR lower(text) LIKE '%location%'
         THEN 'Total Regions: ' || CAST(f.n_regions AS VARCHAR) END) AS statistics
FROM conversations, facts f WHERE role = 'user'"""


@register("quick_statistics", with_sales(_QUICK_SQL, _FACTS_SQL))
def q_quick_statistics(spark, sf_dir):
    facts = stats.table_facts(sales_view(spark, sf_dir, materialized=True), R)
    out = stats.quick_statistics(_user_turns(spark, sf_dir), "question", facts, R)
    return out.select("conv_id", "turn", "statistics")


@register("quick_statistics_simple", with_sales(f"""
SELECT conv_id, turn,
  concat_ws(chr(10),
    'Total Records: ' || CAST(f.n_rows AS VARCHAR),
    CASE WHEN lower(text) LIKE '%sales%' OR lower(text) LIKE '%revenue%'
         THEN 'Total Sales: $' || {money('f.total_sales')} END) AS statistics
FROM conversations, facts f WHERE role = 'user'""", _FACTS_SQL))
def q_quick_statistics_simple(spark, sf_dir):
    """The simpler chain's statistics (rows and total sales only)."""
    facts = stats.table_facts(sales_view(spark, sf_dir, materialized=True), R)
    out = stats.quick_statistics(_user_turns(spark, sf_dir), "question", facts, R, simple=True)
    return out.select("conv_id", "turn", "statistics")
