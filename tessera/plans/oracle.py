"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on the pre-registered fixture views.  Column names and
value types line up with the Spark results: sums over DECIMAL cast to
double at the end, means as sum / count, floating statistics that depend
on summation order rounded to 6 places, numbers in text through
``format('{:,.2f}', x)`` (same half-even rendering as ``format_number``).
"""

from __future__ import annotations

SALES_CTE = """
sales AS (
  SELECT CAST(o_orderdate AS DATE) AS order_date,
         p_name AS product, r_name AS region,
         c_mktsegment AS segment, c_acctbal AS acctbal,
         l_quantity AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2))
           * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS sales
  FROM lineitem
  JOIN orders   ON l_orderkey = o_orderkey
  JOIN part     ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation   ON c_nationkey = n_nationkey
  JOIN region   ON n_regionkey = r_regionkey
)"""


def with_sales(body: str, *more_ctes: str) -> str:
    ctes = ",\n".join([SALES_CTE, *more_ctes])
    return f"WITH {ctes}\n{body}"


def money(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) THEN 'nan' ELSE format('{{:,.2f}}', {x}) END"


def fixed(x: str, d: int = 2) -> str:
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) THEN 'nan' ELSE format('{{:.{d}f}}', {x}) END"


def xsum(x: str) -> str:
    """Compensated double sum, rounded far below the digits the queries show."""
    return f"ROUND(fsum(CAST({x} AS DOUBLE)), 6)"


def xavg(x: str) -> str:
    return f"(fsum(CAST({x} AS DOUBLE)) / COUNT({x}))"
