"""Statistics extractors over the business table.

Every operator is one declarative aggregation plan.  Grouped results are
pre-aggregated map-side (partial HashAggregate) before the shuffle, so a
key holding a third of all rows costs one partial row per map task, not a
third of the data in one reducer.  Table-wide scalars used next to grouped
rows (distinct counts, totals) are attached as scalar subqueries over the
same grouped plan instead of cross joins.

Money columns may be DECIMAL; sums stay exact and are cast to double only
at the end, means are ``sum / count``.  Sample std of a single row is NULL
(pandas NaN); a sum over nothing is 0 (pandas) via ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from ..functions import fmt
from ..functions.roles import resolve_role, resolve_roles
from ..plans.quantiles import exact_quantiles
from ..plans.rolling import materialize


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _dbl(name: str) -> Column:
    return _c(name).cast("double")


EXACT = "decimal(38,6)"


def present(x: Column) -> Column:
    """``x`` with NaN as missing, as the reference's table library reads it."""
    return F.when(~F.isnan(x.cast("double")), x)


def exact_sum(x: Column) -> Column:
    """Sum that loses no digit of any value.

    Values that a DECIMAL(38,6) holds exactly (money, counts) are summed
    there: exact and independent of the order rows arrive in, so every
    engine and every partitioning renders the same digits.  If a single
    value has more digits or does not fit, the sum is a double sum."""
    v = present(x)
    d = v.try_cast(EXACT)
    kept = F.count_if(d.cast("double") == v.cast("double"))
    return F.when(kept == F.count(v), F.sum(d).cast("double")).otherwise(F.sum(v.cast("double")))


def exact_mean(x: Column) -> Column:
    return F.try_divide(exact_sum(x), F.count(present(x)))


def _total(name: str) -> Column:
    return F.coalesce(exact_sum(_c(name)), F.lit(0.0))


def quantile_literals(df: DataFrame, columns: list[str], probs=(0.5,), approx: bool = False) -> dict:
    """{(column, p): Column literal} of exact quantiles (linear
    interpolation), selected by the distributed refinement plan in
    ``plans.quantiles`` instead of the built-in exact ``percentile``,
    whose final merge holds every distinct value in one task.
    ``approx=True`` uses ``percentile_approx`` (one pass, bounded error)."""
    if not columns:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(_dbl(c), list(probs), 100000).alias(f"q{i}")
                       for i, c in enumerate(columns)]).first()
        vals = {(c, p): (row[f"q{i}"][j] if row[f"q{i}"] else None)
                for i, c in enumerate(columns) for j, p in enumerate(probs)}
    else:
        vals = exact_quantiles(df, list(columns), list(probs))
    return {k: F.lit(v).cast("double") for k, v in vals.items()}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _message(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(text).alias("page_content"))


# --------------------------------------------------------------------- A1
def sales_statistics(df: DataFrame, sales: str | None = None) -> DataFrame:
    """One row: sum, mean, median, sample std, min, max, count of all rows."""
    s = resolve_role(df.columns, "sales", explicit=sales)
    if s is None:
        return _message(df, "No sales data available.")
    out = df.agg(
        _total(s).alias("total_sales"),
        F.count(_c(s)).alias("_n"),
        F.first(quantile_literals(df, [s])[(s, 0.5)]).alias("median_sale"),
        F.stddev_samp(_dbl(s)).alias("std_sale"),
        F.min(_c(s)).cast("double").alias("min_sale"),
        F.max(_c(s)).cast("double").alias("max_sale"),
        F.count(F.lit(1)).alias("total_transactions"),
    ).withColumn("avg_sale", F.try_divide(F.col("total_sales"), F.col("_n"))).drop("_n")
    return out.withColumn("page_content", sales_text())


def sales_text() -> Column:
    """A1 text from columns total_sales, avg_sale, median_sale, std_sale,
    min_sale, max_sale, total_transactions."""
    return F.concat_ws(
        "\n",
        F.lit("Sales Statistics:"),
        F.concat(F.lit("Total Sales: "), fmt.money("total_sales")),
        F.concat(F.lit("Average Sale: "), fmt.money("avg_sale")),
        F.concat(F.lit("Median Sale: "), fmt.money("median_sale")),
        F.concat(F.lit("Standard Deviation: "), fmt.money("std_sale")),
        F.concat(F.lit("Minimum Sale: "), fmt.money("min_sale")),
        F.concat(F.lit("Maximum Sale: "), fmt.money("max_sale")),
        F.concat(F.lit("Total Transactions: "), F.col("total_transactions").cast("string")),
    )


# ------------------------------------------------------------- A2 / A3
def _by_key(df: DataFrame, key: str, sales: str | None) -> DataFrame:
    """Per-key sum / mean / count; NULL keys dropped like pandas groupby."""
    g = df.where(_c(key).isNotNull()).groupBy(_c(key).alias("key"))
    if sales is None:
        return g.agg(F.count(F.lit(1)).alias("n_rows"))
    return (g.agg(_total(sales).alias("total_sales"),
                  F.count(_c(sales)).alias("_n"),
                  F.count(F.lit(1)).alias("n_rows"))
             .withColumn("avg_sale", F.try_divide(F.col("total_sales"), F.col("_n")))
             .drop("_n"))


def _ranked_top(grouped: DataFrame, order_col: str, n: int | None) -> DataFrame:
    """Top-n by ``order_col`` desc, key asc on ties; rank 1..n.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject (per-partition
    top-n, then a merge of n rows per partition): no full sort, no single
    partition holding the grouped table.
    """
    top = grouped.orderBy(F.col(order_col).desc(), F.col("key").asc()).limit(n)
    # the window runs over the n rows left after the limit
    w = F.row_number().over(Window.orderBy(F.col(order_col).desc(), F.col("key").asc()))
    return top.withColumn("rank", w.cast("bigint"))


def product_statistics(df: DataFrame, product: str | None = None, sales: str | None = None,
                       top: int = 5, use_sales: bool = True) -> DataFrame:
    """A2 (by sales) / A3 (by frequency when there is no sales column)."""
    p = resolve_role(df.columns, "product", explicit=product)
    if p is None:
        return _message(df, "No product data available.")
    s = resolve_role(df.columns, "sales", explicit=sales) if use_sales else None
    # one row per product; materialized so the count and the top-n read it
    # instead of each re-running the aggregation (and any join below it)
    grouped = materialize(_by_key(df, p, s))
    n_keys = grouped.agg(F.count(F.lit(1))).scalar()
    ranked = _ranked_top(grouped, "total_sales" if s else "n_rows", top)
    return ranked.withColumn("n_products", n_keys).withColumnRenamed("key", "product")


def render_product_document(stats: DataFrame, by_sales: bool = True) -> DataFrame:
    """One-row text from the (at most ``top``) ranked rows of A2/A3."""
    if "product" not in stats.columns:
        return stats
    if by_sales:
        line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("product"),
                        F.lit(": Total Sales=$"), fmt.money("total_sales"),
                        F.lit(", Avg=$"), fmt.money("avg_sale"),
                        F.lit(", Count="), F.col("n_rows").cast("string"))
        head = "Top 5 Products by Sales:"
    else:
        line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("product"),
                        F.lit(": "), F.col("n_rows").cast("string"), F.lit(" occurrences"))
        head = "Top 5 Products by Frequency:"
    return stats.agg(
        F.concat(F.lit("Product Statistics:\nTotal Products: "),
                 F.first("n_products").cast("string"),
                 F.lit(f"\n\n{head}\n"),
                 F.array_join(F.transform(
                     F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("l")))),
                     lambda x: F.concat(x["l"], F.lit("\n"))), "")).alias("page_content"))


# ------------------------------------------------------------- A4 / A5
def regional_statistics(df: DataFrame, region: str | None = None, sales: str | None = None,
                        use_sales: bool = True) -> DataFrame:
    """All regions with sum / mean / count (A4) or counts only (A5)."""
    r = resolve_role(df.columns, "region", explicit=region)
    if r is None:
        return _message(df, "No regional data available.")
    s = resolve_role(df.columns, "sales", explicit=sales) if use_sales else None
    grouped = materialize(_by_key(df, r, s))
    n_keys = grouped.agg(F.count(F.lit(1))).scalar()
    return grouped.withColumn("n_regions", n_keys).withColumnRenamed("key", "region")


def render_region_document(stats: DataFrame, by_sales: bool = True) -> DataFrame:
    """One-row text listing every region (already one row per region)."""
    if "region" not in stats.columns:
        return stats
    if by_sales:
        order = F.struct(-F.col("total_sales"), F.col("region"))
        line = F.concat(F.col("region"), F.lit(": Total=$"), fmt.money("total_sales"),
                        F.lit(", Avg=$"), fmt.money("avg_sale"),
                        F.lit(", Count="), F.col("n_rows").cast("string"))
        head = "Performance by Region:"
    else:
        order = F.struct(-F.col("n_rows"), F.col("region"))
        line = F.concat(F.col("region"), F.lit(": "), F.col("n_rows").cast("string"),
                        F.lit(" transactions"))
        head = "Transactions by Region:"
    return stats.agg(
        F.concat(F.lit("Regional Statistics:\nTotal Regions: "),
                 F.first("n_regions").cast("string"),
                 F.lit(f"\n\n{head}\n"),
                 F.array_join(F.transform(
                     F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))),
                     lambda x: F.concat(x["l"], F.lit("\n"))), "")).alias("page_content"))


# ------------------------------------------------------------- A6 / A7
def customer_numeric(df: DataFrame, age: str | None = None) -> DataFrame:
    """Mean, median, min, max of the age column, one row."""
    a = resolve_role(df.columns, "age", explicit=age)
    if a is None:
        return _message(df, "No customer demographic data available.")
    out = df.agg(exact_mean(_c(a)).alias("avg_age"),
                 F.first(quantile_literals(df, [a])[(a, 0.5)]).alias("median_age"),
                 F.min(_dbl(a)).alias("min_age"), F.max(_dbl(a)).alias("max_age"))
    return out.withColumn("page_content", age_text())


def age_text() -> Column:
    """A6 text from columns avg_age, median_age, min_age, max_age."""
    return F.concat(F.lit("\nAge Demographics:\nAverage Age: "), fmt.fixed("avg_age", 1),
                    F.lit("\nMedian Age: "), fmt.fixed("median_age", 1),
                    F.lit("\nAge Range: "), fmt.fixed("min_age", 0), F.lit(" - "),
                    fmt.fixed("max_age", 0), F.lit("\n"))


def customer_share(df: DataFrame, gender: str | None = None) -> DataFrame:
    """Count and percent of all rows per value."""
    g = resolve_role(df.columns, "gender", explicit=gender)
    if g is None:
        return _message(df, "No customer demographic data available.")
    # one pass: counts per value including NULL; the total (all rows, as
    # the reference divides by the table length) is their sum
    grouped = materialize(df.groupBy(_c(g).alias("value")).agg(F.count(F.lit(1)).alias("n_rows")))
    total = grouped.agg(F.sum("n_rows")).scalar()
    return (grouped.where(F.col("value").isNotNull())
                   .withColumn("pct", F.col("n_rows") * F.lit(100.0) / total))


def render_customer_document(numeric: DataFrame | None, share: DataFrame | None) -> DataFrame:
    parts = []
    if numeric is not None and "avg_age" in numeric.columns:
        parts.append(numeric.select(F.lit(0).alias("part"), F.col("page_content").alias("t")))
    if share is not None and "value" in share.columns:
        line = F.concat(F.col("value"), F.lit(": "), F.col("n_rows").cast("string"),
                        F.lit(" ("), fmt.fixed("pct", 1), F.lit("%)\n"))
        body = share.agg(F.concat(F.lit("\nGender Distribution:\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(-F.col("n_rows"), F.col("value"), line.alias("l")))),
            lambda x: x["l"]), "")).alias("t"))
        parts.append(body.select(F.lit(1).alias("part"), "t"))
    if not parts:
        return None
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(F.concat(F.lit("Customer Statistics:\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), "")
    ).alias("page_content"))


# ------------------------------------------------------------- A8 / A9
def time_range(df: DataFrame, date: str | None = None) -> DataFrame:
    """Earliest, latest, whole-day span over parsed dates only."""
    d = resolve_role(df.columns, "date", explicit=date)
    if d is None:
        return _message(df, "No time-series data available.")
    dd = _c(d).cast("date")
    return (df.where(dd.isNotNull())
              .agg(F.min(dd).alias("earliest"), F.max(dd).alias("latest"), F.count(F.lit(1)).alias("n_dated"))
              .withColumn("span_days", F.datediff("latest", "earliest").cast("bigint")))


def monthly_summary(df: DataFrame, date: str | None = None, sales: str | None = None) -> DataFrame:
    """Monthly sums, then their mean and the best / worst month.

    Ties go to the earliest month (pandas idxmax / idxmin keep the first).
    The monthly table has one row per calendar month, so the second level
    is tiny whatever the row count.
    """
    d = resolve_role(df.columns, "date", explicit=date)
    s = resolve_role(df.columns, "sales", explicit=sales)
    if d is None or s is None:
        return _message(df, "No time-series data available.")
    dd = _c(d).cast("date")
    monthly = (df.where(dd.isNotNull())
                 .groupBy(F.trunc(dd, "month").alias("m"))
                 .agg(F.coalesce(F.sum(_c(s)), F.lit(0)).alias("t")))
    key = F.year("m") * 12 + F.month("m")
    return monthly.agg(
        F.try_divide(F.sum("t").cast("double"), F.count(F.lit(1))).alias("avg_monthly_sales"),
        F.date_format(F.max_by("m", F.struct(F.col("t"), -key)), "yyyy-MM").alias("best_month"),
        F.max("t").cast("double").alias("best_month_sales"),
        F.date_format(F.min_by("m", F.struct(F.col("t"), key)), "yyyy-MM").alias("worst_month"),
        F.min("t").cast("double").alias("worst_month_sales"),
        F.count(F.lit(1)).alias("n_months"),
    )


def render_time_document(rng: DataFrame, monthly: DataFrame | None) -> DataFrame:
    """Text of A8 + A9 from their one-row results."""
    if "earliest" not in rng.columns:
        return rng
    head = F.concat(
        F.lit("Time Period Statistics:\nDate Range: "), F.col("earliest").cast("string"),
        F.lit(" to "), F.col("latest").cast("string"),
        F.lit("\nTotal Days: "), F.col("span_days").cast("string"), F.lit("\n"))
    text = head
    if monthly is not None and "best_month" in monthly.columns:
        m = monthly.select(F.struct(*monthly.columns).alias("m")).scalar()
        text = F.concat(head, F.concat(
            F.lit("\nMonthly Sales Summary:\nAverage Monthly Sales: $"), fmt.money(m["avg_monthly_sales"]),
            F.lit("\nBest Month: "), m["best_month"], F.lit(" ($"), fmt.money(m["best_month_sales"]),
            F.lit(")\nWorst Month: "), m["worst_month"], F.lit(" ($"), fmt.money(m["worst_month_sales"]),
            F.lit(")\n")))
    return rng.select(F.when(F.col("n_dated") > 0, text)
                      .otherwise(F.lit("No valid time-series data available.")).alias("page_content"))


# ------------------------------------------------------------------ A10
def general_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A10: mean, median, sample std, min, max for every numeric column.

    One wide aggregation (a single scan, one shuffle of one partial row per
    task), then ``inline`` turns it into one row per column.
    """
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, mean double, median double, std double, min double, max double")
    aggs = []
    med = quantile_literals(df, cols)
    for i, c in enumerate(cols):
        x = _dbl(c)
        aggs += [exact_mean(_c(c)).alias(f"a{i}"), F.first(med[(c, 0.5)]).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).cast("int").alias("pos"),
                              F.col(f"a{i}").alias("mean"), F.col(f"m{i}").alias("median"),
                              F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                              F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def render_general_document(gen: DataFrame) -> DataFrame:
    block = F.concat(F.col("column"), F.lit(":\nMean: "), fmt.fixed("mean"),
                     F.lit("\nMedian: "), fmt.fixed("median"), F.lit("\nStd Dev: "), fmt.fixed("std"),
                     F.lit("\nMin: "), fmt.fixed("min"), F.lit("\nMax: "), fmt.fixed("max"), F.lit("\n\n"))
    return gen.agg(F.concat(F.lit("General Statistics:\n\n"), F.coalesce(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), ""),
        F.lit(""))).alias("page_content"))


# ------------------------------------------------------------ A11 / A12
def table_facts(df: DataFrame, roles: dict) -> DataFrame:
    """One row of facts: rows, total, mean, distinct products and
    regions, top product by sum (ties to the smallest name)."""
    s, p, r = roles.get("sales"), roles.get("product"), roles.get("region")
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if s:
        aggs += [_total(s).alias("total_sales"), F.count(_c(s)).alias("_ns")]
    if p:
        aggs.append(F.count_distinct(_c(p)).alias("n_products"))
    if r:
        aggs.append(F.count_distinct(_c(r)).alias("n_regions"))
    out = df.agg(*aggs)
    if s:
        out = out.withColumn("avg_sale", F.try_divide(F.col("total_sales"), F.col("_ns"))).drop("_ns")
    if s and p:
        top = (_by_key(df, p, s).orderBy(F.col("total_sales").desc(), F.col("key").asc())
               .limit(1).select("key"))
        out = out.withColumn("top_product", top.scalar())
    return out


def quick_statistics(questions: DataFrame, text_col: str, facts: DataFrame, roles: dict,
                     simple: bool = False) -> DataFrame:
    """A11 (and A12 with ``simple=True``): per-question statistics lines.

    ``facts`` is the one-row A13 table; it is attached as a single scalar
    subquery (one struct), so the question table is never shuffled.
    """
    f = facts.select(F.struct(*facts.columns).alias("f")).scalar()
    q = F.lower(F.col(text_col))
    has_sales = q.contains("sales") | q.contains("revenue")
    lines = [F.concat(F.lit("Total Records: "), f["n_rows"].cast("string"))]
    sales_col = roles.get("sales")
    # the simple variant only takes a column whose name contains 'sales'
    sales_ok = sales_col is not None and (not simple or "sales" in sales_col.lower())
    if sales_ok:
        lines.append(F.when(has_sales, F.concat(F.lit("Total Sales: $"), fmt.money(f["total_sales"]))))
        if not simple:
            lines.append(F.when(has_sales, F.concat(F.lit("Average Sale: $"), fmt.money(f["avg_sale"]))))
    if not simple and roles.get("product"):
        lines.append(F.when(q.contains("product"),
                            F.concat(F.lit("Total Products: "), f["n_products"].cast("string"))))
    if not simple and roles.get("region"):
        lines.append(F.when(q.contains("region") | q.contains("location"),
                            F.concat(F.lit("Total Regions: "), f["n_regions"].cast("string"))))
    return questions.withColumn("statistics", F.concat_ws("\n", *lines))


def statistics_lines(questions: DataFrame, text_col: str, df: DataFrame, simple: bool = False) -> DataFrame:
    """A11 (A12 with ``simple``) straight from a table, its columns taken by
    the names these call sites look for: no region line from a ``location``
    column; the simple form takes the first column named ``sales`` even if
    a ``revenue`` column comes before it."""
    roles = resolve_roles(df.columns, call_site="simple" if simple else "facts")
    return quick_statistics(questions, text_col, table_facts(df, roles), roles, simple)
