"""Chart data (C1-C13): the aggregates behind each chart; drawing is not built.

Each operator is a scan -> project -> partial aggregate -> exchange ->
final aggregate plan whose result is small (periods, top-n, bins, pairs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.roles import resolve_role
from ..plans.rolling import trailing_means
from . import stats

# Period codes of the reference's trend chart.
PERIODS = ("D", "W", "M", "Q", "Y")


def _c(name: str):
    return F.col(f"`{name}`")


def period_key(d, period: str):
    """Truncated date for a period code and its pandas-style label."""
    d = d.cast("date")
    if period == "D":
        return d, F.date_format(d, "yyyy-MM-dd")
    if period == "W":
        start = F.date_trunc("week", d).cast("date")  # Monday
        return start, F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                               F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    if period == "M":
        start = F.trunc(d, "month")
        return start, F.date_format(start, "yyyy-MM")
    if period == "Q":
        start = F.date_trunc("quarter", d).cast("date")
        return start, F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    if period == "Y":
        start = F.trunc(d, "year")
        return start, F.date_format(start, "yyyy")
    raise ValueError(f"unknown period {period!r}; use one of {PERIODS}")


def sales_trend(df: DataFrame, date: str | None = None, sales: str | None = None,
                period: str = "M") -> DataFrame:
    """Sum of sales per observed period, unparsed dates dropped."""
    d = resolve_role(df.columns, "date", explicit=date)
    if d is None:
        raise ValueError("No date column found")
    s = resolve_role(df.columns, "sales", explicit=sales)
    if s is None:
        raise ValueError("No sales column found")
    start, _ = period_key(_c(d), period)
    g = (df.where(_c(d).isNotNull())
           .groupBy(start.alias("period_start"))
           .agg(F.coalesce(F.sum(_c(s)).cast("double"), F.lit(0.0)).alias("total_sales")))
    _, label = period_key(F.col("period_start"), period)
    return g.select(label.alias("period"), "total_sales")


def product_topn(df: DataFrame, product: str | None = None, value: str | None = None,
                 top_n: int = 10, by_count: bool = False) -> DataFrame:
    """Top-n products by summed value (or by row count)."""
    out = stats.product_statistics(df, product, value, top=top_n, use_sales=not by_count)
    if "product" not in out.columns:
        raise ValueError("No product column found")
    keep = ["product", "rank", "n_rows"] if by_count else ["product", "rank", "total_sales"]
    return out.select(*keep)


def region_analysis(df: DataFrame, region: str | None = None, value: str | None = None,
                    by_count: bool = False) -> DataFrame:
    """Per-region sum, mean, count (or counts only)."""
    out = stats.regional_statistics(df, region, value, use_sales=not by_count)
    if "region" not in out.columns:
        raise ValueError("No region column found")
    return out.drop("n_regions")


def histogram(df: DataFrame, column: str | None = None, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max, max folded into the last
    bin, one bin when min = max.  min / max come from a one-row aggregate
    attached as a scalar subquery."""
    a = resolve_role(df.columns, "age", explicit=column)
    if a is None:
        raise ValueError("No age column found")
    x = _c(a).cast("double")
    mm = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = mm["lo"], mm["hi"]
    width = hi - lo
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((x - lo) / width * F.lit(bins)) + 1, F.lit(bins))).cast("bigint")
    g = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select("bin",
                    (lo + (F.col("bin") - 1) * width / F.lit(bins)).alias("bin_lo"),
                    (lo + F.col("bin") * width / F.lit(bins)).alias("bin_hi"),
                    "n_rows")


def composition(df: DataFrame, column: str | None = None) -> DataFrame:
    """Count and share per value."""
    out = stats.customer_share(df, column)
    if "value" not in out.columns:
        raise ValueError("No gender column found")
    return out.select("value", "n_rows", (F.col("pct") / 100.0).alias("share"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P5 as long rows (column, stat, value): count, mean, std, min,
    25 / 50 / 75 percent (linear interpolation), max; one aggregation."""
    cols = columns if columns is not None else stats.numeric_columns(df)
    if not cols:   # see ``describe_text`` for tables without numeric columns
        return df.sparkSession.createDataFrame([], "column string, stat string, pos int, value double")
    aggs = []
    qs = stats.quantile_literals(df, cols, (0.25, 0.5, 0.75))
    for i, c in enumerate(cols):
        x = stats.present(_c(c)).cast("double")
        aggs += [F.count(x).cast("double").alias(f"n{i}"), stats.exact_mean(_c(c)).alias(f"a{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.first(F.array(qs[(c, 0.25)], qs[(c, 0.5)], qs[(c, 0.75)])).alias(f"q{i}"),
                 F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    items = []
    for i, c in enumerate(cols):
        vals = [F.col(f"n{i}"), F.col(f"a{i}"), F.col(f"s{i}"), F.col(f"lo{i}"),
                F.col(f"q{i}")[0], F.col(f"q{i}")[1], F.col(f"q{i}")[2], F.col(f"hi{i}")]
        for j, (nm, v) in enumerate(zip(names, vals)):
            items.append(F.struct(F.lit(c).alias("column"), F.lit(nm).alias("stat"),
                                  F.lit(i * 8 + j).alias("pos"), v.alias("value")))
    return wide.select(F.inline(F.array(*items)))


def describe_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P5 for tables without numeric columns, as long rows (column, stat,
    pos, value): count, unique, top and freq of each column's text; the
    smallest of equally frequent values is top.  One expand to (column,
    value) counts, partial-aggregated, then one row a column."""
    cols = columns if columns is not None else df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), _c(c).cast("string").alias("v"))
                                for i, c in enumerate(cols)])).alias("x")
    counts = df.select(cells).select("x.*").groupBy("i", "column", "v").agg(F.count("v").alias("n"))
    per = counts.groupBy("i", "column").agg(
        F.sum("n").alias("count"), F.count("v").alias("unique"),
        F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), "v"))).alias("top"))
    stat = [("count", F.col("count").cast("string")), ("unique", F.col("unique").cast("string")),
            ("top", F.col("top.v")), ("freq", (-F.col("top.n")).cast("string"))]
    return per.select("column", F.col("i").alias("_i"), F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("stat"), v.alias("value")) for n, v in stat]))).select(
        "column", "col.stat", (F.col("_i") * 4 + F.col("pos")).cast("int").alias("pos"), "col.value")


def demographics(df: DataFrame, age: str | None = None, gender: str | None = None, bins: int = 20) -> DataFrame:
    """C8 as rows (panel, label, n_rows): the age histogram (label: bin
    number) if there is an age column and the gender composition if there
    is a gender column; neither is an error."""
    a, g = resolve_role(df.columns, "age", explicit=age), resolve_role(df.columns, "gender", explicit=gender)
    if not a and not g:
        raise ValueError("No demographic columns found")
    out = None
    if a:
        out = histogram(df, a, bins=bins).select(F.lit("age").alias("panel"), F.col("bin").cast("string").alias("label"), "n_rows")
    if g:
        part = (df.where(_c(g).isNotNull()).groupBy(_c(g).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
                  .select(F.lit("gender").alias("panel"), "label", "n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def dashboard(df: DataFrame, roles: dict, top_n: int = 5) -> DataFrame:
    """The dashboard panels as long rows (panel, label, value, rank).

    total sales, top products by sum, transactions per region, and the
    summary statistics panel (left empty by the reference) from P5."""
    s, p, r = roles.get("sales"), roles.get("product"), roles.get("region")
    parts = []
    if s:
        parts.append(df.agg(F.lit("total_sales").alias("panel"), F.lit("Total Sales").alias("label"),
                            F.coalesce(F.sum(_c(s)).cast("double"), F.lit(0.0)).alias("value"),
                            F.lit(1).cast("bigint").alias("rank")))
    if s and p:
        t = stats.product_statistics(df, p, s, top=top_n)
        parts.append(t.select(F.lit("top_products").alias("panel"), F.col("product").alias("label"),
                              F.col("total_sales").alias("value"), F.col("rank")))
    if r:
        t = stats.regional_statistics(df, r, use_sales=False)
        parts.append(t.select(F.lit("region_counts").alias("panel"), F.col("region").alias("label"),
                              F.col("n_rows").cast("double").alias("value"),
                              F.lit(None).cast("bigint").alias("rank")))
    d = describe(df)
    parts.append(d.select(F.lit("summary").alias("panel"),
                          F.concat(F.col("column"), F.lit(":"), F.col("stat")).alias("label"),
                          "value", F.col("pos").cast("bigint").alias("rank")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C11: Pearson r for every ordered pair over pairwise-complete rows;
    a constant column gives NULL (the built-in ``corr`` raises
    DIVIDE_BY_ZERO under ANSI mode instead).

    Two passes.  A one-row pre-pass gives per-column counts, means and
    constancy.  The main pass is one aggregation of plain sums of *shifted*
    values d = x - mean (first moments and all cross products), which
    generates small code and stays numerically stable.  The one-row result
    is turned into one row per pair and r is one expression over that row,
    so the generated code stays small for any column count.  Pairs that
    touch a column with NULLs get their own pairwise-complete sums.

    The expressions are given as SQL text: one call per statement instead
    of a driver-to-JVM round trip per expression node (quadratic in the
    column count here)."""
    cols = columns if columns is not None else stats.numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("Need at least two numeric columns for correlation")
    k = len(cols)
    x = [f"CAST({_ident(c)} AS DOUBLE)" for c in cols]
    pre = df.selectExpr("count(1) AS n", *[f"count({v}) AS c{i}" for i, v in enumerate(x)],
                        *[f"avg({v}) AS m{i}" for i, v in enumerate(x)],
                        *[f"(min({v}) = max({v})) AS k{i}" for i, v in enumerate(x)]).first()
    n = pre["n"]
    full = [pre[f"c{i}"] == n for i in range(k)]
    const = [bool(pre[f"k{i}"]) or pre[f"c{i}"] == 0 for i in range(k)]
    d = [f"({v} - {float(pre[f'm{i}'] or 0.0)!r}D)" for i, v in enumerate(x)]
    aggs = ["count(1) AS _n"] + [f"sum({d[i]}) AS s{i}" for i in range(k) if full[i]]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for i, j in pairs:
        if full[i] and full[j]:
            aggs.append(f"sum({d[i]} * {d[j]}) AS p{i}_{j}")
        else:   # pairwise-complete moments for pairs touching a nullable column
            both = f"({d[i]} IS NOT NULL AND {d[j]} IS NOT NULL)"
            di, dj = f"(CASE WHEN {both} THEN {d[i]} END)", f"(CASE WHEN {both} THEN {d[j]} END)"
            aggs += [f"count({di}) AS n{i}_{j}", f"sum({di}) AS a{i}_{j}", f"sum({dj}) AS b{i}_{j}",
                     f"sum({di} * {di}) AS q{i}_{j}", f"sum({dj} * {dj}) AS r{i}_{j}",
                     f"sum({di} * {dj}) AS p{i}_{j}"]
    wide = df.selectExpr(*aggs)

    def moments(i, j):
        if full[i] and full[j]:
            cnt, si, sj, qi, qj = "_n", f"s{i}", f"s{j}", f"p{i}_{i}", f"p{j}_{j}"
        else:
            cnt, si, sj, qi, qj = f"n{i}_{j}", f"a{i}_{j}", f"b{i}_{j}", f"q{i}_{j}", f"r{i}_{j}"
        return (f"named_struct('col_a', {_sql_string(cols[i])}, 'col_b', {_sql_string(cols[j])}, "
                f"'k', {str(const[i] or const[j]).lower()}, 'n', CAST({cnt} AS DOUBLE), "
                f"'si', {si}, 'sj', {sj}, 'qi', {qi}, 'qj', {qj}, 'pij', p{i}_{j})")

    long = wide.selectExpr(f"inline(array({', '.join(moments(i, j) for i, j in pairs)}))")
    vi, vj = "(qi / n - (si / n) * (si / n))", "(qj / n - (sj / n) * (sj / n))"
    r = (f"CASE WHEN k OR {vi} <= 1e-14D * qi / n OR {vj} <= 1e-14D * qj / n THEN CAST(NULL AS DOUBLE) "
         f"ELSE try_divide(pij / n - (si / n) * (sj / n), sqrt({vi} * {vj})) END")
    # mirror the off-diagonal pairs
    mirrored = ("inline(CASE WHEN col_a = col_b THEN array(named_struct('col_a', col_a, 'col_b', col_b)) "
                "ELSE array(named_struct('col_a', col_a, 'col_b', col_b), "
                "named_struct('col_a', col_b, 'col_b', col_a)) END)")
    return long.selectExpr("col_a", "col_b", f"{r} AS r").selectExpr(mirrored, "r")


def moving_avg_rows(df: DataFrame, order_cols: list[str], value: str,
                    sizes=(7, 30), block: int = 1 << 20) -> DataFrame:
    """Rolling means over 7 and 30 *rows* in global order (what the
    reference computes under its "7-Day / 30-Day" labels), NULL until the
    frame is full.  Uses the skew-safe blocked plan in ``plans.rolling``."""
    return trailing_means(df, order_cols, value, list(sizes), block=block)


def moving_avg_days(df: DataFrame, date_col: str, value: str, sizes=(7, 30),
                    block_days: int = 4096) -> DataFrame:
    """Calendar-day moving averages of the daily totals.

    Daily totals first (partial aggregation, one row per day), then a range
    frame over the day number, run per block of ``block_days`` day numbers:
    each day is also copied into the next block when it lies within the
    largest frame of that block's start, so every frame is complete inside
    one block and no window gathers all days into one task."""
    day = F.to_date(_c(date_col))
    daily = (df.where(day.isNotNull()).groupBy(day.alias("day"))
               .agg(F.sum(_c(value)).alias("daily_total"), F.count(F.lit(1)).alias("n_rows")))
    halo = max(sizes) - 1
    if block_days <= halo:
        raise ValueError("block_days must exceed the largest frame")
    dn = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    home = F.floor(F.col("_dn") / F.lit(block_days))
    reach = F.floor((F.col("_dn") + F.lit(halo)) / F.lit(block_days))
    out = (daily.withColumn("_dn", dn).withColumn("_home", home)
                .withColumn("_blk", F.explode(F.when(reach != F.col("_home"),
                                                     F.array(F.col("_home"), reach))
                                              .otherwise(F.array(F.col("_home"))))))
    for n in sizes:
        w = Window.partitionBy("_blk").orderBy("_dn").rangeBetween(-(n - 1), 0)
        out = out.withColumn(f"ma{n}d", F.avg("daily_total").over(w))
    return out.where(F.col("_blk") == F.col("_home")).drop("_dn", "_home", "_blk")
