"""All summary statistics of a table in two scans (P8: P5 + P6 + P7).

Scan 1 is one wide aggregation: counts, means, deviations, extremes, date
ranges, and for every wanted quantile a bracket from a mergeable sketch
(``percentile_approx``).  Scan 2 is one grouped count: a row gives each
numeric column a cell, which is its value inside a bracket and only the
number of the gap outside, and each categorical column its value.  Partial
aggregation turns the gaps into a few rows a task, so what is shuffled and
written is the brackets' share of the table (twelve values in ten thousand)
and the distinct categorical values.  Exact ranks are then read from that
small table, whose refinement passes never touch the input.  A rank that a
bracket misses (the sketch's error bound makes that a matter of ties and
rounding) is selected exactly from the input by ``plans.quantiles``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from ..plans.quantiles import exact_quantiles, interpolate, narrow
from ..plans.rolling import materialize
from . import profile, stats

PROBS = (0.25, 0.5, 0.75)
ACCURACY = 10_000
WHOLE = 10 * ACCURACY     # a column of at most so many values is one bracket
SCHEMA = "section string, column string, stat string, pos int, number double, text string"


def _c(name):
    return F.col(f"`{name}`")


def _as_date(df, name):
    if isinstance(df.schema[name].dataType, (DateType, TimestampType, TimestampNTZType)):
        return _c(name).cast("date")
    return F.to_date(F.try_to_timestamp(_c(name).cast("string"), F.lit("yyyy-MM-dd")))


def _brackets(row, i: int) -> list[tuple[float, float]]:
    """Disjoint closed intervals of column i, in order, that should hold the wanted ranks."""
    n, lo, hi = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
    if not n:
        return []
    if n <= WHOLE:
        return [(lo, hi)]
    out = []
    edges = row[f"q{i}"]
    for a, b in sorted(zip(edges[::2], edges[1::2])):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def summary_statistics(df: DataFrame, first: int = 5, max_distinct: int = 100, top: int = 10) -> DataFrame:
    """Long rows (section, column, stat, pos, number, text):

    * ``numeric``: count, mean, std, min, 25%, 50%, 75%, max of every numeric column;
    * ``range``: earliest, latest, span_days of every date column with a valid date;
    * ``distribution``: the ``top`` values (stat) with their counts of the first ``first``
      categorical columns that have fewer than ``max_distinct`` different ones.

    NaN is missing, infinities are values.  A table without columns gives no row; one without rows
    gives the numeric rows with count 0.
    """
    roles = profile.column_roles(df)
    num, dates, cats = stats.numeric_columns(df), roles["date"], roles["categorical"][:first]
    spark = df.sparkSession
    if not (num or dates or cats):
        return spark.createDataFrame([], SCHEMA)
    v = [stats.present(_c(c)).cast("double") for c in num]
    step = 2 / ACCURACY
    edges = [e for p in PROBS for e in (max(0.0, p - step), min(1.0, p + step))]
    aggs = []
    for i, c in enumerate(num):
        aggs += [F.count(v[i]).alias(f"n{i}"), stats.exact_mean(_c(c)).alias(f"mean{i}"), F.stddev_samp(v[i]).alias(f"std{i}"),
                 F.min(v[i]).alias(f"lo{i}"), F.max(v[i]).alias(f"hi{i}"),
                 F.percentile_approx(v[i], edges, ACCURACY).alias(f"q{i}")]
    for i, c in enumerate(dates):
        aggs += [F.min(_as_date(df, c)).alias(f"dlo{i}"), F.max(_as_date(df, c)).alias(f"dhi{i}")]
    wide = df.agg(*aggs).first() if aggs else None

    brackets = [_brackets(wide, i) for i in range(len(num))]
    cells = materialize(_cells(df, v, brackets, cats))
    quantile = _quantiles(df, cells, num, wide, brackets)

    rows = []
    for i, c in enumerate(num):
        values = [("count", float(wide[f"n{i}"])), ("mean", wide[f"mean{i}"]), ("std", wide[f"std{i}"]), ("min", wide[f"lo{i}"]),
                  *[(f"{p:.0%}", quantile[(c, p)]) for p in PROBS], ("max", wide[f"hi{i}"])]
        rows += [("numeric", c, stat, i * 8 + j, x, None) for j, (stat, x) in enumerate(values)]
    for i, c in enumerate(dates):
        lo, hi = wide[f"dlo{i}"], wide[f"dhi{i}"]
        if lo is not None:
            rows += [("range", c, "earliest", 3 * i, None, str(lo)), ("range", c, "latest", 3 * i + 1, None, str(hi)),
                     ("range", c, "span_days", 3 * i + 2, float((hi - lo).days), None)]
    out = spark.createDataFrame(rows, SCHEMA)    # eight rows a numeric, three a date column
    return out.unionByName(_distributions(cells, cats, max_distinct, top)) if cats else out


def _cells(df: DataFrame, v: list, brackets: list, cats: list[str]) -> DataFrame:
    """Scan 2: (c, g, v, s, n).  Numeric column c has gap g = 0, 2, 4, ... or bracket g = 1, 3, ...
    with its value; categorical columns have c below zero and their value in s."""
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    items = []
    for i, x in enumerate(v):
        gap = F.lit(2 * len(brackets[i]))
        inside = F.lit(False)
        for j, (a, b) in reversed(list(enumerate(brackets[i]))):
            gap = F.when(x < F.lit(a), 2 * j).when(x <= F.lit(b), 2 * j + 1).otherwise(gap)
            inside = inside | ((x >= F.lit(a)) & (x <= F.lit(b)))
        items.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("c"), gap.cast("int").alias("g"),
                                                    F.when(inside, x).otherwise(none).alias("v"), no_text.alias("s"))))
    for i, c in enumerate(cats):
        items.append(F.when(_c(c).isNotNull(), F.struct(F.lit(-1 - i).alias("c"), F.lit(0).alias("g"), none.alias("v"),
                                                        _c(c).cast("string").alias("s"))))
    if not items:
        return df.sparkSession.createDataFrame([], "c int, g int, v double, s string, n bigint")
    return (df.select(F.explode(F.array(*items)).alias("x")).where("x is not null")
              .groupBy("x.c", "x.g", "x.v", "x.s").agg(F.count(F.lit(1)).alias("n")))


def _quantiles(df: DataFrame, cells: DataFrame, num: list[str], wide, brackets: list) -> dict:
    """{(column, p): value or None} from the counted cells."""
    inf = float("inf")
    per = {(r["c"], r["g"]): r for r in cells.where("c >= 0").groupBy("c", "g").agg(
        F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.sum(F.when(F.col("v") == -inf, F.col("n")).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("v") == inf, F.col("n")).otherwise(0)).alias("high"),
        F.min(F.when(F.abs("v") < inf, F.col("v"))).alias("flo"),
        F.max(F.when(F.abs("v") < inf, F.col("v"))).alias("fhi")).collect()}
    out, targets, values, missed = {}, {}, {}, set()
    for i, c in enumerate(num):
        n = wide[f"n{i}"]
        for p in PROBS:
            if not n:
                out[(c, p)] = None
                continue
            for r in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                below = 0
                for g in range(2 * len(brackets[i]) + 1):
                    cell = per.get((i, g))
                    if cell is not None and below + cell["n"] > r:
                        if g % 2 == 0:
                            missed.add(c)
                        elif r - below < cell["low"]:
                            values[(i, r)] = -inf
                        elif r - below >= cell["n"] - cell["high"]:
                            values[(i, r)] = inf
                        else:
                            targets[(i, r)] = (cell["flo"], cell["fhi"], below + cell["low"])
                        break
                    below += cell["n"] if cell is not None else 0

    def windowed(wins, bucket):
        items = [F.when((F.col("c") == i) & (F.col("v") >= F.lit(a)) & (F.col("v") <= F.lit(b)),
                        F.struct(F.lit(w).alias("w"), bucket(F.col("v"), a, b).alias("b"), F.col("v").alias("v"), F.col("n").alias("n")))
                 for w, (i, a, b) in enumerate(wins)]
        return cells.select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull()).select("s.*")

    values.update(narrow(windowed, {k: t for k, t in targets.items() if num[k[0]] not in missed}))
    for i, c in enumerate(num):
        if wide[f"n{i}"] and c not in missed:
            for p in PROBS:
                out[(c, p)] = interpolate((wide[f"n{i}"] - 1) * p, lambda r, i=i: values[(i, r)])
    if missed:
        out.update(exact_quantiles(df, sorted(missed), list(PROBS)))
    return out


def _distributions(cells: DataFrame, cats: list[str], max_distinct: int, top: int) -> DataFrame:
    counts = cells.where("c < 0").select("c", F.col("s").alias("value"), "n")
    keep = counts.groupBy("c").agg(F.count(F.lit(1)).alias("nd")).where(F.col("nd") < max_distinct).select("c")
    w = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = counts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).join(keep, "c", "left_semi")
    name = F.array(*[F.lit(c) for c in cats])[-1 - F.col("c")]
    return ranked.select(F.lit("distribution").alias("section"), name.alias("column"), F.col("value").alias("stat"),
                         F.col("pos").cast("int").alias("pos"), F.col("n").cast("double").alias("number"),
                         F.lit(None).cast("string").alias("text"))
