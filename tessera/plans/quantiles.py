"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` / ``median`` keeps a value -> count map and
merges all of it in a single task for a global aggregate: at scale that
is the whole column's distinct values in one place.  This plan selects the
exact order statistics instead by refinement:

1. one aggregation: count, min, max per column;
2. a histogram pass: for every target rank, the rows inside that target's
   current value window are bucketed (``B`` equal-width buckets) and
   counted with partial aggregation; only ``targets x B`` small rows reach
   the driver.  The bucket holding the rank becomes the new window;
3. once a window holds at most ``cap`` values (a thousand) or a single
   distinct value, the rank is read from those values.

NaN is missing.  Infinities are ranked apart, by their counts, so windows are
always finite and every pass narrows them.

Linear interpolation between the two neighbouring order statistics,
``(hi - pos) * x_lo + (pos - lo) * x_hi``, as Spark's ``percentile`` does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
CAP = 1_000


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    buckets: int = BUCKETS, cap: int = CAP) -> dict:
    """{(column, p): value or None} for every column and probability."""
    inf = float("inf")
    v = {c: F.col(f"`{c}`").cast("double") for c in columns}
    x = {c: F.when(~F.isnan(v[c]) & (F.abs(v[c]) < F.lit(inf)), v[c]) for c in columns}   # finite values
    first = df.agg(*[F.count_if(v[c].isNotNull() & ~F.isnan(v[c])).alias(f"n{i}") for i, c in enumerate(columns)],
                   *[F.count_if(v[c] == F.lit(-inf)).alias(f"below{i}") for i, c in enumerate(columns)],
                   *[F.count(x[c]).alias(f"finite{i}") for i, c in enumerate(columns)],
                   *[F.min(x[c]).alias(f"lo{i}") for i, c in enumerate(columns)],
                   *[F.max(x[c]).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    # targets: (column index, rank) -> state [window lo, window hi, rank offset inside window]
    targets, result, values = {}, {}, {}
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        for p in probs:
            if not n:
                result[(c, p)] = None
                continue
            pos = (n - 1) * p
            for r in {math.floor(pos), math.ceil(pos)}:
                below = first[f"below{i}"]
                if r < below:
                    values[(i, r)] = -inf
                elif r >= below + first[f"finite{i}"]:
                    values[(i, r)] = inf
                else:
                    targets[(i, r)] = [first[f"lo{i}"], first[f"hi{i}"], below]

    def windowed(wins, bucket):
        """One pass: every row x window it falls in (codegen-friendly
        explode + filter; windows are few)."""
        items = [F.when((x[columns[i]] >= F.lit(a)) & (x[columns[i]] <= F.lit(b)),
                        F.struct(F.lit(w).alias("w"), bucket(x[columns[i]], a, b).alias("b"), x[columns[i]].alias("v"),
                                 F.lit(1).cast("bigint").alias("n")))
                 for w, (i, a, b) in enumerate(wins)]
        return df.select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull()).select("s.*")

    values.update(narrow(windowed, targets, buckets, cap))
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        for p in probs:
            if n:
                result[(c, p)] = interpolate((n - 1) * p, lambda r, i=i: values[(i, r)])
    return result


def interpolate(pos: float, value) -> float:
    """The value at a fractional rank from its two neighbours."""
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi or value(lo) == value(hi):
        return value(lo)
    return (hi - pos) * value(lo) + (pos - lo) * value(hi)


def narrow(windowed, targets: dict, buckets: int = BUCKETS, cap: int = CAP) -> dict:
    """{(column, rank): value} for targets {(column, rank): (window lo, window hi, rows below the window)}.

    ``windowed(windows, bucket)`` gives the rows (w, b, v, n) inside each of the windows
    (column, lo, hi): its number, ``bucket(v, lo, hi)``, the value and how many rows have it."""
    values = {}

    def part_of(y, a, b):
        # halves: the width of a window may be above the largest double
        part = (y / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2) if b / 2 > a / 2 else F.when(y > F.lit(a), 1.0).otherwise(0.0)
        return F.least(F.floor(part * buckets), F.lit(buckets - 1)).cast("int")

    while targets:
        todo = {}
        for (i, r), (a, b, off) in targets.items():
            if a == b:
                values[(i, r)] = a
            else:
                todo[(i, r)] = (a, b, off)
        if not todo:
            break
        wins = sorted({(i, a, b) for (i, _), (a, b, _) in todo.items()})   # shared per column
        hist = (windowed(wins, part_of).groupBy("w", "b")
                .agg(F.sum("n").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                .collect())   # at most len(wins) * buckets rows
        by_w = {}
        for h in hist:
            by_w.setdefault(h["w"], []).append(h)
        for w in by_w:
            by_w[w].sort(key=lambda h: h["b"])
        targets, collect_now = {}, []
        for (i, r), (a, b, off) in todo.items():
            cum = off
            for h in by_w.get(wins.index((i, a, b)), []):
                if cum + h["n"] > r:
                    if h["mn"] == h["mx"]:
                        values[(i, r)] = h["mn"]
                    elif h["n"] <= cap:
                        collect_now.append((i, r, h["mn"], h["mx"], cum))
                    else:
                        targets[(i, r)] = [h["mn"], h["mx"], cum]
                    break
                cum += h["n"]
        if collect_now:   # one pass for all windows; each holds at most ``cap`` values
            cw = sorted({(i, a, b) for i, _, a, b, _ in collect_now})
            got = {}
            for row in windowed(cw, lambda y, a, b: F.lit(0)).select("w", "v", "n").collect():
                got.setdefault(row["w"], []).extend([row["v"]] * row["n"])
            for w in got:
                got[w].sort()
            for i, r, a, b, cum in collect_now:
                values[(i, r)] = got[cw.index((i, a, b))][r - cum]
    return values
