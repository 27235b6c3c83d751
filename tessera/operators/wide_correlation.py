"""Pearson correlation of hundreds of columns (C11): a blocked Gram matrix.

``chartdata.correlation`` is one aggregation with an expression a pair, which
a plan of 500 columns (125,250 pairs) cannot hold.  Here tasks multiply Arrow
batches: columns are dealt into tiles, a task adds up X_i' X_j for each pair of
tiles over all its rows and emits it by matrix rows, and these are summed by
(tile, tile, row).  Pairs of tiles in which a column misses values also add up
the pairwise-complete moments, all of them products of the values (missing: 0),
their squares and the masks.

Memory: a task holds the sums of one strip of tile pairs, at most
``STRIP_BYTES``; more columns are worked on in several strips, each a scan of
its own columns.  A summing task holds the rows of its keys only.  What a
task ships depends on the columns, not on its rows, and no key's sums are
gathered: they stream through.

The driver sees one row a column: count, mean, least and greatest value, sum
of squares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rolling import materialize, spread
from . import stats

TILE = 64                   # columns
STRIP_BYTES = 128 << 20     # sums a task holds
ROWS = 4096                 # rows multiplied at once
_PARTS = ("p", "n", "a", "b", "q", "w")   # sums of xy, 1, x, y, xx, yy over the rows that have both
_SCHEMA = "ti int, tj int, r int, " + ", ".join(f"{x} binary" for x in _PARTS)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns; missing values are NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False)


def _numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def column_moments(x: DataFrame) -> list:
    """(pos, rows, n, mean, lo, hi) of every column, in order; NaN and null are missing. No rows: nothing."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = s = lo = hi = None
        rows = 0
        for batch in batches:
            v = _values(batch)
            if not len(v):
                continue
            rows += len(v)
            there = ~np.isnan(v)
            part = (there.sum(axis=0), np.where(there, v, 0).sum(axis=0),
                    np.where(there, v, np.inf).min(axis=0), np.where(there, v, -np.inf).max(axis=0))
            n, s, lo, hi = part if n is None else (n + part[0], s + part[1], np.minimum(lo, part[2]), np.maximum(hi, part[3]))
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(np.full(len(n), rows)),
                                              pa.array(n.astype(np.int64)), pa.array(s), pa.array(lo), pa.array(hi)],
                                             names=["pos", "rows", "n", "s", "lo", "hi"])

    one = x.mapInArrow(work, "pos int, rows long, n long, s double, lo double, hi double")
    return one.groupBy("pos").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), (F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"),
                                  F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("pos").collect()


def _strips(tiles: list[list[int]], whole: list[bool]) -> list[list[tuple[int, int]]]:
    """Pairs of tiles in groups whose sums fit into a task."""
    out, held = [[]], 0
    for i in range(len(tiles)):
        for j in range(i, len(tiles)):
            size = 8 * len(tiles[i]) * len(tiles[j]) * (1 if whole[i] and whole[j] else len(_PARTS))
            if out[-1] and held + size > STRIP_BYTES:
                out.append([])
                held = 0
            out[-1].append((i, j))
            held += size
    return out


def _products(x: DataFrame, tiles: list[list[int]], whole: list[bool], strip: list[tuple[int, int]], mean: np.ndarray) -> DataFrame:
    """Each task's sums for the tile pairs of a strip, one row for each matrix row."""
    used = sorted({t for pair in strip for t in pair})
    cols = [c for t in used for c in tiles[t]]
    at = {t: slice(o, o + len(tiles[t])) for t, o in zip(used, np.cumsum([0] + [len(tiles[t]) for t in used]).tolist())}
    shift = mean[cols]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                d = _values(batch.slice(a, ROWS)) - shift
                mask = (~np.isnan(d)).astype(np.float64)
                d[mask == 0] = 0
                square = d * d
                for i, j in strip:
                    u, v = at[i], at[j]
                    part = [d[:, u].T @ d[:, v]]
                    if not (whole[i] and whole[j]):
                        part += [mask[:, u].T @ mask[:, v], d[:, u].T @ mask[:, v], mask[:, u].T @ d[:, v],
                                 square[:, u].T @ mask[:, v], mask[:, u].T @ square[:, v]]
                    if (i, j) in sums:
                        for have, more in zip(sums[i, j], part):
                            have += more
                    else:
                        sums[i, j] = part
        for (i, j), part in sums.items():
            yield _rows(i, j, range(len(tiles[i])), part)

    return x.select(*[f"c{c}" for c in cols]).mapInArrow(work, _SCHEMA)


def _rows(i: int, j: int, rows, part: list[np.ndarray]) -> pa.RecordBatch:
    rows = list(rows)
    blobs = [pa.array([m[k].tobytes() for k in range(len(rows))], pa.binary()) for m in part]
    blobs += [pa.nulls(len(rows), pa.binary())] * (len(_PARTS) - len(part))
    fixed = [pa.array(v, pa.int32()) for v in ([i] * len(rows), [j] * len(rows), rows)]
    return pa.RecordBatch.from_arrays([*fixed, *blobs], names=["ti", "tj", "r", *_PARTS])


def _summed(partial: DataFrame, n_parts: int) -> DataFrame:
    """Sums by (ti, tj, r): every key is dealt to one task, which adds its rows up as they come."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for ti, tj, r, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                part = [np.frombuffer(b) for b in blobs if b is not None]
                sums[ti, tj, r] = [x + y for x, y in zip(sums[ti, tj, r], part)] if (ti, tj, r) in sums else part
        for (ti, tj, r), part in sums.items():
            yield _rows(ti, tj, [r], [m[None, :] for m in part])

    return partial.repartition(n_parts, "ti", "tj", "r").mapInArrow(work, _SCHEMA)


def wide_correlation(df: DataFrame, columns: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """(col_a, col_b, r) of every ordered pair over the rows that have both values.

    Null and NaN are missing.  A column that is constant or empty (on the rows of
    the pair), or holds an infinite value, has null with all others and itself,
    as in ``chartdata.correlation``.  Values are shifted by the column's mean
    first, so large offsets lose no digits.  An empty table gives null for every
    pair.  Fewer than two columns are an error."""
    cols = columns if columns is not None else stats.numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("Need at least two numeric columns for correlation")
    spark = df.sparkSession
    x = spread(_numeric(df, cols))
    k, rows = len(cols), 0
    n, mean, flat = np.zeros(k, np.int64), np.zeros(k), np.ones(k, bool)
    for m in column_moments(x):
        finite = m["n"] > 0 and math.isfinite(m["lo"]) and math.isfinite(m["hi"])
        rows, n[m["pos"]], mean[m["pos"]] = m["rows"], m["n"], m["mean"] if finite else 0.0
        flat[m["pos"]] = not finite or m["lo"] == m["hi"]
    # complete columns first: their tiles need one product each
    live = [c for c in np.argsort(n < rows, kind="stable").tolist() if not flat[c]]
    full = [c for c in live if n[c] == rows]
    rest = [c for c in live if n[c] < rows]
    tiles = [part[a:a + tile] for part in (full, rest) for a in range(0, len(part), tile)]
    whole = [t[0] in set(full) for t in tiles]
    schema = "a int, b int, r double"
    if not tiles:
        found = spark.createDataFrame([], schema)
    else:
        partial = None
        for strip in _strips(tiles, whole):
            p = _products(x, tiles, whole, strip, mean)
            partial = p if partial is None else partial.unionByName(p)
        n_parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(len(t) for t in tiles)))
        total = materialize(_summed(partial, n_parts))
        # the diagonal of complete columns: one number a column
        square = np.zeros(k)
        own = total.where("ti = tj and n is null").select("ti", "r", F.substring("p", F.col("r") * 8 + 1, F.lit(8)).alias("d"))
        for row in own.collect():
            square[tiles[row["ti"]][row["r"]]] = np.frombuffer(bytes(row["d"]))[0]

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ti, tj, r, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                    i, other = tiles[ti][r], np.array(tiles[tj])
                    part = [np.frombuffer(b) for b in blobs if b is not None]
                    with np.errstate(all="ignore"):
                        if len(part) == 1:
                            corr = part[0] / np.sqrt(square[i] * square[other])
                        else:
                            p, cnt, a, b, q, w = part
                            va, vb = q / cnt - (a / cnt) ** 2, w / cnt - (b / cnt) ** 2
                            corr = (p / cnt - a / cnt * (b / cnt)) / np.sqrt(va * vb)
                            corr[(cnt == 0) | (va <= 1e-14 * q / cnt) | (vb <= 1e-14 * w / cnt)] = np.nan
                    keep = np.ones(len(other), bool) if ti != tj else np.arange(len(other)) >= r
                    corr = corr[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(corr), i), pa.int32()), pa.array(other[keep], pa.int32()),
                         pa.array(corr, mask=~np.isfinite(corr))], names=["a", "b", "r"])

        half = total.mapInArrow(finish, schema)
        found = half.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "r"))).otherwise(
            F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")))))
    # pairs with a constant, empty or infinite column
    gone = np.flatnonzero(flat).tolist()
    if gone:
        lost = spark.createDataFrame([(g,) for g in gone], "g int")
        dead = set(gone)
        sides = F.array(*[F.struct(F.col("g").alias("a"), F.lit(c).alias("b")) for c in range(k)],
                        *[F.struct(F.lit(c).alias("a"), F.col("g").alias("b")) for c in range(k) if c not in dead])
        found = found.unionByName(lost.select(F.inline(sides)).withColumn("r", F.lit(None).cast("double")))
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), "r")
