"""Exact top-k inner-product search pruned by multi-resolution segment statistics.

Every component x becomes floor(scale * x) (x as double).  A vector is cut
into 1, 4, 16 ... equal segments; a segment keeps its mean and its deviation
norm sqrt(sum (x - mean)^2).  For one segment of length L

    <q, x> <= L * mean_q * mean_x + dev_q * dev_x        (Cauchy-Schwarz)

which is the same as a lower bound on the squared distance of the segments.
Summed over segments it bounds the whole score, and finer cuts tighten it.
A block of candidates is scored coarse to fine: a pair goes on to the next
level only while its bound can still reach the query's k-th best score, and
survivors get the exact integer score.  Bounds and the scores that prune are
doubles with a slack for rounding, so nothing that could be in the answer is
dropped; the scores returned are sums of 64-bit integers.  A scaled component
or a score that does not fit 64 bits is an error.

Work is dealt as pairs (query block, candidate block): each side is copied
to its blocks, never collected to the driver, and one task holds one pair
of blocks, bounded by ``query_block`` and ``candidate_block`` rows.

Vectors that are null, empty, or hold a null or non-finite component take no
part; each length is searched among its own.  Repeated ids are
separate candidates (a query does not see rows with its own id); ties go to
the smaller id.  Empty tables give no rows; columns other than the id and the
vector are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rolling import spread
from .common import small

ROUNDING = 1e-9   # of the product of two vectors' norms: far above the error of a double sum


def segment_levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16 ... while they divide evenly enough."""
    out, s = [], 1
    while s <= dim // 2:
        out.append(s)
        s *= 4
    return out or [1]


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """[sqrt(L) * mean, deviation norm] for each segment, so that a bound is one matrix product."""
    cols = np.array_split(np.arange(x.shape[1]), segments)
    out = np.empty((len(x), 2 * segments))
    for i, c in enumerate(cols):
        part = x[:, c]
        mean = part.mean(axis=1)
        out[:, i] = math.sqrt(len(c)) * mean
        out[:, segments + i] = np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))
    return out


def exact_scores(q: np.ndarray, c: np.ndarray, qf: np.ndarray, cf: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (i, j)."""
    reach = float(np.abs(qf).sum(axis=1).max(initial=0)) * float(np.abs(cf).max(initial=0))
    if reach < 2 ** 53:   # every partial sum is exact in a double
        return np.einsum("ij,ij->i", qf[i], cf[j]).astype(np.int64)
    if reach >= 2 ** 63:
        most = np.einsum("ij,ij->i", np.abs(qf)[i], np.abs(cf)[j]).max(initial=0)
        if most >= 2 ** 63 * (1 - ROUNDING):
            raise ValueError("inner products of these vectors may not fit 64 bits; take a smaller scale")
    return np.einsum("ij,ij->i", q[i], c[j])


def top_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int,
              tile: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates for each query
    of one pair of blocks of integer vectors."""
    order = np.lexsort((c_ids,))
    c_ids, c = c_ids[order], c[order]
    levels = segment_levels(q.shape[1])
    qf = q.astype(np.float64)
    q_norm = np.linalg.norm(qf, axis=1)
    qs = [segment_stats(qf, s) for s in levels]
    nq = len(q)
    best_s = np.zeros((nq, k), np.int64)
    best_i = np.zeros((nq, k), np.int64)
    have = np.zeros(nq, np.int64)
    for a in range(0, len(c), tile):
        part, ids = c[a:a + tile], c_ids[a:a + tile]
        pf = part.astype(np.float64)
        # what rounding can take from a bound or a score
        slack = ROUNDING * (1 + q_norm[:, None] * np.linalg.norm(pf, axis=1)[None, :])
        floor = np.where(have == k, best_s[:, -1].astype(np.float64), -np.inf)[:, None]
        own = q_ids[:, None] == ids[None, :]
        if not np.isfinite(floor).all():   # some query has fewer than k so far: nothing to prune with
            score = np.where(own, -np.inf, qf @ pf.T)
            kth = np.partition(score - slack, -k, axis=1)[:, [-k]] if len(part) > k else np.full((nq, 1), -np.inf)
            i, j = np.nonzero((score + slack >= np.maximum(kth, floor)) & ~own)
        else:
            alive = ~own
            for s, stat in zip(levels, qs):
                cs = segment_stats(pf, s)
                if alive.mean() > 0.1:
                    alive &= stat @ cs.T + slack >= floor
                else:
                    i, j = np.nonzero(alive)
                    alive[i, j] = np.einsum("ij,ij->i", stat[i], cs[j]) + slack[i, j] >= floor[i, 0]
            if alive.mean() > 0.05:
                alive &= qf @ pf.T + slack >= floor
            i, j = np.nonzero(alive)
        if not len(i):
            continue
        score = exact_scores(q, part, qf, pf, i, j)
        # survivors and the best so far, by query, score (falling), id
        oi, oj = np.nonzero(np.arange(k)[None, :] < have[:, None])
        qi = np.concatenate([oi, i])
        sc = np.concatenate([best_s[oi, oj], score])
        ci = np.concatenate([best_i[oi, oj], ids[j]])
        o = np.lexsort((ci, ~sc, qi))    # ~x falls as x rises, without overflow
        qi, sc, ci = qi[o], sc[o], ci[o]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = rank < k
        best_s[qi[keep], rank[keep]] = sc[keep]
        best_i[qi[keep], rank[keep]] = ci[keep]
        have = np.bincount(qi[keep], minlength=nq)
    i, j = np.nonzero(np.arange(k)[None, :] < have[:, None])
    return q_ids[i], best_i[i, j], best_s[i, j]


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ok)
              .select(F.col(id_col).cast("long").alias("id"),
                      F.transform(vec_col, lambda x: F.when(F.abs(x.cast("double") * scale) < F.lit(2.0 ** 63), F.floor(x.cast("double") * scale))
                                  .otherwise(F.raise_error(F.lit("a scaled component does not fit 64 bits")))).alias("v")))


def search(df: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, id_col: str = "vec_id",
           vec_col: str = "embedding", query_block: int = 4096, candidate_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query row.

    Queries are the rows whose id is divisible by ``query_every``."""
    vecs = integer_vectors(spread(df.select(id_col, vec_col)), id_col, vec_col, scale)
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    dims = small(vecs.groupBy(F.size("v").alias("d")).agg(
        blocks(F.sum((F.col("id") % query_every == 0).cast("long")), query_block).alias("nq"),
        blocks(F.count(F.lit(1)), candidate_block).alias("nc")).where("nq > 0"))
    out = "query_id long, vec_id long, score long"
    vecs = vecs.withColumn("d", F.size("v")).join(dims, "d")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    queries = (vecs.where(F.col("id") % query_every == 0)
                   .withColumn("qb", block("nq")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))))
    cands = (vecs.withColumn("cb", block("nc")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
                 .select(*[F.col(c).alias(c) for c in ("d", "qb", "cb", "id", "v")]))

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dense = lambda x: np.stack(x["v"].to_numpy()).astype(np.int64)
        a, b, s = top_block(qs["id"].to_numpy(np.int64), dense(qs), cs["id"].to_numpy(np.int64), dense(cs), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    local = (queries.groupBy("d", "qb", "cb").cogroup(cands.groupBy("d", "qb", "cb")).applyInPandas(score, out))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
