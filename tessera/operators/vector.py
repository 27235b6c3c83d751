"""Exact k-nearest-neighbour search.

Plan: query rows and corpus rows are dealt into blocks of bounded size by a
hash of their ids; every pair of blocks is one cogrouped task, which computes
its top-k per query with matrix products over tiles; a ``row_number() <= k``
per query (partial WindowGroupLimit before the shuffle) merges the partials.
Neither side passes through the driver, no cross join is planned, and only
``k`` candidates per query and corpus block leave a task.

Equal distances are ordered by id: a tile keeps every row whose distance can
be among the k smallest, distances of those are computed exactly and alike
for equal vectors, and ties are cut by id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

QUERY_BLOCK, CORPUS_BLOCK, TILE = 2048, 16384, 1024   # rows


def _names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def _block_topk(q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int, metric: str):
    """(query row, corpus row, distance) of the k nearest corpus rows per
    query; ``order`` is each corpus row's place in id order."""
    best_q = best_c = np.zeros(0, np.int64)
    best_d = np.zeros(0)
    limit = np.full(len(q), np.inf)
    qq = (q * q).sum(axis=1)[:, None]
    for a in range(0, len(c), TILE):
        part = c[a:a + TILE]
        dot = q @ part.T
        near = 1.0 - dot if metric == "cosine" else np.maximum(qq - 2 * dot + (part * part).sum(axis=1)[None, :], 0)
        slack = 1e-9 * (1 + qq + (part * part).sum(axis=1).max())
        kth = np.partition(near, k - 1, axis=1)[:, k - 1] if len(part) >= k else np.full(len(q), np.inf)
        i, j = np.nonzero(near <= np.minimum(kth, limit)[:, None] + slack)
        if metric == "cosine":
            d = 1.0 - np.einsum("ij,ij->i", q[i], part[j])
        else:
            diff = q[i] - part[j]
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        i, j, d = np.concatenate([best_q, i]), np.concatenate([best_c, j + a]), np.concatenate([best_d, d])
        o = np.lexsort((order[j], d, i))
        i, j, d = i[o], j[o], d[o]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        best_q, best_c, best_d = i[keep], j[keep], d[keep]
        n = np.bincount(best_q, minlength=len(q))
        last = np.cumsum(n) - 1
        full = n == k
        limit[full] = best_d[last[full]] if metric == "cosine" else best_d[last[full]] ** 2
    return best_q, best_c, best_d


def knn(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str | Sequence[str] = "id",
        vec_col: str = "embedding", query_id: str | Sequence[str] = "query_id", query_vec: str = "embedding",
        metric: str = "l2", query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """Top-k corpus rows per query, ties by id.  ``metric``: 'l2' or 'cosine'
    (1 - dot, for unit vectors).

    Ids may be several columns, compared in order: the result then has their
    names; a single id column comes back as ``query_id`` and ``id``.  Rows
    without a vector take no part."""
    qn, cn = _names(query_id), _names(id_col)
    q_out = ["query_id"] if len(qn) == 1 else qn
    c_out = ["id"] if len(cn) == 1 else cn
    if set(q_out) & set(c_out):
        raise ValueError("query and corpus ids need different names")
    q = queries.where(F.col(query_vec).isNotNull()).select(*[F.col(a).alias(b) for a, b in zip(qn, q_out)], F.col(query_vec).alias("_v"))
    c = corpus.where(F.col(vec_col).isNotNull()).select(*[F.col(a).alias(b) for a, b in zip(cn, c_out)], F.col(vec_col).alias("_v"))
    schema = T.StructType([*(q.schema[x] for x in q_out), *(c.schema[x] for x in c_out), T.StructField("distance", T.DoubleType())])
    nq, nc = math.ceil(q.count() / query_block), math.ceil(c.count() / corpus_block)
    if not nq or not nc:
        return corpus.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1).cast("long")).select(
            *q_out, "rank", *c_out, "distance")
    block = lambda cols, n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    spans = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("_qb", block(q_out, nq)).withColumn("_cb", spans(nc))
    c = c.withColumn("_cb", block(c_out, nc)).withColumn("_qb", spans(nq))

    def run(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({x: [] for x in (*q_out, *c_out, "distance")})
        place = np.empty(len(cs), np.int64)
        place[cs.reset_index(drop=True).sort_values(c_out, kind="stable").index.to_numpy()] = np.arange(len(cs))
        dense = lambda x: np.stack(x["_v"].to_numpy()).astype(np.float64)
        i, j, d = _block_topk(dense(qs), dense(cs), place, k, metric)
        return pd.DataFrame({**{x: qs[x].to_numpy()[i] for x in q_out}, **{x: cs[x].to_numpy()[j] for x in c_out}, "distance": d})

    cand = q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb")).applyInPandas(run, schema)
    w = Window.partitionBy(*q_out).orderBy("distance", *c_out)
    return (cand.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
                .select(*q_out, "rank", *c_out, "distance"))


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding", dim: int | None = None
              ) -> DataFrame:
    """Element-wise mean vector per group (e.g. a class centroid used as a
    query).  ``posexplode`` + partial aggregation per (group, position),
    then one bounded ``collect_list`` of ``dim`` values per group."""
    e = vectors.select(group_col, F.posexplode(vec_col).alias("pos", "v"))
    per_dim = e.groupBy(group_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return per_dim.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
