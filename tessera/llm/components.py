"""Connected components by alternating large-star and small-star joins
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edge tables counted to have at most this many rows are worked on in one task, without shuffles.
ONE_TASK = 50_000


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Every round is two aggregations with map-side combine and two joins whose
    skewed keys AQE splits; rounds grow with the logarithm of the node count.
    The table of each round is written to the shared folder.  Once at most
    ``ONE_TASK`` edges are counted the same plan runs in a single task."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        if mark[0] <= ONE_TASK:
            e = e.coalesce(1)
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                      .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                      .select("x.u", "x.v").where("u > v").distinct())
        e = written(small, "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
