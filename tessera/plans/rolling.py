"""Trailing row-frame windows over a *global* order without one partition.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into a
single task.  The plan here keeps the work spread out at any size:

1. ``repartitionByRange`` on the full order key (sampled boundaries, so a
   hot day / key range is split across partitions), sort within each
   partition, and ``checkpoint()`` to the shared checkpoint folder: the
   partition layout and row order are now fixed and lineage is cut, so a
   lost executor re-reads the checkpoint instead of re-sampling.
2. Dense global index: per-partition row counts (one row per partition),
   prefix-summed on that tiny table, joined back by partition id and added
   to the position inside the partition (``monotonically_increasing_id``
   minus its partition prefix).  No Python, no driver loop.
3. Blocks of ``block`` rows; the last ``halo`` rows of each block are also
   copied into the next block, so every frame of up to ``halo + 1`` rows is
   complete inside one block.  The window runs per block and only the
   block's own rows are kept.

Task size is bounded by ``block + halo`` whatever the data size or skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def materialize(df: DataFrame) -> DataFrame:
    """Compute a (small) intermediate result once and cut its lineage.

    Several outputs derived from one aggregate are otherwise re-planned
    separately: Catalyst prunes each consumer's copy of the aggregate to
    the columns it uses, so the copies differ and no exchange is reused.
    ``checkpoint()`` writes to the shared folder named by
    ``spark.checkpoint.dir``, so the result also survives executor loss."""
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy Python stage at least one partition per core.

    A scan has as many partitions as its files have splits; a small input
    with few row groups would run a NumPy / Python stage on a few cores.
    When there are fewer partitions than the default parallelism the rows
    are redistributed round-robin; otherwise (any input of real size) the
    DataFrame is returned unchanged and no shuffle is added."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def global_row_index(df: DataFrame, order_cols: list[str], num_partitions: int | None = None,
                     index_col: str = "_idx") -> DataFrame:
    """Add a dense 0-based index in the total order given by ``order_cols``.

    ``order_cols`` must form a total order (ties broken by a unique key);
    otherwise equal rows may be numbered in any order.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n, *order_cols)
                 .sortWithinPartitions(*order_cols)
                 .checkpoint(eager=True))
    tagged = ordered.select("*", F.spark_partition_id().alias("_pid"),
                            F.monotonically_increasing_id().alias("_mid"))
    # one row per partition: bounded by the partition count
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_cnt")).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .select(*df.columns, (F.col("_off") + pos).alias(index_col)))


def trailing_means(df: DataFrame, order_cols: list[str], value_col: str, sizes: list[int],
                   block: int = 1 << 20, num_partitions: int | None = None,
                   prefix: str = "ma") -> DataFrame:
    """Mean of ``value_col`` over the last ``n`` rows (this row included) in
    the global order, NULL until ``n`` rows exist; one column per size
    (``{prefix}{n}``).  Equivalent to
    ``avg(v) over (order by o rows between n-1 preceding and current row)``
    gated on a full frame."""
    halo = max(sizes) - 1
    if block <= halo:
        raise ValueError("block must exceed the largest frame")
    idx = global_row_index(df, order_cols, num_partitions)
    home = F.floor(F.col("_idx") / F.lit(block)).cast("bigint")
    in_halo = (F.col("_idx") % F.lit(block)) >= F.lit(block - halo)
    blocks = idx.withColumn("_home", home).withColumn(
        "_blk", F.explode(F.when(in_halo, F.array(F.col("_home"), F.col("_home") + 1))
                          .otherwise(F.array(F.col("_home")))))
    out = blocks
    for n in sizes:
        w = Window.partitionBy("_blk").orderBy("_idx").rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"{prefix}{n}",
                             F.when(F.count(F.col(value_col)).over(w) == n,
                                    F.avg(F.col(value_col)).over(w)))
    return out.where(F.col("_blk") == F.col("_home")).drop("_blk", "_home")
