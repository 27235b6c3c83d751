"""Parquet table scans and the canonical ``sales`` star view."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Dimension tables whose cardinality is fixed by the TPC-H definition
# (25 nations, 5 regions) at every scale, so a broadcast of them is bounded.
FIXED_SIZE_DIMENSIONS = {"nation": 25, "region": 5}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; column pruning and filters reach the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a table that heavy per-row work or several passes follow.

    A scan with fewer splits than cores (one row group per file in the
    fixtures) is spread round-robin so every later stage uses all cores;
    an input of real size has enough splits and no shuffle is added."""
    from ..plans.rolling import spread
    return spread(read_table(spark, sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def sales_view(spark: SparkSession, sf_dir: str, materialized: bool = True,
               spread_fact: bool = False) -> DataFrame:
    """The denormalised business table the reference expects as its CSV.

    order_date, product, region, segment (gender stand-in), acctbal (age
    stand-in), quantity, sales = extendedprice * (1 - discount) in DECIMAL.

    The fact table streams through a chain of joins whose other side is
    always a *base* table (orders, customer, nation, region, part), so the
    planner's size estimate for that side is its real (pruned) file size:
    small dimensions are broadcast, large ones (orders, customer and part
    at scale) get shuffle joins with AQE's skew splitting.  Joining two
    dimensions first would make the estimate a product of their sizes and
    steer the planner into broadcasting the fact table instead.  nation
    and region have a fixed size by definition and are always broadcast.

    ``materialized=True`` (the default) returns the prepared table of
    ``prepared_sales``: the join written once as Parquet in the shared
    folder, as the reference loads its table once and answers every
    question and chart from it.  Operators scan it with column pruning
    instead of repeating the joins (several of them make more than one
    pass: exact quantiles, a wide aggregate, grouping sets, min / max
    before binning), and a lost executor re-reads it instead of
    recomputing lineage.  ``materialized=False`` is the lazy join itself.
    ``spread_fact`` spreads a fact scan with fewer splits than cores
    (``read_fact``); a single pass gains less from it than the extra
    exchange costs, so only the prepared table's write uses it.
    """
    if materialized:
        return prepared_sales(spark, sf_dir)
    li = (read_fact if spread_fact else read_table)(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    na = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    rg = F.broadcast(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")

    price = F.col("l_extendedprice").cast("decimal(12,2)")
    disc = F.col("l_discount").cast("decimal(4,2)")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .join(cu, F.col("o_custkey") == cu.c_custkey)
              .join(na, F.col("c_nationkey") == na.n_nationkey)
              .join(rg, F.col("n_regionkey") == rg.r_regionkey)
              .join(pt, F.col("l_partkey") == pt.p_partkey)
              .select(
                  F.col("o_orderdate").cast("date").alias("order_date"),
                  F.col("p_name").alias("product"),
                  F.col("r_name").alias("region"),
                  F.col("c_mktsegment").alias("segment"),
                  F.col("c_acctbal").alias("acctbal"),
                  F.col("l_quantity").alias("quantity"),
                  (price * (F.lit(1).cast("decimal(4,2)") - disc)).alias("sales")))


def _fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Hash of path, length and modification time of every input file,
    nested partition folders included.  One Spark job lists all paths;
    only one row comes back."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
             .select("path", "length", "modificationTime"))
    n, mark = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.sha1(f"{'|'.join(paths)}|{n}|{mark}".encode()).hexdigest()[:20]


def prepared_sales(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The business table prepared once, like the reference's load step.

    The star join is written as Parquet under ``tables/sales-<fingerprint>``
    in the shared folder named by ``spark.checkpoint.dir`` and read back.
    The fingerprint covers the six input tables' files, so changed inputs
    give a new table; a complete table is reused by every later query and
    session that names the same folder.  Each write is a version of its own
    that counts once its success marker is there; nothing is renamed,
    overwritten or deleted, so readers of an older version are not
    disturbed and object stores without atomic renames do.  ``refresh=True``
    writes a new version, and the newest complete one is read.  Readers get
    column pruning and pushed filters, which a row checkpoint cannot give.

    Inputs are listed once a session and folder, like the reference's one
    load: inputs that change while a session runs are seen by
    ``refresh=True`` or a new session.
    """
    import time
    import uuid

    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    known = spark.__dict__.setdefault("_tessera_prepared", {})
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    if not refresh and (base, sf_dir) in known:
        done = jvm.org.apache.hadoop.fs.Path(f"{known[(base, sf_dir)]}/_SUCCESS")
        if done.getFileSystem(conf).exists(done):
            return spark.read.parquet(known[(base, sf_dir)])
    inputs = [f"{sf_dir.rstrip('/')}/{t}.parquet"
              for t in ("lineitem", "orders", "customer", "nation", "region", "part")]
    path = f"{base}/tables/sales-{_fingerprint(spark, inputs)}"
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/v-*/_SUCCESS")
    found = marker.getFileSystem(conf).globStatus(marker) or []
    versions = sorted(str(f.getPath().getParent()) for f in found)
    if refresh or not versions:
        versions = [f"{path}/v-{time.time_ns():020d}-{uuid.uuid4().hex}"]
        # spread: the written table then has at least one file per core
        sales_view(spark, sf_dir, materialized=False, spread_fact=True).write.parquet(versions[0])
    known[(base, sf_dir)] = versions[-1]
    return spark.read.parquet(versions[-1])


# Roles of the canonical view, passed explicitly (FIXTURES.md section 2).
SALES_ROLES = {
    "date": "order_date", "product": "product", "region": "region",
    "sales": "sales", "age": "acctbal", "gender": "segment",
}
