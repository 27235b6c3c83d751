"""Shards of even size that keep linked documents together: balanced label propagation
(after Ugander, Backstrom: "Balanced label propagation for partitioning massive
graphs", WSDM 2013).

Documents with equal texts are linked.  Instead of pairs, a group stands for
its links: what a document sees of its neighbours is the group's count of
documents in each shard, at most as many numbers as there are shards, however
large the group.  Documents of a group and of one of ``CHUNKS`` hash classes
of the id form a unit and move together; only groups of many more documents
have units of more than one.

Every linked unit starts in a shard given by its hash.  A round joins the
units with their groups' counts.  A group's homes are the shards with most of
its documents, as many as its bytes fill; units elsewhere propose to move to
a home.  Proposals are summed by (from, to), a table of shards x shards, and a
shard takes the share of what wants in that its quota leaves room for: a
shard's part of all bytes, less the linked bytes it holds, plus what leaves
it.  Documents without links cut no edge wherever they stand; they fill the
shards up at the end: their bytes are summed in ``BUCKETS`` hash classes,
which go, largest first, to the shard with most room.  Where linked documents
alone overfill a shard, whole groups of it take part in that too.

The driver sees tables of a fixed size only (shards x shards, shards x
classes).  Rounds end when no unit moves, at most ``rounds``.

Sizes are UTF-8 bytes plus one; a null text has none and no links, empty texts
are equal.  Null ids stand first in their shard and are dealt by the text.
Rows that repeat an id and text are documents of their own in one unit.  Texts
of any length are read once.  Other columns are not looked at.  An empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rolling import global_row_index, spread
from .common import written

CHUNKS = 1024        # hash classes of a group's documents that move as one
BUCKETS = 1 << 14    # hash classes of documents without links
GROUP_BUCKETS = 256  # hash classes of groups that an overfull shard gives away
UNIT = ["g", "g2", "chunk"]


def _share(*cols: Column | str) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, g, g2, chunk, bucket): one pass over the texts; g is null without a text."""
    text, doc = F.col(text_col), F.col(id_col).cast("long")
    return docs.select(
        doc.alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"), F.when(text.isNotNull(), F.xxhash64(text)).alias("g"),
        F.when(text.isNotNull(), F.xxhash64(F.lit("second"), text)).alias("g2"), F.pmod(F.xxhash64(doc), F.lit(CHUNKS)).cast("int").alias("chunk"),
        F.pmod(F.xxhash64(F.lit("bucket"), doc, F.when(doc.isNull(), text)), F.lit(BUCKETS)).cast("int").alias("bucket"))


def linked_units(rows: DataFrame) -> DataFrame:
    """(g, g2, chunk, n, bytes, group_n, group_bytes) of the groups of two documents or more."""
    units = rows.where("g is not null").groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = units.groupBy("g", "g2").agg(F.sum("n").alias("group_n"), F.sum("bytes").alias("group_bytes")).where("group_n > 1")
    return units.join(groups, ["g", "g2"])


def proposals(units: DataFrame, capacity: float, step: int) -> DataFrame:
    """Units with ``to``, the shard they would move to (null: stay) and ``draw``,
    which units of a group with one home share, so that they move together."""
    held = units.groupBy("g", "g2", "shard").agg(F.sum("n").alias("n"), F.first("group_bytes").alias("group_bytes"))
    rank = F.struct(-F.col("n"), F.xxhash64("g", "shard", F.lit(step)), F.col("shard").alias("shard"))
    homes = held.groupBy("g", "g2").agg(F.array_sort(F.collect_list(rank)).alias("by_count"), F.first("group_bytes").alias("b"))
    need = F.least(F.greatest(F.ceil(F.col("b") / capacity), F.lit(1)), F.size("by_count")).cast("int")
    homes = homes.select("g", "g2", F.transform(F.slice("by_count", F.lit(1), need), lambda x: x["shard"]).alias("homes"))
    at_home = F.array_contains("homes", F.col("shard"))
    pick = F.pmod(F.xxhash64(*UNIT, F.lit(step)), F.size("homes").cast("long")).cast("int") + 1
    single = F.size("homes") == 1
    return (units.join(homes, ["g", "g2"])
                 .withColumn("to", F.when(~at_home, F.element_at("homes", pick)))
                 .withColumn("draw", F.when(single, _share(F.lit(step), "g", "g2")).otherwise(_share(F.lit(step), *UNIT))).drop("homes"))


def quotas(wanted: np.ndarray, load: np.ndarray, capacity: float) -> np.ndarray:
    """Share of the bytes wanted[from, to] that each shard takes, so that no
    shard passes its capacity with what stays, leaves and comes."""
    take = np.ones(len(load))
    coming = wanted.sum(axis=0)
    for _ in range(64):   # less taken elsewhere leaves more here
        leaving = (wanted * take[None, :]).sum(axis=1)
        room = np.maximum(capacity - load + leaving, 0)
        new = np.minimum(take, np.where(coming > 0, room / np.maximum(coming, 1), 1))
        if np.allclose(new, take, atol=1e-6):
            break
        take = new
    return take


def _matrix(df: DataFrame, row: str, col: str, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in df.groupBy(row, col).agg(F.sum("bytes").alias("b")).collect():   # at most as many rows as the shape has cells
        out[r[row], r[col]] = r["b"]
    return out


def propagate(units: DataFrame, shards: int, capacity: float, rounds: int = 8) -> DataFrame:
    """The units with the shard that label propagation gives them."""
    state = written(units.withColumn("shard", F.pmod(F.xxhash64(F.lit("start"), *UNIT), F.lit(shards)).cast("int")), "units")
    for step in range(rounds):
        asked = written(proposals(state, capacity, step), "proposals")
        wanted = _matrix(asked.where("to is not null"), "shard", "to", (shards, shards))
        if not wanted.any():
            break
        load = asked.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
        held = np.zeros(shards)
        for r in load:
            held[r["shard"]] = r["b"]
        take = F.array(*[F.lit(float(x)) for x in quotas(wanted, held, capacity)])
        moves = F.col("to").isNotNull() & (F.col("draw") < F.get(take, F.col("to")))
        state = asked.withColumn("shard", F.when(moves, F.col("to")).otherwise(F.col("shard"))).drop("to", "draw")
    return written(state, "units")


def fill(loads: np.ndarray, pieces: list[tuple[int, float]]) -> dict[int, int]:
    """A shard for each (piece, bytes): largest first, to the shard with least so far."""
    loads, out = loads.copy(), {}
    for key, size in sorted(pieces, key=lambda x: (-x[1], x[0])):
        s = int(np.argmin(loads))
        out[key] = s
        loads[s] += size
    return out


def assign(rows: DataFrame, shards: int, rounds: int = 8) -> DataFrame:
    """``rows`` of ``document_rows`` with their shard."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = total / shards
    group_bucket = F.pmod(F.xxhash64(F.lit("group"), "g", "g2"), F.lit(GROUP_BUCKETS)).cast("int")
    state = propagate(linked_units(rows), shards, capacity, rounds).withColumn("group_bucket", group_bucket)
    held = _matrix(state, "shard", "group_bucket", (shards, GROUP_BUCKETS))
    loads, pieces = held.sum(axis=1), []
    for s in np.flatnonzero(loads > capacity):   # whole groups leave until the shard fits
        for b in np.argsort(held[s], kind="stable"):
            if loads[s] <= capacity or not held[s, b]:
                continue
            loads[s] -= held[s, b]
            pieces.append((-1 - int(s * GROUP_BUCKETS + b), held[s, b]))
    units = state.select(*[F.col(c).alias("u_" + c) for c in UNIT], "shard", "group_bucket")
    placed = rows.join(units, [F.col(c) == F.col("u_" + c) for c in UNIT], "left").drop(*["u_" + c for c in UNIT])
    placed = written(placed, "placed")
    free = placed.where("shard is null").groupBy("bucket").agg(F.sum("size").alias("b")).collect()   # at most BUCKETS rows
    where = fill(loads, pieces + [(r["bucket"], r["b"]) for r in free])
    if not where:
        return placed.drop("group_bucket")
    moved = rows.sparkSession.createDataFrame(sorted(where.items()), "piece long, new_shard int")
    piece = F.when(F.col("shard").isNull(), F.col("bucket")).otherwise(-1 - (F.col("shard") * GROUP_BUCKETS + F.col("group_bucket"))).cast("long")
    return (placed.withColumn("p", piece).join(F.broadcast(moved), F.col("p") == F.col("piece"), "left")   # BUCKETS + shards * GROUP_BUCKETS rows at most
                  .withColumn("shard", F.coalesce("new_shard", "shard")).drop("p", "piece", "new_shard", "group_bucket"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row; slots count from 0 in each shard, in id order."""
    if shards < 1:
        raise ValueError("need a shard")
    rows = written(document_rows(spread(docs.select(id_col, text_col)), id_col, text_col), "shard-rows")
    placed = assign(rows, shards, rounds).select("shard", "id", "size", "crc", "g", "g2", "chunk")
    spark = docs.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / 10_000)))
    indexed = global_row_index(placed, ["shard", "id", "size", "crc"], parts, index_col="at")
    counts = dict(indexed.groupBy("shard").count().collect())   # one row a shard
    begin, at = [], 0
    for s in range(shards):
        begin.append(at)
        at += counts.get(s, 0)
    starts = F.array(*[F.lit(x).cast("long") for x in begin])
    return indexed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                          (F.col("at") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def spread_of_groups(sharded: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(group, n, n_shards): documents of a group and the shards they stand in; ``groups`` has (id, group)."""
    return (groups.select(F.col(id_col).alias("g_id"), "group").join(sharded, F.col("g_id") == F.col(id_col))
                  .groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("shard").cast("long").alias("n_shards")))
