"""Approximate nearest-neighbour search with an inverted-file index.

Build.  Cell centres are found by Lloyd rounds: every task adds up its rows by
nearest centre, the sums are merged by cell.  The residual of a vector to its
centre is cut into ``subspaces`` parts, and each part is coded by the nearest
of at most 256 code vectors, a byte a part (product quantisation); the code
books are fitted one subspace a task.  Both are fitted on at most ``fit_rows``
rows, chosen by hash; every row is then indexed.  The index is a Parquet table
partitioned by cell (id, code, vector) with the small model tables beside it.

Search.  A query probes the ``probes`` nearest cells, and only their folders
are read.  Query rows and index rows of a cell are dealt into blocks of
bounded size; a task compares one pair of blocks by table lookups on the
codes and gives the ``rerank`` nearest a query.  A window keeps ``rerank`` of
all tasks, their vectors are joined, and exact distances decide.

``probes_for`` measures recall against exact search on a bounded sample of the
queries and doubles the probed cells until the floor is reached; at all cells
only the code's error is left, which a larger ``rerank`` lowers.

Rows whose vector is null, of another length than most, or holds a null or
non-finite component are neither indexed nor searched for.  Equal distances go
by id.  Rows that repeat an id are indexed each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rolling import spread
from .vector import knn

CELL_BLOCK, QUERY_BLOCK, TILE = 16384, 512, 2048   # rows
MAX_CELLS, CODES = 4096, 256


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), np.int32)
    half = (centres * centres).sum(axis=1) / 2
    for a in range(0, len(x), TILE):
        far = half[None, :] - x[a:a + TILE] @ centres.T
        some = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(far), 1))
        out[a:a + TILE] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)
    return out


class Model:
    """Cell centres [cells, dim] and code books [subspaces, codes, dim / subspaces]."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def parts(self, rest: np.ndarray) -> np.ndarray:
        """Residuals cut into subspaces, the last filled up with zeros."""
        subs, _, width = self.books.shape
        return np.pad(rest, ((0, 0), (0, subs * width - rest.shape[1]))).reshape(len(rest), subs, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)[:, 0]
        parts = self.parts(x - self.centres[cell])
        return cell, np.stack([nearest(np.ascontiguousarray(parts[:, s]), b)[:, 0] for s, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def code_distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances [queries, rows] between queries and coded rows of a cell."""
        parts = self.parts(q - self.centres[cell][None, :])
        out = np.zeros((len(q), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            out += ((parts[:, s, None, :] - book[None, :, :]) ** 2).sum(axis=2)[:, codes[:, s]]
        return out


def clean(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of the rows that take part."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim) & fine).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def _lloyd(rows: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after ``rounds`` rounds; tasks send one row a cell."""
    dim = centres.shape[1]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape)
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                cell = nearest(x, c)[:, 0]
                n += np.bincount(cell, minlength=len(c))
                np.add.at(sums, cell, x)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))],
                                             names=["cell", "n", "sums"])

        merged = (rows.select("vec").mapInArrow(work, "cell long, n long, sums array<double>").groupBy("cell")
                      .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dim)]).alias("sums")))
        new = centres.copy()
        for r in merged.collect():   # a row a cell
            new[r["cell"]] = np.array(r["sums"]) / r["n"]
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def _books(rows: DataFrame, centres: np.ndarray, subspaces: int, rounds: int) -> np.ndarray:
    """Code books, fitted one subspace a task on the residuals of the fitting rows."""
    dim, width = centres.shape[1], math.ceil(centres.shape[1] / subspaces)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            rest = x - c[nearest(x, c)[:, 0]]
            parts = np.pad(rest, ((0, 0), (0, subspaces * width - dim))).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(subspaces), len(x))), pa.array(list(parts), pa.list_(pa.float32()))],
                                             names=["sub", "part"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["part"].to_numpy()).astype(np.float32)
        book = np.unique(x, axis=0)
        if len(book) > CODES:
            book = book[np.random.default_rng(7).permutation(len(book))[:CODES]]
            for _ in range(rounds):
                code = nearest(x, book)[:, 0]
                n, sums = np.bincount(code, minlength=len(book)), np.zeros(book.shape)
                np.add.at(sums, code, x)
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book).astype(np.float32)
        return pd.DataFrame({"sub": int(part["sub"].iloc[0]), "code": np.arange(len(book)), "vec": list(book)})

    got = rows.select("vec").mapInArrow(cut, "sub long, part array<float>").groupBy("sub").applyInPandas(fit, "sub long, code long, vec array<float>")
    books = np.zeros((subspaces, CODES, width), np.float32)
    for r in sorted(got.collect(), key=lambda r: (r["sub"], r["code"])):   # subspaces x 256 rows
        # codes that do not exist repeat the first
        books[r["sub"], slice(None) if r["code"] == 0 else r["code"]] = np.array(r["vec"], np.float32)
    return books


class AnnIndex:
    """An index read back from its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        centres = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()        # bounded by MAX_CELLS
        books = spark.read.parquet(f"{self.path}/books").orderBy("sub", "code").collect()     # subspaces x CODES
        subs = 1 + max((r["sub"] for r in books), default=0)
        self.model = Model(np.array([r["vec"] for r in centres], np.float32).reshape(len(centres), -1),
                           np.array([r["vec"] for r in books], np.float32).reshape(subs, CODES, -1))
        self.sizes = {r["cell"]: r["n"] for r in centres}
        self.rows = spark.read.schema(f"id {centres[0]['id_type'] if centres else 'long'}, code binary, vec array<float>, cell int").parquet(f"{self.path}/cells")


def build(vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, subspaces: int = 16,
          fit_rows: int = 50_000, rounds: int = 8) -> AnnIndex:
    """Index ``vectors`` under ``path`` (a new folder in shared storage)."""
    spark = vectors.sparkSession
    dim = vectors.where(F.size(vec_col) > 0).agg(F.mode(F.size(vec_col))).first()[0] or 1
    rows = clean(spread(vectors.select(id_col, vec_col)), id_col, vec_col, dim)
    total = rows.count()
    share = min(1.0, fit_rows / max(total, 1))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "vec").checkpoint()
    cells = max(1, min(cells or math.ceil(math.sqrt(total)), MAX_CELLS))
    first = some.groupBy("vec").agg(F.min(F.xxhash64("id")).alias("o")).orderBy("o").limit(cells).collect()
    centres = np.array([r["vec"] for r in first], np.float32).reshape(-1, dim) if first else np.zeros((1, dim), np.float32)
    centres = _lloyd(some, centres, rounds)
    model = Model(centres, _books(some, centres, min(subspaces, dim), rounds))
    shared = spark.sparkContext.broadcast(model)
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            cell, code = m.encode(_matrix(batch.column(1), m.dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1), pa.array(cell, pa.int32())],
                                             names=["id", "code", "vec", "cell"])

    coded = rows.mapInArrow(work, f"id {id_type}, code binary, vec array<float>, cell int")
    # a cell of many rows is written by several tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(total / CELL_BLOCK / max(1, len(centres))))))
    coded.repartition(parts, "cell", salt).write.partitionBy("cell").parquet(f"{path}/cells")
    n = {r["cell"]: r["count"] for r in spark.read.parquet(f"{path}/cells").groupBy("cell").count().collect()} if total else {}
    spark.createDataFrame([(i, n.get(i, 0), id_type, c.tolist()) for i, c in enumerate(centres)],
                          "cell int, n long, id_type string, vec array<float>").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(s, c, v.tolist()) for s, b in enumerate(model.books) for c, v in enumerate(b)],
                          "sub int, code int, vec array<float>").coalesce(1).write.parquet(f"{path}/books")
    return AnnIndex(spark, path)


def search(index: AnnIndex, queries: DataFrame, k: int = 10, probes: int = 8, rerank: int = 100, query_id: str = "query_id",
           query_vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): about the k nearest rows by Euclidean distance."""
    spark, model = queries.sparkSession, index.model
    q_type = queries.schema[query_id].dataType.simpleString()
    id_type = index.rows.schema["id"].dataType.simpleString()
    probes = min(probes, len(model.centres))
    shared = spark.sparkContext.broadcast(model)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            cell = nearest(_matrix(batch.column(1), m.dim), m.centres, probes)
            at = pa.array(np.repeat(np.arange(len(cell)), probes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.ravel(), pa.int32())],
                                             names=["q", "q_vec", "cell"])

    asked = (clean(queries, query_id, query_vec, model.dim).mapInArrow(probe, f"q {q_type}, q_vec array<float>, cell int").checkpoint())
    per_cell = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}   # at most a row a cell
    wanted = [c for c in sorted(per_cell) if index.sizes.get(c)]
    rows = index.rows.where(F.col("cell").isin(wanted)) if wanted else index.rows.limit(0)
    blocks = spark.createDataFrame([(c, math.ceil(per_cell[c] / QUERY_BLOCK), math.ceil(index.sizes[c] / CELL_BLOCK)) for c in wanted],
                                   "b_cell int, nq int, nc int")
    block = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(blocks), F.col("cell") == F.col("b_cell")).withColumn("qb", block("q", "nq")).withColumn("cb", every("nc"))
    right = (rows.select("id", "code", "cell").join(F.broadcast(blocks), F.col("cell") == F.col("b_cell"))
                 .withColumn("cb", block("id", "nc")).withColumn("qb", every("nq")).select("id", "code", "cell", "qb", "cb"))

    def compare(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"q": [], "id": [], "cell": [], "near": []})
        m, cell = shared.value, int(qs["cell"].iloc[0])
        q = np.stack(qs["q_vec"].to_numpy()).astype(np.float32)
        codes = np.frombuffer(b"".join(cs["code"]), np.uint8).reshape(len(cs), -1)
        i = j = np.zeros(0, np.int64)
        d = np.zeros(0, np.float32)
        for a in range(0, len(codes), TILE):
            far = m.code_distances(q, cell, codes[a:a + TILE])
            n = min(rerank, far.shape[1])
            some = np.argpartition(far, n - 1, axis=1)[:, :n]
            i = np.concatenate([i, np.repeat(np.arange(len(q)), n)])
            j = np.concatenate([j, some.ravel() + a])
            d = np.concatenate([d, np.take_along_axis(far, some, axis=1).ravel()])
            o = np.lexsort((d, i))
            i, j, d = i[o], j[o], d[o]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < rerank
            i, j, d = i[keep], j[keep], d[keep]
        return pd.DataFrame({"q": qs["q"].to_numpy()[i], "id": cs["id"].to_numpy()[j], "cell": cell, "near": d.astype(np.float64)})

    found = left.groupBy("cell", "qb", "cb").cogroup(right.groupBy("cell", "qb", "cb")).applyInPandas(
        compare, f"q {q_type}, id {id_type}, cell int, near double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("near", "id"))).where(F.col("r") <= rerank)
    # merge joins: the vectors, small as their files may be, do not pass through the driver for a broadcast
    vecs = rows.select(F.col("id").alias("v_id"), F.col("cell").alias("v_cell"), "vec").hint("merge")
    asked_vecs = asked.select(F.col("q").alias("a_q"), F.col("cell").alias("a_cell"), "q_vec").hint("merge")
    square = F.aggregate(F.zip_with("q_vec", "vec", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))),
                         F.lit(0.0), lambda s, x: s + x)
    exact = (best.join(vecs, (F.col("id") == F.col("v_id")) & (F.col("cell") == F.col("v_cell")))
                 .join(asked_vecs, (F.col("q") == F.col("a_q")) & (F.col("cell") == F.col("a_cell"))).withColumn("distance", F.sqrt(square)))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")).cast("long")
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "id", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, k, hits) for each query of ``exact``: how many found rows are as near as its last one."""
    last = exact.groupBy(F.col("query_id").alias("e_q")).agg(F.max("distance").alias("last"), F.count(F.lit(1)).alias("k"))
    hit = F.count(F.when(F.col("distance") <= F.col("last") * (1 + 1e-6) + 1e-9, 1))
    return (last.join(found, F.col("query_id") == F.col("e_q"), "left").groupBy("e_q", "k").agg(F.least(hit, F.col("k")).alias("hits"))
                .select(F.col("e_q").alias("query_id"), "k", "hits"))


def probes_for(index: AnnIndex, vectors: DataFrame, queries: DataFrame, k: int, floor: float, id_col: str, vec_col: str, query_id: str,
               query_vec: str, rerank: int = 100, sample: int = 200) -> tuple[int, float]:
    """(probes, recall): cells to probe, doubled from four until the floor is reached on at most ``sample`` queries, chosen by hash."""
    dim = index.model.dim
    some = (clean(queries, query_id, query_vec, dim).withColumnRenamed("id", "query_id").orderBy(F.xxhash64("query_id")).limit(sample).checkpoint())
    exact = knn(clean(vectors, id_col, vec_col, dim), some, k, vec_col="vec", query_vec="vec").checkpoint()
    probes = min(4, len(index.model.centres))
    while True:
        got = recall(search(index, some, k, probes, rerank, query_vec="vec"), exact).agg(F.sum("hits"), F.sum("k")).first()
        if probes >= len(index.model.centres) or not got[1] or got[0] >= floor * got[1]:
            return probes, (got[0] / got[1] if got[1] else 1.0)
        probes = min(2 * probes, len(index.model.centres))
