"""Exact substring deduplication on a sparse de Bruijn graph of word k-mers.

A window is ``window`` consecutive words of one document.  A word goes if a
window covers it whose word sequence also starts earlier (smaller id, or same
document and earlier start); windows are judged on the input.

Edges.  Every window is represented by its smallest k-mer hash (leftmost of
equals).  Windows with the same words have the same representative at the same
place, so only these k-mers, about 2 / (window - k + 2) of all, become edges.

Compaction.  The run of consecutive windows that share one edge occurrence is
a path; its words are hashed a second time, independently.  Occurrences of an
edge whose paths agree form one nonbranching path: all of their windows have
the same occurrences, so one comparison of source coordinates (id, start)
decides them together, and each occurrence but the first is a repeated span.
Only where paths of one edge differ (the ends of repeated passages) are the
windows of the distinct paths compared one by one, in a second round that
reads the words again at the source coordinates.  A repeated span is accepted
only if edge hash and path hash agree, 128 independent bits.

Plan.  Tasks collapse equal paths of their own documents first, so copies send
one row a task; rows travel as packed arrays, one for each bucket of edge
hashes, and a bucket's task sorts them.  Edges that a sample of the documents
shows to be very frequent (a line in a large part of all documents) are sent
as single windows instead, which spreads them over the buckets; the sample
decides the route only, never the result.

Null texts have no words.  Rows with a null id are kept whole and are no
source.  Rows that repeat an id are copies of the same document: equal starts
are not earlier.  Other columns are carried; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, fresh, lean, mix, word_runs, written

FLUSH_ROWS = 400_000
BUCKET_BYTES = 32 << 20      # text bytes whose edges share a bucket
SAMPLE_DOCS = 20_000         # documents sampled for the routing of frequent edges
HOT_EDGES = 50_000           # edges routed window by window at most
PACKED = "bucket int, keys binary, paths binary, docs binary, starts binary, counts binary"


def paths_of(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge hash, first window, number of windows) of every path."""
    at = words.whole(window)
    empty = np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), empty, empty
    h = words.windows(k)
    bits = U64(max(20, len(h).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    reach, need = 1, window - k + 1
    while reach * 2 <= need:     # smallest of 2, 4, 8 ... neighbours
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < need:
        low = np.minimum(low[:len(low) - (need - reach)], low[need - reach:])
    edge = (low[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.concatenate([[True], (edge[1:] != edge[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    return h[edge[first]], at[first], np.diff(np.concatenate([first, [len(at)]]))


class Rows:
    """Columns key, path, doc, start, count of path occurrences."""

    KINDS = (np.uint64, np.uint64, np.int64, np.int32, np.uint8)

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, key, path, doc, start, count) -> None:
        if len(key):
            self.parts.append((key, path, doc, start.astype(np.int32), count.astype(np.uint8)))
            self.size += len(key)

    def sorted(self) -> list[np.ndarray]:
        cols = [np.concatenate(c) if self.parts else np.zeros(0, k)
                for c, k in zip(zip(*self.parts) if self.parts else [()] * 5, self.KINDS)]
        o = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        return [c[o] for c in cols]


def split_first(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(is first of its path, repeats an earlier start) of sorted rows."""
    key, path, doc, start, _ = cols
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (path[1:] != path[:-1])])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return first, (doc != doc[head]) | (start != start[head])


def _pack(rows: Rows, buckets: int) -> pa.RecordBatch:
    """Collapse a task's rows and pack them by bucket; repeated spans go into bucket -1."""
    cols = rows.sorted()
    first, later = split_first(cols)
    bucket = np.where(first, (mix(cols[0]) % U64(buckets)).astype(np.int64), -1)
    keep = first | later
    bucket, cols = bucket[keep], [c[keep] for c in cols]
    o = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[o], [c[o] for c in cols]
    names, cut = np.unique(bucket, return_index=True)
    cut = np.append(cut, len(bucket))
    blobs = [pa.array([c[cut[i]:cut[i + 1]].tobytes() for i in range(len(names))], pa.binary()) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *blobs],
                                      names=["bucket", "keys", "paths", "docs", "starts", "counts"])


def _resolve(t: pa.Table) -> pa.Table:
    """One bucket: repeated spans (kind 0) and first paths of branching edges (kind 1)."""
    rows = Rows()
    cols = [np.frombuffer(b"".join(t.column(c).to_pylist()), k)
            for c, k in zip(("keys", "paths", "docs", "starts", "counts"), Rows.KINDS)]
    rows.add(*cols)
    key, _, doc, start, count = cols = rows.sorted()
    first, later = split_first(cols)
    edge = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else first
    branches = np.add.reduceat(first.astype(np.int64), np.flatnonzero(edge)) if len(key) else np.zeros(0, np.int64)
    mixed = np.repeat(branches > 1, np.diff(np.append(np.flatnonzero(edge), len(key)))) if len(key) else first
    out = later | (first & mixed)
    return pa.table({"doc": pa.array(doc[out]), "start": pa.array(start[out]), "n": pa.array(count[out].astype(np.int32)),
                     "kind": pa.array(np.where(later, 0, 1)[out].astype(np.int8))})


FOUND = "doc long, start int, n int, kind byte"


def _reduce(packed: DataFrame) -> DataFrame:
    """Bucket rows -> FOUND rows.  Spans that a task has decided itself (bucket -1) are only unpacked."""
    @lean
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, s, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc = np.frombuffer(d, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(np.frombuffer(s, np.int32)), pa.array(np.frombuffer(c, np.uint8).astype(np.int32)),
                     pa.array(np.zeros(len(doc), np.int8))], names=["doc", "start", "n", "kind"])

    here = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(_resolve, FOUND)
    done = packed.where("bucket < 0").select("docs", "starts", "counts").mapInArrow(unpack, FOUND)
    return here.unionByName(done)


def _path_hash(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return words.spans(a, b, which=1)


def edges(docs: DataFrame, window: int, k: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed path occurrences of (doc, text) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, rows = shared.value, Rows()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, words in word_runs(batch.column(1)):
                key, at, count = paths_of(words, window, k)
                if not len(key):
                    continue
                row = words.row[at]
                doc, start = ids[a:b][row], at - words.first[row]
                path = _path_hash(words, at, at + count + window - 1)
                is_hot = np.zeros(len(key), bool)
                if len(hot_keys):
                    is_hot = hot_keys[np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)] == key
                cold = ~is_hot
                rows.add(key[cold], path[cold], doc[cold], start[cold], count[cold])
                if is_hot.any():
                    n = count[is_hot]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    w = np.repeat(at[is_hot], n) + step
                    rows.add(words.spans(w, w + window), _path_hash(words, w, w + window), np.repeat(doc[is_hot], n),
                             np.repeat(start[is_hot], n) + step, np.ones(len(w), np.uint8))
                if rows.size >= FLUSH_ROWS:
                    yield _pack(rows, buckets)
                    rows = Rows()
        if rows.size:
            yield _pack(rows, buckets)

    return docs.mapInArrow(work, PACKED)


def windows_at(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed single windows of (doc, text, at) rows; at: array of (start, n)."""
    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, words in word_runs(batch.column(1)):
                part = batch.column(2).slice(a, b - a)
                size = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(b - a), size)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, start = np.repeat(row, n), np.repeat(start, n) + step
                w = words.first[row] + start
                ok = w + window <= words.first[row + 1]
                w, row, start = w[ok], row[ok], start[ok]
                rows.add(words.spans(w, w + window), _path_hash(words, w, w + window), ids[a:b][row], start,
                         np.ones(len(w), np.uint8))
                if rows.size >= FLUSH_ROWS:
                    yield _pack(rows, buckets)
                    rows = Rows()
        if rows.size:
            yield _pack(rows, buckets)

    return docs.mapInArrow(work, PACKED)


def frequent_edges(docs: DataFrame, window: int, k: int, total: int) -> np.ndarray:
    """Sorted hashes of the edges in at least 1/200 of the sampled documents with several paths."""
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    few = docs.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(share * 1_000_000))

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_runs(batch.column(1)):
                key, at, count = paths_of(words, window, k)
                path = _path_hash(words, at, at + count + window - 1)
                pair = np.unique(np.stack([key, path], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
                key, n = np.unique(pair[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    least = max(50, int(min(total, SAMPLE_DOCS) / 200))
    top = (few.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
              .orderBy(F.desc("n"), "key").limit(HOT_EDGES).collect())
    return np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc, start, n): runs of n windows from word ``start`` on, each of which starts earlier elsewhere."""
    total, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((chars or 0) / BUCKET_BYTES))
    hot = frequent_edges(docs, window, k, total)
    found = written(_reduce(edges(docs, window, k, buckets, hot)), "spans")
    branching = (found.where("kind = 1").groupBy(F.col("doc").alias("b_doc"))
                      .agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("at")))
    again = docs.join(branching, F.col("doc") == F.col("b_doc")).select("doc", "text", "at")
    more = _reduce(windows_at(again, window, buckets)).where("kind = 0")
    return found.where("kind = 0").unionByName(more).select("doc", "start", "n")


def dedup(docs: DataFrame, window: int = 20, k: int = 8, id_col: str = "doc_id", text_col: str = "text",
          out_col: str = "kept") -> DataFrame:
    """The input's columns, ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space."""
    if not 1 <= k <= window <= 200:
        raise ValueError("need 1 <= k <= window <= 200")
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spans = repeated_spans(src, window, k)
    s_doc, at, done_col = fresh(docs, "s_doc", "spans", "done")
    by_doc = spans.groupBy(F.col("doc").alias(s_doc)).agg(F.collect_list(F.struct("start", "n")).alias(at))
    joined = docs.join(by_doc, F.col(id_col) == F.col(s_doc), "left")
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                         T.StructField(out_col, T.StringType())])

    @lean
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            done = []
            for a, b, words in word_runs(texts):
                part = spans.slice(a, b - a)
                size = np.nan_to_num(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = part.flatten()
                start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(b - a), size)
                lo = np.minimum(words.first[row] + start, words.first[row + 1])
                hi = np.minimum(lo + n + window - 1, words.first[row + 1])
                cover = np.bincount(lo, minlength=len(words) + 1) - np.bincount(hi, minlength=len(words) + 1)
                keep = np.cumsum(cover)[:len(words)] <= 0
                left = np.bincount(words.row[keep], minlength=b - a)
                total = np.diff(words.first)
                done.append(pa.StructArray.from_arrays([pa.array(total), pa.array(total - left), _join(words, keep, b - a)],
                                                       names=["n_words", "n_removed", out_col]))
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct(
                [("n_words", pa.int64()), ("n_removed", pa.int64()), (out_col, pa.string())]))

    out = joined.withColumn(done_col, F.arrow_udf(work, kind).asNondeterministic()(text_col, at))
    made = ("n_words", "n_removed", out_col)
    return out.select(*[c for c in docs.columns if c.lower() not in made], *[f"{done_col}.{c}" for c in made])


def _join(words: Words, keep: np.ndarray, rows: int) -> pa.Array:
    """Each row's kept words joined by one space."""
    start, end, row = words.start[keep], words.end[keep], words.row[keep]
    size = end - start + 1                       # with the space after it
    out_end = np.cumsum(size)
    at = np.repeat(start - (out_end - size), size) + np.arange(out_end[-1] if len(size) else 0)
    data = np.append(words.data, np.uint8(32))[at] if len(at) else np.zeros(0, np.uint8)
    data[out_end - 1] = 32
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, np.int64)
    solid = np.ones(len(data), bool)
    solid[out_end[last] - 1] = False
    length = np.bincount(row, size, minlength=rows).astype(np.int64)
    length[row[last]] -= 1
    off = np.concatenate([[0], np.cumsum(length)])
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[solid].tobytes())).cast(pa.string())
