"""Ranked lexical search the other way round: the items are indexed, the documents stream.

A term is a maximal run of letters A-Z (lower-cased), a-z, digits and
characters beyond ASCII.  The items' terms form an inverted index (term ->
items with repeats), which is broadcast; each document's term counts are
looked up in it, its scores with all items that share a term are added up, and
scores that can still enter an item's heap of the k best update it.  Each task
holds one bounded heap an item and gives its content at its end; the heaps of
all tasks are merged by a window of the same bound.

All numbers but the weights are 64-bit integers.  N documents with a term, L
terms in all, df documents with the term, tf its occurrences, n a document's
terms:

    weight w = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m        = 100 - 25 + (25 n N) div L
    score    = sum over the item's terms, with repeats, of w * ((10^9 tf) div (1000 tf + 12 m))

Two passes: the first counts N, L and the df of the items' terms over all
documents, the second scores.  Before it, a hash sample of the documents is
scored: its k-th best score is a floor for every heap, so that tasks ship
only what can be in the answer.  Items are dealt into blocks by the hash of
their id so that an index holds about ``block`` items and ``block_terms``
terms; every block has its own passes.

Documents without an id count, but are not ranked; null texts have no terms.
Items without a term find nothing; the terms of rows that repeat an item's id
with other texts are taken together.  Ties go to the smaller id; rows that
repeat an id are documents of their own.  Long texts are worked through in
pieces cut between terms.  Other columns are not looked at.  Empty tables give
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rolling import spread
from .common import CHUNK_BYTES, Words, give_back, lean, runs, signed, text_buffer, written

CELLS = 1 << 21       # scores held at once in a task
PENDING = 1 << 16     # scores that wait for their heaps
FLOOR_SHARE = 1 / 32  # of the documents, scored first for the heaps' floors
_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _BREAKS[ord(_a):ord(_b) + 1] = False


class Terms(Words):
    """Terms of a run of documents, lower-cased."""

    __slots__ = ()
    BREAKS = _BREAKS

    def __init__(self, data: np.ndarray, off: np.ndarray):
        super().__init__(data, off, lower=True)


def pieces(data: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Offsets that cut a text between terms into pieces of about ``limit`` bytes."""
    cuts, at = [0], limit
    while at < len(data):
        end = at
        while end < len(data):   # the next byte that is in no term
            free = np.flatnonzero(_BREAKS[data[end:end + limit]])
            if len(free):
                end += int(free[0])
                break
            end = min(end + limit, len(data))
        cuts.append(end)
        at = end + limit
    return np.array([*cuts, len(data)] if cuts[-1] < len(data) or len(cuts) == 1 else cuts, np.int64)


def term_runs(col: pa.Array) -> Iterator[tuple[int, int, Iterator[Terms]]]:
    """(first row, end row, Terms ...) over a batch; a long text alone in several Terms of one row."""
    data, off = text_buffer(col)
    for a, b in runs(off):
        text = data[off[a]:off[b]]
        if b - a == 1 and len(text) > 2 * CHUNK_BYTES:
            cuts = pieces(text)
            yield a, b, (Terms(text[x:y], np.array([0, y - x])) for x, y in zip(cuts, cuts[1:]))
        else:
            yield a, b, iter((Terms(text, off[a:b + 1] - off[a]),))


class Index:
    """Inverted index of a block of items: two sorted 64-bit hashes a term, its
    postings (item, repeats), and, once counted, weights and floors."""

    def __init__(self, ids: np.ndarray, item: np.ndarray, key: np.ndarray, key2: np.ndarray, reps: np.ndarray):
        order = np.lexsort((item, key2, key))
        item, key, key2, reps = item[order], key[order], key2[order], reps[order]
        new = np.append(True, (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])) if len(key) else np.zeros(0, bool)
        self.ids, self.item, self.reps = ids, item, reps
        self.start = np.append(np.flatnonzero(new), len(key))
        self.key, self.key2 = key[new], key2[new]
        self.size = len(self.key)
        self.weight = self.floor = None
        self.documents = self.terms = 0

    def lookup(self, words: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(position of a word, term) of the words that are terms of an item."""
        h = words.hashes(0)
        at = np.searchsorted(self.key, h)
        hit = np.flatnonzero(self.key[np.minimum(at, self.size - 1)] == h) if self.size else np.zeros(0, np.int64)
        if not len(hit):
            return hit, hit
        at, second = at[hit], words.hashes(1)[hit]
        while True:   # terms whose first hashes are equal stand side by side
            wrong = (self.key2[at] != second) & (at + 1 < self.size)
            wrong[wrong] = self.key[at[wrong] + 1] == h[hit][wrong]
            if not wrong.any():
                break
            at = at + wrong
        ok = self.key2[at] == second
        return hit[ok], at[ok]

    def counts(self, parts: Iterator[Terms], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of the item terms in ``rows`` documents, and every document's number of terms."""
        keys, counts, total = [], [], np.zeros(rows, np.int64)
        for words in parts:
            total += np.bincount(words.row, minlength=rows)
            hit, term = self.lookup(words)
            key, n = np.unique(words.row[hit] * max(self.size, 1) + term, return_counts=True)
            keys.append(key)
            counts.append(n)
        if len(keys) == 1:
            key, n = keys[0], counts[0]
        else:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        return key // max(self.size, 1), key % max(self.size, 1), n, total

    def weigh(self, df: np.ndarray, documents: int, terms: int) -> None:
        self.documents, self.terms = documents, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        # sums of doubles are exact below 2**53; a term gives less than weight * 10**6
        most = np.bincount(self.item, np.repeat(self.weight, np.diff(self.start)) * self.reps, len(self.ids)).max(initial=0)
        self.in_doubles = most * 1e6 < 2 ** 53

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows x items) in slices of bounded size."""
        if int(total.max(initial=0)) * 25 * self.documents < 2 ** 63:
            m = 75 + 25 * total * self.documents // max(self.terms, 1)
        else:
            m = np.array([75 + 25 * int(x) * self.documents // self.terms for x in total], np.int64)
        gain = self.weight[term] * (10 ** 9 * tf // (1000 * tf + 12 * m[row]))
        width, held = len(self.ids), np.diff(self.start)
        rows = max(1, CELLS // max(width, 1))
        for a in range(0, len(total), rows):
            lo, hi = np.searchsorted(row, [a, a + rows])
            flat = np.zeros(min(rows, len(total) - a) * width, np.float64 if self.in_doubles else np.int64)
            at = lo
            while at < hi:   # postings in slices too
                size = np.cumsum(held[term[at:hi]])
                end = at + max(1, int(np.searchsorted(size, CELLS, "right")))
                n = held[term[at:end]]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                post = np.repeat(self.start[term[at:end]], n) + step
                cell = np.repeat((row[at:end] - a) * width, n) + self.item[post]
                value = np.repeat(gain[at:end], n) * self.reps[post]
                if self.in_doubles:
                    flat += np.bincount(cell, value, len(flat))
                else:
                    np.add.at(flat, cell, value)
                at = end
            yield a, flat.reshape(-1, width)


class Heaps:
    """The k best (score, smaller id) of every item."""

    def __init__(self, items: int, k: int, floor: np.ndarray | None):
        self.k, self.items = k, items
        self.floor = np.ones(items) if floor is None else np.maximum(floor, 1)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        i, j = np.nonzero(scores >= self.floor[None, :])
        if len(i):
            self.pending.append((j, scores[i, j].astype(np.int64), docs[i]))
            self.waiting += len(i)
            if self.waiting > PENDING:
                self.merge()

    def merge(self) -> None:
        item, score, doc = (np.concatenate(x) for x in zip((self.item, self.score, self.doc), *self.pending))
        self.pending, self.waiting = [], 0
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.k - 1
        self.floor[item[full]] = np.maximum(self.floor[item[full]], score[full])
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, key, key2, reps): the distinct terms of every item."""
    src = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).distinct()

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, parts in term_runs(batch.column(1)):
                for words in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][words.row]), signed(words.hashes(0)), signed(words.hashes(1))],
                                                     names=["item", "key", "key2"])

    return src.mapInArrow(work, "item long, key long, key2 long").groupBy("item", "key", "key2").agg(F.count(F.lit(1)).alias("reps"))


def _counted(docs: DataFrame, index: Index) -> Index:
    """The index with N, L and the weights of its terms, counted over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        df, documents, terms = np.zeros(index.size, np.int64), 0, 0
        for batch in batches:
            for a, b, parts in term_runs(batch.column(0)):
                _, term, _, total = index.counts(parts, b - a)
                df += np.bincount(term, minlength=index.size)
                documents += int((total > 0).sum())
                terms += int(total.sum())
        some = np.flatnonzero(df)
        # terms -1 and -2 stand for N and L
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [documents, terms]))], names=["term", "n"])

    # at most two more rows than the block has terms
    sums = {r["term"]: r["n"] for r in docs.mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    index.weigh(np.array([sums.get(t, 0) for t in range(index.size)], np.int64), sums.get(-1, 0), sums.get(-2, 0))
    return index


def _best(docs: DataFrame, index: Index, k: int) -> DataFrame:
    """(item, doc, score): the heaps of every task; item is a position in the block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(len(index.ids), k, index.floor)
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, parts in term_runs(batch.column(0)):
                for at, scores in index.scores(*index.counts(parts, b - a)):
                    heaps.offer(scores, ids[a + at:a + at + len(scores)])
        heaps.merge()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item), pa.array(heaps.doc), pa.array(heaps.score)], names=["item", "doc", "score"])

    return docs.where("doc is not null").select("text", "doc").mapInArrow(work, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", block: int = 2048, block_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, scores above 0."""
    spark = docs.sparkSession
    docs = spread(docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc")))
    terms = written(item_terms(items, item_id, item_text), "item-terms")
    n_items, n_terms = terms.agg(F.countDistinct("item"), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil(n_items / block), math.ceil(n_terms / block_terms))
    out = None
    for b in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toPandas()
        if not len(mine):
            continue
        ids, item = np.unique(mine["item"].to_numpy(np.int64), return_inverse=True)
        keys = [mine[c].to_numpy(np.int64).view(np.uint64) for c in ("key", "key2")]
        index = _counted(docs, Index(ids, item, *keys, mine["reps"].to_numpy(np.int64)))
        first = _best(docs.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(FLOOR_SHARE * (1 << 20))), index, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
        floors = first.withColumn("rank", rank).where(F.col("rank") == k).select("item", "score").collect()   # a row an item
        index.floor = np.zeros(len(ids))
        for r in floors:
            index.floor[r["item"]] = r["score"]
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
        best = _best(docs, index, k).withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], f"at long, {item_id} long")
        found = best.join(F.broadcast(names), F.col("item") == F.col("at")).select(   # the items of the block
            item_id, "rank", F.col("doc").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{item_id} long, rank int, {id_col} long, score long")
