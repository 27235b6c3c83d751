"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, junk or abstain on every document.
Expectation-maximisation (Dawid and Skene, 1979) estimates how often each
labeller casts each vote on good and on junk documents; it needs only the
number of documents for each combination of votes, which is one aggregation
over all documents (at most 3 ** labellers rows).  The posterior of a
combination labels its documents, and a hashed linear scorer (logistic, soft
labels) learns these labels from ``fit_rows`` documents at most: of those with a
posterior below 0.5 and of the others apart, the ones with the smallest hashes
of their text.  The scorer then scores every whole document.  If one side has
fewer than ``LEAST_ROWS`` different texts there is nothing to learn it from, and
the posterior of a document's votes is its score.

Labellers look at the share of symbols, capitals, words that repeat the word
before, repeated word triples, words without letters or digits, and at
symbols glued to the ends of words.  The scorer's inputs are hashed: shares
of character-class triples and bins of the labellers' statistics.

Null or empty texts (no words) are rejected with score 0.  A corpus in which no
labeller votes junk keeps everything that has words.  Repeated rows are
separate votes.  Other columns are carried; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, lean, mix, runs, text_buffer, word_runs, written

DIM = 1 << 12
FIT_ROWS = 4_000
LEAST_ROWS = 50           # different texts that the scorer needs of either side

# character classes: lower, capital, digit, space, line feed, sentence marks, symbols, beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 5

#: (statistic, junk from, good below): fixed values of the labellers.
LABELLERS = (
    ("symbols", 0.06, 0.02),
    ("capitals", 0.40, 0.15),
    ("stutter", 0.25, 0.05),
    ("repeats", 0.50, 0.25),
    ("bare", 0.15, 0.03),
    ("glued", 0.25, 0.05),
)
BINS = np.array([0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(words: Words, rows: int) -> np.ndarray:
    """(rows, labellers) statistics, each a share between 0 and 1."""
    data, row, n = words.data, words.row, np.diff(words.first)
    cls = _CLASS[data]
    byte_at = np.concatenate([[0], np.cumsum(cls == 6)]), np.concatenate([[0], np.cumsum(cls == 1)]), \
        np.concatenate([[0], np.cumsum((cls <= 1) | (cls == 7))]), np.concatenate([[0], np.cumsum((cls <= 2) | (cls == 7))])
    in_words = lambda c: np.bincount(row, c[words.end] - c[words.start], minlength=rows)
    chars = np.bincount(row, words.end - words.start, minlength=rows)
    sym, cap, alpha, alnum = byte_at
    h = words.hashes()
    prev = np.zeros(len(h), bool)
    prev[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    at = words.whole(3)
    t = words.windows(3)[at]
    o = np.lexsort((t, row[at]))
    ts, tr = t[o], row[at][o]
    again = np.zeros(len(ts), bool)
    again[1:] = (ts[1:] == ts[:-1]) & (tr[1:] == tr[:-1])
    last = cls[words.end - 1] == 6 if len(h) else np.zeros(0, bool)
    last &= (words.end - words.start) > 1
    bare = alnum[words.end] == alnum[words.start]
    return np.stack([
        _share(in_words(sym), chars),
        _share(in_words(cap), in_words(alpha)) * (in_words(alpha) >= 12),
        _share(np.bincount(row, prev, minlength=rows), n - 1),
        _share(np.bincount(tr, again, minlength=rows), n - 2),
        _share(np.bincount(row, bare, minlength=rows), n),
        _share(np.bincount(row, last, minlength=rows), n),
    ], axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    """0 abstain, 1 junk, 2 good."""
    junk = np.array([x[1] for x in LABELLERS])
    good = np.array([x[2] for x in LABELLERS])
    return np.where(stats >= junk, 1, np.where(stats < good, 2, 0))


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def inputs(words: Words, rows: int, stats: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Dense (rows, DIM) hashed inputs of a run of documents."""
    cls = _CLASS[words.data].astype(np.int64)
    x = np.zeros((rows, DIM), np.float32)
    if len(cls) > 2:
        tri = (cls[:-2] * 8 + cls[1:-1]) * 8 + cls[2:]
        row = np.repeat(np.arange(rows), np.diff(off))
        ok = row[:-2] == row[2:]
        count = np.bincount(row[:-2][ok] * 512 + tri[ok], minlength=rows * 512).reshape(rows, 512)
        slot = (mix(np.arange(512, dtype=np.uint64) + U64(1)) % U64(DIM)).astype(np.int64)
        np.add.at(x, (slice(None), slot), np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1)).astype(np.float32))
    for j in range(stats.shape[1]):
        b = np.searchsorted(BINS, stats[:, j], "right")
        slot = (mix((b + 100 * (j + 1) + 1000).astype(np.uint64)) % U64(DIM)).astype(np.int64)
        x[np.arange(rows), slot] += 1
    return x


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> np.ndarray:
    """Posterior of good for each vote pattern, by EM over the pattern counts.

    Starts from the majority of votes; a labeller's junk votes stay likelier
    on junk than on good documents (and good votes the other way round), so
    the classes cannot swap.  An abstention is no junk vote: combinations
    without one stay at 0.95 or more, else the junk class of a corpus with
    next to no junk would drift to the clean documents with abstentions."""
    v = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    junk, good = (v == 1).sum(axis=1), (v == 2).sum(axis=1)
    post = np.where(junk == 0, 0.95, np.where(junk * 2 >= good, 0.05, 0.3))
    if not (junk > 0).any():
        return np.ones(len(patterns))
    for _ in range(rounds):
        table = np.empty((2, labellers, 3))
        for y, wy in enumerate((1 - post, post)):
            for k in range(3):
                table[y, :, k] = ((v == k) * (wy * counts)[:, None]).sum(axis=0) + 0.5
            table[y] /= table[y].sum(axis=1, keepdims=True)
        hi, lo = np.maximum(table[0, :, 1], table[1, :, 1]), np.minimum(table[0, :, 1], table[1, :, 1])
        table[0, :, 1], table[1, :, 1] = hi, lo
        prior = np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99)
        log = [np.log(p) + sum(np.log(table[y, j, v[:, j]]) for j in range(labellers))
               for y, p in enumerate((1 - prior, prior))]
        new = np.maximum(1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))), np.where(junk == 0, 0.95, 0.0))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (bias last) on soft labels by Adam; the rows below 0.5
    and the others weigh alike, so what is left to junk of many nearly certain
    good rows does not stand in for junk."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    side = y < 0.5
    each = np.where(side, 1 / max(side.sum(), 1), 1 / max((~side).sum(), 1))
    pos, neg = each * y, each * (1 - y)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -50, 50)))
        g = x.T @ ((neg * p - pos * (1 - p)) / 2).astype(np.float32) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8) * (1 - t / (rounds + 1))
    return w


def _slices(col: pa.Array, limit: int = 256) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(first row, Words, offsets) of at most ``limit`` rows each, as inputs are dense."""
    data, off = text_buffer(col)
    for a, b in runs(off):
        for lo in range(a, b, limit):
            hi = min(b, lo + limit)
            part = off[lo:hi + 1] - off[lo]
            yield lo, Words(data[off[lo]:off[hi]], part), part


def vote_patterns(docs: DataFrame, text_col: str) -> DataFrame:
    """(pattern, h) of every document that has words, h the hash of its text."""
    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_runs(batch.column(0)):
                has = np.diff(words.first) > 0
                p = pattern(votes(statistics(words, b - a)))[has]
                yield pa.RecordBatch.from_arrays([pa.array(p), batch.column(1).slice(a, b - a).filter(pa.array(has))], names=["pattern", "h"])

    return docs.select(text_col, F.xxhash64(text_col).alias("h")).mapInArrow(work, "pattern long, h long")


def classify(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS, score_col: str = "quality_score") -> DataFrame:
    """The documents' columns and the score (0 to 1, higher: better; below 0.5: rejected)."""
    spark = docs.sparkSession
    k = len(LABELLERS)
    voted = written(vote_patterns(docs, text_col), "votes")
    counted = sorted((r[0], r[1]) for r in voted.groupBy("pattern").count().collect())  # 3 ** k rows at most
    seen = np.array([r[0] for r in counted], np.int64)
    post = fit_labellers(seen, np.array([r[1] for r in counted], float), k) if counted else np.zeros(0)
    posterior = dict(zip(seen.tolist(), post.tolist()))
    shared = spark.sparkContext.broadcast((posterior, _fit(docs, text_col, voted, posterior, fit_rows)))

    @lean
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, w = shared.value
        for col in batches:
            score = np.zeros(len(col))
            for at, sub, off in _slices(col):
                stats = statistics(sub, len(off) - 1)
                if w is None:
                    s = np.array([known.get(i, 1.0) for i in pattern(votes(stats)).tolist()])
                else:
                    z = inputs(sub, len(off) - 1, stats, off) @ w[:-1].astype(np.float32) + w[-1]
                    s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                score[at:at + len(s)] = np.where(np.diff(sub.first) > 0, s, 0.0)
            yield pa.array(score)

    # not deterministic to the optimizer: a filter on the score must not compute it twice
    return docs.withColumn(score_col, F.arrow_udf(work, T.DoubleType()).asNondeterministic()(text_col))


def _fit(docs: DataFrame, text_col: str, voted: DataFrame, posterior: dict[int, float], fit_rows: int) -> np.ndarray | None:
    """Weights from the documents with the smallest text hashes of either side,
    or None if a side is too small; only their hashed inputs reach the driver."""
    sides = [[p for p, y in posterior.items() if (y < 0.5) == junk] for junk in (True, False)]
    if not all(sides):
        return None
    junk, good = ([r["h"] for r in voted.where(F.col("pattern").isin(side)).select("h").distinct().orderBy("h").limit(fit_rows).collect()]
                  for side in sides)
    if min(len(junk), len(good)) < LEAST_ROWS:
        return None
    # half of each, or more of one if the other has less
    junk = junk[:max(fit_rows // 2, fit_rows - len(good))]
    few = docs.sparkSession.createDataFrame([(h,) for h in junk + good[:fit_rows - len(junk)]], "h long")

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sub, off in _slices(batch.column(0)):
                stats = statistics(sub, len(off) - 1)
                x = inputs(sub, len(off) - 1, stats, off)
                p = pattern(votes(stats))
                has = np.flatnonzero(np.diff(sub.first) > 0)
                slots = [np.flatnonzero(r) for r in x[has]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([posterior.get(i, 0.5) for i in p[has].tolist()], pa.float64()),
                     pa.array([s.astype(np.int32).tobytes() for s in slots], pa.binary()),
                     pa.array([x[i][s].tobytes() for i, s in zip(has, slots)], pa.binary())],
                    names=["y", "slot", "value"])

    sample = (docs.select(text_col, F.xxhash64(text_col).alias("h")).join(F.broadcast(few), "h", "left_semi")
                  .select(text_col).dropDuplicates([text_col]))
    rows = sample.mapInArrow(work, "y double, slot binary, value binary").collect()
    slots = [np.frombuffer(r["slot"], np.int32) for r in rows]
    used = np.unique(np.concatenate(slots)) if slots else np.zeros(0, np.int32)
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(used, slots[i])] = np.frombuffer(r["value"], np.float32)
    fitted = fit_scorer(x, np.array([r["y"] for r in rows]))
    out = np.zeros(DIM + 1)
    out[used], out[-1] = fitted[:-1], fitted[-1]
    return out
