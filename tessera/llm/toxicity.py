"""Toxicity scores from subword-bag embeddings and a linear softmax.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A word, marked at both ends,
gives its byte n-grams of 3 to 6 bytes and itself; each is hashed to one of
``BUCKETS`` vectors.  The vectors of a word, and the words of ``WINDOW`` consecutive
ones, are averaged and fed to a linear two-class softmax; a document is judged
by its largest window logits, so a few toxic words are not diluted in a long
text.  Misspellings share most n-grams with the word they come from.

Vectors and softmax are trained together in numpy by full-batch Adam on at
most ``fit_rows`` clean and toxic documents of any length (smallest hashes of the
id); of a text of more than ``FIT_BYTES`` bytes a hash sample of its windows of
about that size.  Both are bounds for fitting only.  The label belongs
to the document, not to the window, so after a first pass only the windows
that stand out from all clean ones, and each toxic document's best, stay
positive.  The largest logits, the share of toxic windows and the length
become the score by logistic regression on the fitted documents, with all their
windows, whose inputs are calculated in tasks.  With two classes the averaged vectors enter the softmax only by
their projection on the difference of its columns, so a task scores with one
number for each bucket.

Null and empty texts have the lowest logit seen in fitting.  Without labels of both classes every score is 0.  Null ids are not
held out.  Repeated rows stay repeated; a repeated label row counts once, a
document labelled both ways is toxic.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, give_back, inverse, lean, mix, powers, text_buffer, word_runs, written

BUCKETS = 1 << 17
DIM = 8
WINDOW = 2
SIZES = (3, 4, 5, 6)
FIT_ROWS = (1000, 500)     # clean and toxic documents to fit on at most
FIT_BYTES = 12_000
DECAY = 1e-6
_BASE = 0xC2B2AE3D27D4EB4F


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of a run, by word."""
    n = len(words)
    size = words.end - words.start + 2
    end = np.cumsum(size)
    begin = end - size
    at = np.repeat(words.start - 1 - begin, size) + np.arange(end[-1] if n else 0)
    marked = words.data[np.clip(at, 0, max(len(words.data) - 1, 0))].astype(np.uint64) + U64(3) if n else np.zeros(0, np.uint64)
    marked[begin], marked[end - 1] = 1, 2
    total = np.zeros(len(marked) + 1, np.uint64)
    np.cumsum(mix(marked) * powers(_BASE, len(marked)), out=total[1:])
    back = powers(inverse(_BASE), len(marked) + 1)
    word = np.repeat(np.arange(n), size)
    left = end[word] - np.arange(len(marked)) if n else word
    slot = lambda h: (mix(h) % U64(BUCKETS)).astype(np.int32)
    slots, owners = [slot((total[end] - total[begin]) * back[begin] + U64(99))], [np.arange(n, dtype=np.int32)]
    for k in SIZES:
        p = np.flatnonzero(left >= k)
        slots.append(slot((total[p + k] - total[p]) * back[p] + U64(k)))
        owners.append(word[p].astype(np.int32))
    return np.concatenate(slots), np.concatenate(owners)


def window_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(window number of each word, row of each window)."""
    inside = np.arange(len(words)) - words.first[words.row]
    new = inside % WINDOW == 0
    return np.cumsum(new) - 1, words.row[new]


TOP = 3


def features(z: np.ndarray, row: np.ndarray, rows: int, low: float) -> np.ndarray:
    """A document's inputs to its last layer: its TOP largest window logits
    (``low`` where it has fewer), the share of toxic windows, its length."""
    out = np.full((rows, TOP + 2), low)
    o = np.lexsort((-z, row))
    z, row = z[o], row[o]
    count = np.bincount(row, minlength=rows)
    rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    for k in range(TOP):
        out[row[rank == k], k] = z[rank == k]
    out[:, TOP] = np.bincount(row, _sigmoid(z), minlength=rows) / np.maximum(count, 1)
    out[:, TOP + 1] = np.log1p(count)
    return out


class Model:
    def __init__(self):
        self.value = np.zeros(BUCKETS)     # projection of each bucket's vector
        self.bias, self.low = 0.0, 0.0
        self.mid, self.width = np.zeros(TOP + 2), np.ones(TOP + 2)
        self.last = np.append(np.zeros(TOP + 2), -50.0)

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(logit, row) of every window: the mean of its words' means of n-grams."""
        if not len(words):
            return np.zeros(0), np.zeros(0, np.int64)
        bucket, word = ngrams(words)
        win, row = window_of(words)
        mean = np.bincount(word, self.value[bucket]) / np.bincount(word)
        return np.bincount(win, mean) / np.bincount(win) + self.bias, row

    def scores(self, words: Words, rows: int) -> np.ndarray:
        x = (features(*self.windows(words), rows, self.low) - self.mid) / self.width
        return _sigmoid(x @ self.last[:-1] + self.last[-1])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(texts: list[str], toxic: np.ndarray, rounds: tuple[int, ...] = (30, 30, 30), rate: float = 0.2) -> Model:
    """Train vectors and softmax on labelled texts; the last layer is left to ``finish``."""
    model = Model()
    if not len(texts) or toxic.all() or not toxic.any():
        return model
    data, off = text_buffer(pa.array(texts, pa.string()))
    words = Words(data, off, lower=True)
    bucket, word = ngrams(words)
    win, row = window_of(words)
    w = win[word]
    part = ((1 / np.bincount(word)) / np.bincount(win)[win]).astype(np.float32)[word]   # each n-gram's part of its window
    w = w.astype(np.int32)
    del word
    label = toxic[row].astype(float)
    rng = np.random.default_rng(5)
    seen = np.bincount(bucket, minlength=BUCKETS) > 0
    used, bucket = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)[bucket]
    vec, soft, bias = rng.normal(0, 0.05, (len(used), DIM)), rng.normal(0, 0.5, DIM), 0.0
    speed = [np.zeros_like(vec), np.zeros(DIM), 0.0]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    logits = lambda: np.bincount(w, part * (vec @ soft).astype(np.float32)[bucket], minlength=len(row)) + bias
    weight = np.ones(len(row))
    for stage, count in enumerate(rounds):
        pos, neg = weight * label, weight * (1 - label)
        per = pos / pos.sum() + neg / neg.sum()
        for _ in range(count):
            g = per * (_sigmoid(logits()) - label)
            share = np.bincount(bucket, part * g.astype(np.float32)[w], minlength=len(used))
            # one step size for all vectors: n-grams seen in few windows move little
            new = []
            for i, (x, d) in enumerate(zip((vec, soft, bias), (np.outer(share, soft) + DECAY * vec, vec.T @ share, g.sum()))):
                speed[i] = 0.9 * speed[i] + 0.1 * d
                new.append(x - rate * speed[i] / (np.abs(speed[i]).max() + 1e-12) * (1 if i < 2 else 0.5))
            vec, soft, bias = new
        z = logits()
        if stage + 1 < len(rounds):
            clear = np.quantile(z[label == 0], 0.999)
            best = np.repeat(np.maximum.reduceat(z, first), np.diff(np.append(first, len(row))))
            weight = np.where(label == 0, 1.0, ((z >= clear) | (z >= best)).astype(float))
    model.value[used] = vec @ soft
    model.bias, model.low = float(bias), float(z.min())
    return model


def finish(model: Model, x: np.ndarray, toxic: np.ndarray) -> Model:
    """Train the last layer on the inputs of whole documents."""
    if not len(x) or toxic.all() or not toxic.any():
        return model
    model.mid, model.width = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.last = _logistic((x - model.mid) / model.width, toxic.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Weights, bias last (Newton steps)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    c = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ c)
        h = x.T @ (x * (p * (1 - p))[:, None]) + decay * np.eye(len(c))
        step = np.linalg.solve(h, x.T @ (p - y) + decay * c)
        c = c - step * min(1.0, 3 / np.abs(step).max()) if np.abs(step).max() > 0 else c
        if np.abs(step).max() < 1e-6:
            break
    return c


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(data: bytes) -> str:
    """The text, or of a longer one than ``FIT_BYTES`` the windows with the smallest
    hashes of their words and place, in order, of that size together (one at
    least, cut there)."""
    if len(data) <= FIT_BYTES:
        return data.decode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True)
    win, row = window_of(words)
    if not len(row):
        return ""
    first = np.arange(len(row)) * WINDOW
    last = np.minimum(first + WINDOW, len(words)) - 1
    size = np.bincount(win, words.end - words.start + 1).astype(np.int64)
    o = np.argsort(mix(words.hashes()[first] + mix(words.hashes(1)[last] + np.arange(len(row)).astype(np.uint64))), kind="stable")
    some = np.sort(o[:max(1, int(np.searchsorted(np.cumsum(size[o]), FIT_BYTES, "right")))])
    at = (some[:, None] * WINDOW + np.arange(WINDOW)).ravel()
    at = at[at < len(words)]
    return b" ".join(data[i:j] for i, j in zip(words.start[at].tolist(), words.end[at].tolist()))[:FIT_BYTES].decode(errors="ignore")


def train(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
                   .groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).alias("y"))
                   .join(texts.select("id").distinct(), F.col("l_id") == F.col("id"), "left_semi"))
    known = written(known, "toxic-labels")
    # smallest hashes of the ids that have a text; at most fit_rows of either class
    few = [known.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(fit_rows[y]) for y in (0, 1)]
    own = texts.join(F.broadcast(few[0].unionByName(few[1])), F.col("id") == F.col("l_id"))
    chosen = written(own.select("text", "y", F.xxhash64("id").alias("h"), "id", F.xxhash64("text").alias("t")), "toxic-fit")

    def rows(work, kind: str) -> list:
        """Of either class at most fit_rows rows, in the same order each time (an id may repeat)."""
        out = chosen.mapInArrow(lean(work), f"x {kind}, y int, h long, id string, t long")
        return [r for y in (0, 1) for r in out.where(F.col("y") == y).orderBy("h", "id", "t").limit(fit_rows[y]).select("x", "y").collect()]

    def rest(batch: pa.RecordBatch, x: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [x, batch.column(1).cast(pa.int32()), batch.column(2), batch.column(3).cast(pa.string()), batch.column(4)],
            names=["x", "y", "h", "id", "t"])

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rest(batch, pa.array([sampled(t.encode()) for t in batch.column(0).to_pylist()], pa.string()))

    got = rows(samples, "string")
    toxic = np.array([r["y"] > 0 for r in got], bool)
    model = fit([r["x"] for r in got], toxic)
    del got
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(*shared.value.windows(words), b - a, shared.value.low) for a, b, words in word_runs(batch.column(0), lower=True)]
            x = np.concatenate(parts) if parts else np.zeros((0, TOP + 2))
            yield rest(batch, pa.array(x.tolist(), pa.list_(pa.float64())))

    got = rows(inputs, "array<double>")
    return finish(model, np.array([r["x"] for r in got]), np.array([r["y"] > 0 for r in got], bool))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The documents' columns and the score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            parts = [shared.value.scores(words, b - a) for a, b, words in word_runs(col, lower=True)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out_col, F.arrow_udf(work, T.DoubleType()).asNondeterministic()(text_col))
