"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact verification.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A document holds a benchmark
item of L words if some passage of it is within t = floor(max_ratio * L) word
edits (insert, delete, replace) of the item.

Item-sized windows.  An item is cut into t + 1 pieces; a passage within t edits
holds one of them unchanged, so every passage is met by a window of L words
aligned at the first words of a piece (exact, by pigeonhole).  Each window and
each item is embedded by random walks (Chakraborty, Goldenberg, Koucky,
"Streaming algorithms for embedding and computing edit distance in the low
distance regime", 2016): a walk reads 3 L symbols and moves on by a random bit
of (step, word), so that after an edit two walks soon meet again and edit
distance becomes Hamming distance.  Bit-sampling LSH takes ``sample`` random
positions of a walk; a window is a candidate for its item if one of the
repetitions agrees in all of them.  The number of repetitions is set for each
band of items with similar lengths and edits so that an item with the most edits
allowed is found with ``target_recall`` for each window; it is calculated from
the agreement of walks measured on all items of the band.  Candidates are verified exactly with bit-parallel approximate
matching on the window widened by t words on either side.

Everything runs where the document is read: no shuffle, and a long document is
one row.  Items are broadcast in blocks of at most ``block`` items of at most
``block_words`` words altogether (one item at least); more items mean more
passes over the documents.

Null or empty documents hold nothing; null or empty items are ignored.
Repeated items count once for each id, repeated rows stay repeated, and other
columns are carried.  Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, fresh, lean, mix, text_buffer, word_runs

WALKS = 4
PAD = U64(0x0123456789ABCDEF)
_STEPS = 0x9E3779B97F4A7C15


def words_of(texts: list[str]) -> Words:
    data, off = text_buffer(pa.array(texts, pa.string()))
    return Words(data, off, lower=True)


def walk(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, steps: int, number: int) -> np.ndarray:
    """CGK embeddings (one row each) of the words start..start+size-1; past the end: padding."""
    at = np.zeros(len(start), np.int64)
    out = np.full((len(start), steps), PAD, np.uint64)
    last = max(len(symbols) - 1, 0)
    for j in range(steps):
        live = at < size
        if not live.any():
            break
        s = np.where(live, symbols[np.minimum(start + at, last)], PAD)
        out[:, j] = s
        at += (mix(s ^ U64((number * 1_000_003 + j + 1) * _STEPS % (1 << 64))) & U64(1)).astype(np.int64)
    return out


class Items:
    """A block of benchmark items with pieces, embeddings and the LSH sample; broadcast as it is."""

    def __init__(self, ids: list[int], texts: list[str], max_ratio: float, sample: int, target_recall: float):
        w = words_of(texts)
        sym = w.hashes()
        self.ids = ids
        self.size = np.diff(w.first)
        self.edits = (max_ratio * self.size + 1e-9).astype(np.int64)
        self.words = [sym[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
        self.sample = sample
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, (first, n, t) in enumerate(zip(w.first[:-1].tolist(), self.size.tolist(), self.edits.tolist())):
            cuts = [p * n // (t + 1) for p in range(t + 2)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = min(3, b - a)
                found.setdefault(k, []).append((int(w.spans(np.array([first + a]), np.array([first + a + k]))[0]), i, a))
        for k, rows in found.items():
            rows.sort()
            self.grams[k] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]),
                             np.array([r[2] for r in rows]))
        steps = 3 * int(self.size.max(initial=1))
        self.walks = [walk(sym, w.first[:-1], self.size, steps, k) for k in range(WALKS)]
        self.reps = self._repetitions(sym, w.first[:-1], target_recall)
        self.at = np.random.default_rng(11).random((int(self.reps.max(initial=WALKS)), sample))

    def _repetitions(self, sym: np.ndarray, first: np.ndarray, target_recall: float) -> np.ndarray:
        """Repetitions of each item: by the lower decile of the agreement in its
        band, items of the same edits (from eight on: of the same quarter of a
        power of two) and the same half of a power of two of words."""
        edits = np.where(self.edits < 8, self.edits, 8 + (4 * np.log2(np.maximum(self.edits, 8))).astype(np.int64))
        band = edits * 1000 + (2 * np.log2(np.maximum(self.size, 1))).astype(np.int64)
        rng, reps = np.random.default_rng(7), np.full(len(self.size), WALKS)
        for b in np.unique(band[self.edits > 0]):
            items = np.flatnonzero(band == b)
            agree = max(float(np.quantile(self._agreement(sym, first, items, rng), 0.1)) ** self.sample, 1e-4)
            if agree < 1:
                reps[items] = max(WALKS, math.ceil(math.log(1 - target_recall) / math.log(1 - agree)))
        return reps

    def _agreement(self, sym: np.ndarray, first: np.ndarray, items: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Fractions of walk positions that still agree after the most edits
        allowed, for each walk of edited copies of the items: one copy of each, and
        50 of the band altogether as far as these have at most 100,000 words."""
        words = int(self.size[items].sum())
        copies = max(1, min(-(-50 // len(items)), 100_000 // words))
        got = []
        for i in np.repeat(items, copies).tolist():
            n, t = int(self.size[i]), int(min(self.edits[i], self.size[i]))
            at, kind = rng.choice(n, t, replace=False), rng.integers(0, 3, t)     # insert before, delete, replace
            times = np.ones(n, np.int64)
            times[at[kind == 0]], times[at[kind == 1]] = 2, 0
            begin = np.cumsum(times) - times
            x = np.repeat(sym[first[i]:first[i] + n], times)
            fresh = begin[at[kind != 1]]
            x[fresh] = rng.integers(1, 1 << 62, len(fresh)).astype(np.uint64)
            got.append((i, x[:n]))
        out = []
        for lo in range(0, len(got), 256):      # a band's lengths are alike
            part = got[lo:lo + 256]
            of, size = np.array([i for i, _ in part]), np.array([len(x) for _, x in part])
            copy, begin = np.concatenate([x for _, x in part]), np.cumsum(size) - size
            span = 3 * self.size[of]
            for k in range(WALKS):
                e = walk(copy, begin, size, int(span.max()), k)
                same = e == self.walks[k][of, :e.shape[1]]
                out.append((same & (np.arange(e.shape[1]) < span[:, None])).sum(axis=1) / span)
        return np.concatenate(out)


def best_match(item: list[int], text: list[int]) -> int:
    """Fewest edits between the item and any passage of the text (bit-parallel, Myers 1999)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, x in enumerate(item):
        peq[x] = peq.get(x, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best = score
    return best


def find(words: Words, items: Items) -> dict[int, dict[int, int]]:
    """{row: {item number: edits}} for a run of documents."""
    sym, n = words.hashes(), len(words)
    starts, which = [], []
    for k, (gram, item, offset) in items.grams.items():
        if n < k:
            continue
        h = words.windows(k)
        bits = np.zeros(1 << 20, bool)
        bits[(gram & U64((1 << 20) - 1)).astype(np.int64)] = True
        p = np.flatnonzero(bits[(h & U64((1 << 20) - 1)).astype(np.int64)])
        p = p[words.row[p] == words.row[p + k - 1]]
        lo, hi = np.searchsorted(gram, h[p], "left"), np.searchsorted(gram, h[p], "right")
        count = hi - lo
        p, lo, count = p[count > 0], lo[count > 0], count[count > 0]
        if not len(p):
            continue
        g = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at = np.repeat(p, count)
        row = words.row[at]
        starts.append(np.maximum(at - offset[g], words.first[row]))
        which.append(item[g])
    out: dict[int, dict[int, int]] = {}
    if not starts:
        return out
    pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(which)], axis=1), axis=0)
    for lo in range(0, len(pairs), 20_000):
        start, item = pairs[lo:lo + 20_000].T
        row = words.row[start]
        size = np.minimum(items.size[item], words.first[row + 1] - start)
        near = np.zeros(len(start), bool)
        span = 3 * items.size[item]
        for k in range(WALKS):
            e = walk(sym, start, size, int(span.max()), k)
            for r in range(k, int(items.reps[item].max()), WALKS):
                same = ~near & (items.reps[item] > r)
                for u in items.at[r]:
                    col = (u * span).astype(np.int64)
                    same &= e[np.arange(len(start)), col] == items.walks[k][item, col]
                near |= same
        for s, i, r in zip(start[near].tolist(), item[near].tolist(), row[near].tolist()):
            known = out.get(r, {})
            if known.get(i) == 0:
                continue
            t, length = int(items.edits[i]), int(items.size[i])
            a, b = max(s - t, int(words.first[r])), min(s + length + t, int(words.first[r + 1]))
            d = best_match(items.words[i], sym[a:b].tolist())
            if d <= t and d < known.get(i, t + 1):
                out.setdefault(r, {})[i] = d
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, block: int, block_words: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items in id order, a bounded block at a time."""
    src = (items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
                .select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct().orderBy("id", "text"))
    ids, texts, held = [], [], 0
    for r in src.toLocalIterator():
        n = len(r["text"].encode().split())
        if not n:
            continue
        if ids and (len(ids) >= block or held + n > block_words):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        held += n
    if ids:
        yield ids, texts


def _finder(shared):
    """Arrow function: texts -> leaks of one block of items."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

    @lean
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = shared.value
        for col in batches:
            leaks: list[list[dict]] = [[] for _ in range(len(col))]
            for a, _, words in word_runs(col, lower=True):
                for r, found in find(words, items).items():
                    best: dict[int, int] = {}
                    for i, d in found.items():
                        k = items.ids[i]
                        best[k] = min(d, best.get(k, d))
                    leaks[a + r] = [{"item_id": k, "edits": d} for k, d in sorted(best.items())]
            yield pa.array(leaks, kind)

    return work


def decontaminate(docs: DataFrame, items: DataFrame, max_ratio: float = 0.2, sample: int = 2, target_recall: float = 0.99,
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = 2000,
                  block_words: int = 200_000, out_col: str = "leaks") -> DataFrame:
    """The documents' columns and ``leaks``: array of (item_id, edits) of the items held, by item id."""
    spark = docs.sparkSession
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())]))
    out, found_cols = docs, []
    for ids, texts in blocks(items, item_id, item_text, block, block_words):
        shared = spark.sparkContext.broadcast(Items(ids, texts, max_ratio, sample, target_recall))

        found_cols += fresh(out, "found")
        out = out.withColumn(found_cols[-1], F.arrow_udf(_finder(shared), kind).asNondeterministic()(text_col))
    # an id may come in two blocks with two texts: its fewest edits count
    merged = F.sort_array(F.concat(F.array().cast(kind), *found_cols))
    return out.withColumn(out_col, F.filter(merged, lambda x, i: (i == 0) | (
        F.element_at(merged, F.greatest(i, F.lit(1)))["item_id"] != x["item_id"]))).drop(*found_cols)
