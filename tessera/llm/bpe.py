"""Byte-level BPE encoding and decoding with a two-tier lookup.

Text is cut into pre-tokens by a pattern.  Tier one resolves pre-tokens
that are vocabulary entries as a whole with a minimal perfect hash over the
vocabulary (hash and displace: one displacement for each small bucket, as
many slots as entries), confirmed by the entry's bytes.  Tier two, for the
misses, merges the lowest-ranked adjacent pair again and again with a heap
over a linked list of byte spans (n log n for a pre-token of n bytes; one of
at most ``SHORT`` bytes is merged by looking over its few pairs).

The vocabulary has a fixed size and is broadcast; texts never leave their
partition.  Workers remember the ids of recent pre-tokens in a table of
bounded size, which only saves time.

A null or empty text has no ids and decodes to empty bytes.  Strings of
special tokens are ordinary text.  Repeated rows stay repeated; the chosen
columns are carried as they are (null ids included).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CHUNK_BYTES, U64, inverse, lean, mix, powers, runs, text_buffer

REMEMBER = 200_000
SHORT = 32   # bytes up to which a pre-token is merged without a heap
_BASE = 0xD1342543DE82EF95
_STEP = 0x9E3779B97F4A7C15


def load_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if None in out:
        raise ValueError("ranks must be 0..n-1")
    return out


def byte_hashes(items: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, computed for all of them at once."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(items), np.uint8)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * powers(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[end - size]) * powers(inverse(_BASE), len(data) + 1)[end - size]
    return mix(h + size.astype(np.uint64) * U64(_STEP))


class PerfectHash:
    """Minimal perfect hash of n distinct 64-bit keys onto 0..n-1 (hash and displace)."""

    def __init__(self, keys: np.ndarray, load: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // load)
        self.shift = np.zeros(self.buckets, np.uint64)
        of = (keys % U64(self.buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            mine = keys[order[starts[b]:starts[b + 1]]]
            d = 0
            while True:  # try a run of displacements at once
                tries = np.arange(d, d + (64 if len(mine) > 1 else 4096), dtype=np.uint64)
                slots = (mix(mine[None, :] + tries[:, None] * U64(_STEP)) % U64(n)).astype(np.int64)
                ok = free[slots].all(axis=1)
                for t in np.flatnonzero(ok):
                    if len(set(slots[t].tolist())) == len(mine):
                        self.shift[b] = tries[t]
                        free[slots[t]] = False
                        break
                else:
                    d += len(tries)
                    continue
                break

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.shift[(keys % U64(self.buckets)).astype(np.int64)]
        return (mix(keys + d * U64(_STEP)) % U64(self.n)).astype(np.int64)


class Vocabulary:
    """Token bytes by id, with the tier-one hash; built once on the driver and broadcast."""

    def __init__(self, tokens: list[bytes]):
        keys = byte_hashes(tokens)
        if len(np.unique(keys)) != len(tokens):
            raise ValueError("tokens must be distinct")
        self.tokens = tokens
        self.hash = PerfectHash(keys)
        self.at = np.zeros(len(tokens), np.int64)      # slot -> id
        self.at[self.hash.slots(keys)] = np.arange(len(tokens))
        self.key_at = np.zeros(len(tokens), np.uint64)  # slot -> key
        self.key_at[self.hash.slots(keys)] = keys


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """``merge_bytes`` for a few bytes: the lowest of so few ranks is found faster than a heap is kept."""
    get, none = ranks.get, len(ranks)
    at = list(range(len(piece) + 1))
    pair = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        r = min(pair)
        if r == none:
            break
        i = pair.index(r)
        del pair[i], at[i + 1]
        if i < len(pair):
            pair[i] = get(piece[at[i]:at[i + 2]], none)
        if i:
            pair[i - 1] = get(piece[at[i - 1]:at[i + 1]], none)
    return tuple([ranks[piece[a:b]] for a, b in zip(at, at[1:])])


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: merge the lowest-ranked adjacent pair (leftmost
    of equals) until none is in the vocabulary."""
    n = len(piece)
    if n <= SHORT:
        return merge_short(piece, ranks)
    bits = n.bit_length()
    low = (1 << bits) - 1
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    get = ranks.get
    pair = [get(piece[i:i + 2]) for i in range(n - 1)]
    pair.append(None)
    heap = [r << bits | i for i, r in enumerate(pair) if r is not None]
    heapify(heap)
    while heap:
        r = heappop(heap)
        i = r & low
        if pair[i] != r >> bits:   # a neighbour was merged meanwhile
            continue
        j = nxt[i]
        k = nxt[i] = nxt[j]
        pair[j] = None
        if k < n:
            prv[k] = i
            r = pair[i] = get(piece[i:nxt[k]])
            if r is not None:
                heappush(heap, r << bits | i)
        else:
            pair[i] = None
        i = prv[i]
        if i >= 0:
            r = pair[i] = get(piece[i:k])
            if r is not None:
                heappush(heap, r << bits | i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:nxt[i]]])
        i = nxt[i]
    return tuple(out)


class Coder:
    """Per-worker encoder and decoder."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab = vocab
        self.ranks = {t: i for i, t in enumerate(vocab.tokens)}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        items = list(words)
        raw = [w.encode() for w in items]
        v = self.vocab
        keys = byte_hashes(raw)
        slots = v.hash.slots(keys)
        hit = v.key_at[slots] == keys
        ids = v.at[slots].tolist()
        known, ranks, tokens = self.known, self.ranks, v.tokens
        for w, b, h, i in zip(items, raw, hit.tolist(), ids):
            known[w] = (i,) if h and tokens[i] == b else merge_bytes(b, ranks)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self.find(text)
        new = set(words).difference(self.known)
        if new:
            if len(self.known) > REMEMBER:   # the words of late stay within reach
                self.older, self.known = self.known, {}
                new = set(words)
            known, older = self.known, self.older
            for w in [w for w in new if w in older]:   # a lookup for each word of the text, whatever is remembered
                known[w] = older[w]
                new.remove(w)
            if new:
                self.learn(new)
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, ids))


_coders: dict[str, Coder] = {}


def _coder(shared, pattern: str) -> Coder:
    """The worker's coder for a broadcast vocabulary, kept between tasks."""
    key = f"{shared._path if hasattr(shared, '_path') else id(shared)}|{pattern}"
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(shared.value, pattern)
    return _coders[key]


def encode_decode(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``decoded`` binary (the bytes the ids stand for)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(load_ranks(vocab_path)))
    src = df.select(*keep, text_col) if text_col not in keep else df.select(*keep)
    at = src.columns.index(text_col)
    schema = T.StructType([src.schema[c] for c in keep]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for batch in batches:
            _, off = text_buffer(batch.column(at))
            for a, b in runs(off, CHUNK_BYTES):
                part = batch.slice(a, b - a)
                ids = [coder.encode(t) for t in part.column(at).to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                decoded = [coder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.binary())],
                    names=[*keep, "ids", "decoded"])

    return src.mapInArrow(work, schema)
