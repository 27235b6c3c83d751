"""Helpers shared by the text operators: word hashing over Arrow batches,
rolling hashes of word windows, spreading, written tables.

Words are maximal runs of bytes other than space and \\t..\\r of the UTF-8
text; a null text has no words.  Hashes are computed for a whole Arrow
batch at once with prefix sums of a polynomial modulo 2**64 (odd base, so
any window is one subtraction and one multiplication), then finalised with
a bit mixer.  Two bases give two independent 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rolling import spread
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

U64 = np.uint64
CHUNK_BYTES = 512 << 10   # text handled at once inside a task (a longer document is handled alone)

_rng = np.random.default_rng(20240607)
_BYTE_CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_GAPS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker and grown by a quarter at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, (0 if have is None else len(have)) * 5 // 4)
        seq = np.full(size, base, dtype=np.uint64)
        seq[0] = 1
        have = _powers[base] = np.multiply.accumulate(seq)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 row offsets into them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a run of documents: ``start``/``end`` byte positions in
    ``data``, ``row`` the document's position in the run, ``first`` the
    index of each document's first word (n + 1 entries)."""

    __slots__ = ("data", "start", "end", "row", "first", "_p", "_hash")
    BREAKS = _IS_SPACE   # bytes between words

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        n = len(data)
        solid = ~self.BREAKS[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            edge = off[:-1][off[:-1] < n]
            before[edge] = False
            edge = off[1:] - 1
            after[edge[edge >= 0]] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.data = _LOWER[data] if lower else data
        self.first = np.searchsorted(self.start, off)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self._p, self._hash = {}, {}

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        if which not in self._hash:
            base, n = _BASES[which], len(self.data)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CODES[which][self.data] * powers(base, n), out=total[1:])
            h = (total[self.end] - total[self.start]) * powers(inverse(base), n + 1)[self.start]
            self._hash[which] = mix(h + (self.end - self.start).astype(np.uint64))
        return self._hash[which]

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; only those at ``whole(k)`` lie in one document."""
        n = len(self)
        gap = _GAPS[which]
        if which not in self._p:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes(which) * powers(gap, n), out=total[1:])
            self._p[which] = total
        if n < k:
            return np.zeros(0, np.uint64)
        p = self._p[which]
        return mix((p[k:] - p[:n - k + 1]) * powers(inverse(gap), n)[:n - k + 1] + U64(k))

    def spans(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the words a..b-1 for each pair (same form as ``windows``)."""
        self.windows(1, which)
        p = self._p[which]
        return mix((p[b] - p[a]) * powers(inverse(_GAPS[which]), len(self) + 1)[a] + (b - a).astype(np.uint64))

    def whole(self, k: int) -> np.ndarray:
        """Positions from which k words lie inside one document."""
        n = len(self)
        if n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[:n - k + 1] == self.row[k - 1:])


def runs(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least) that cover a batch."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def word_runs(col: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over a batch in pieces of bounded size."""
    data, off = text_buffer(col)
    for a, b in runs(off, limit):
        yield a, b, Words(data[off[a]:off[b]], off[a:b + 1] - off[a], lower)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):   # another C library
        pass


def lean(work):
    """Wrap a task's batch generator: the memory it has freed goes back to the
    system when the task ends, as Python workers outlive their tasks."""
    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()
    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that none of ``df``'s columns has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One table's columns, spread over the cores if the scan has fewer splits."""
    df = read_table(spark, sf_dir, name)
    return spread(df.select(*cols) if cols else df)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it back: lineage
    ends there, later passes prune columns, and lost executors re-read it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """The rows, marked for broadcast if they are counted to be at most ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df
