"""Exact Jaccard self-join of documents by universe partition and pigeonhole
(after Deng, Li, Wen, Feng: "An Efficient Partition Based Method for Exact
Set Similarity Joins", PVLDB 2015).

Sets.  Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; the set of a document is
its distinct word shingles (64-bit hashes), the whole sequence if it has fewer
words than a shingle, empty without words or text.  Two documents link when
``den * |X & Y| >= num * |X | Y|``; empty sets link with nothing.

Size bands.  Band i holds the sizes lo..floor(lo * den / num), so linked sets
lie in one band or in neighbouring ones.  Each band has one partition of the
shingle universe; a document is indexed under its own band and the band below.

Pigeonhole.  Linked sets differ in at most H elements.  With plain segments,
H + 1 + e segments leave at least 1 + e of them equal; with one-deletion
neighbourhoods, floor(H / 2) + 1 + e segments leave at least 1 + e that differ
in at most one element.  Each band takes the form whose estimated cost (keys
plus chance matches of small segments) is lower.  Empty segments, or segments
that become empty by a deletion, are worthless and frequent: a document skips
the first e of them and indexes the rest.  No link is lost: were all of the
1 + e matches worthless, the last of them is indexed by both documents.

Plan.  1. Identical sets collapse into classes (one aggregation); the class
has the smallest doc_id as representative.  2. Tasks hash their documents'
segments and ship the keys as packed arrays, one row for each key bucket (five
bytes a key, a class once for its keys in it); a bucket's task sorts them and keeps the keys that several classes share.
3. In each such key every class is paired with the key's first class only (a
star, never all pairs), pairs that a parity sketch of the sets proves too
different are discarded, the rest are verified on the whole texts, and
components are formed.  4. While keys with sharers in different components
still hold many pairs, stars around each key's best linked class are verified:
a group of copies hangs together by the text they were made from.  5. Sharers
of a key that are still apart are paired and verified in full, so that in the
end every pair with a common key is ruled out, verified or connected.  Groups
of similar copies are connected by steps 3 and 4 and never expanded.

Rows with a null id get component null and link nothing; repeated rows are
rows of one class; a null or empty text is an empty set, whose component is
its own id.  Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, Words, lean, mix, signed, small, text_buffer, word_runs, written
from .components import components

KEY_BYTES = 5                 # of a key inside its bucket; keys that agree by chance make pairs that verification rejects
FLUSH_KEYS = 400_000        # keys a task packs at once
BUCKET_BYTES = 4 << 20        # text bytes whose keys share a bucket
BROADCAST_IDS = 1_000_000     # ids sent to all executors at most; more are joined by a shuffle
SKETCH_WORDS = 8              # parity sketch of 8 * 64 bits
FEW_LINKS = 100               # a star round that finds fewer is the last
HUB_ROUNDS = 4                # star rounds at most before what is still apart is paired in full


class Bands:
    """Size bands of a threshold num/den with the allocation of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lo, self.hi, self.m, self.skip, self.near = [], [], [], [], []

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def cover(self, size: int) -> None:
        """Extend the tables so that they hold ``size``."""
        while not self.hi or self.hi[-1] < size:
            lo = self.hi[-1] + 1 if self.hi else 1
            hi = lo * self.den // self.num
            h = self.differ(hi, hi * self.den // self.num)
            self.lo.append(lo)
            self.hi.append(hi)
            best = None
            for near in (False, True):
                base = h // 2 + 1 if near else h + 1
                s = lo / base
                skip = math.ceil(2 * base * math.exp(-s) * (1 + s * near)) if base > 1 else 0
                m = base + skip
                keys = m + (hi if near else 0)
                cost = keys + 200 * m * 0.35 ** (lo / m)
                if best is None or cost < best[0]:
                    best = (cost, m, skip, near)
            self.m.append(best[1] if h else 0)    # sets that must be equal are one class: no keys
            self.skip.append(best[2])
            self.near.append(best[3])

    def arrays(self):
        return (np.array(self.hi), np.array(self.m, np.int64), np.array(self.skip, np.int64), np.array(self.near, bool))


class Sets:
    """Shingle sets of a run of documents: ``h`` sorted within each row, ``row``, sizes ``n``."""

    def __init__(self, words: Words, rows: int, k: int):
        per = np.diff(words.first)
        at = words.whole(k)
        h, row = words.windows(k)[at], words.row[at]
        short = np.flatnonzero((per > 0) & (per < k))
        if len(short):
            h = np.concatenate([h, words.spans(words.first[short], words.first[short + 1])])
            row = np.concatenate([row, short])
        o = np.lexsort((h, row))
        h, row = h[o], row[o]
        if len(h):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            h, row = h[new], row[new]
        self.h, self.row = h, row
        self.n = np.bincount(row, minlength=rows).astype(np.int64)
        self.ends = np.cumsum(self.n)

    def total(self, x: np.ndarray) -> np.ndarray:
        """Wrapping sum of x over each set."""
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return c[self.ends] - c[self.ends - self.n]

    def classes(self) -> np.ndarray:
        """One 64-bit value for each set."""
        return mix(self.total(mix(self.h ^ U64(0x5851F42D4C957F2D))) + self.n.astype(np.uint64) * U64(0x14057B7EF767814F))

    def sketches(self) -> np.ndarray:
        """Parity of the members at each of the sketch's bits."""
        bits = SKETCH_WORDS * 64
        at = (mix(self.h ^ U64(0x2545F4914F6CDD1D)) % U64(bits)).astype(np.int64)
        rows = len(self.n)
        out = np.zeros((rows, SKETCH_WORDS), np.uint64)
        for a in range(0, rows, 4096):
            b = min(rows, a + 4096)
            lo, hi = self.ends[a] - self.n[a], self.ends[b - 1]
            count = np.bincount((self.row[lo:hi] - a) * bits + at[lo:hi], minlength=(b - a) * bits)
            odd = (count & 1).astype(np.uint8).reshape(b - a, bits)
            out[a:b] = np.packbits(odd, axis=1, bitorder="little").view(np.uint64)
        return out

    def keys(self, bands: Bands, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) under the own band and the one below, for the rows in ``keep``."""
        bands.cover(int(self.n.max(initial=1)))
        hi, ms, skips, nears = bands.arrays()
        own = np.searchsorted(hi, self.n)
        out_k, out_r = [], []
        spread = mix(self.h ^ U64(0xD6E8FEB86659FD93))
        value = mix(self.h ^ U64(0xA24BAED4963EE407))
        for down in (0, 1):
            band = own - down
            on = keep & (self.n > 0) & (band >= 0)
            on &= np.where(band >= 0, ms[band], 0) > 0
            if not on.any():
                continue
            m = np.where(on, ms[band], 0)
            base = np.concatenate([[0], np.cumsum(m)])
            pick = on[self.row]
            row = self.row[pick]
            seg = (spread[pick] % m[row].astype(np.uint64)).astype(np.int64)
            gid = base[row] + seg
            o = np.argsort(gid, kind="stable")
            gid, val = gid[o], value[pick][o]
            count = np.bincount(gid, minlength=base[-1])
            end = np.cumsum(count)
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(val, dtype=np.uint64)])
            content = c[end] - c[end - count]
            seg_row = np.repeat(np.arange(len(m)), m)
            seg_no = np.arange(base[-1]) - base[seg_row]
            place = mix((band[seg_row].astype(np.uint64) << U64(40)) + seg_no.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
            near = nears[band[seg_row]]
            void = (count == 0) | (near & (count == 1))
            rank = np.cumsum(void) - 1
            rank -= np.concatenate([[0], np.cumsum(void)])[base[seg_row]]
            skipped = void & (rank < skips[band[seg_row]])
            full = ~(skipped & (count == 0))
            out_k.append(mix(content + place)[full])
            out_r.append(seg_row[full])
            gone = near[gid] & ~(skipped[gid] & (count[gid] == 1))   # one-deletion neighbourhood
            if gone.any():
                out_k.append(mix(content[gid] - val + place[gid])[gone])
                out_r.append(seg_row[gid][gone])
        if not out_k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(out_k), np.concatenate(out_r)


def memberships(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, cls, sketch columns) of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, cls long, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_runs(batch.column(1), lower=True):
                s = Sets(words, b - a, k)
                sk = s.sketches()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(s.n), signed(s.classes())]
                    + [signed(sk[:, i]) for i in range(SKETCH_WORDS)],
                    names=["id", "n", "cls"] + [f"s{i}" for i in range(SKETCH_WORDS)])

    return src.mapInArrow(work, schema)


def unpacked(blobs: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all blobs in order, copied once."""
    return np.concatenate([np.zeros(0, np.uint8), *(text_buffer(c)[0] for c in blobs.chunks)]).view(kind)


def shared_keys(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """(key, cls, head): the classes of every key that several classes share; head is its first class."""
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        keys, rows, classes, base = [], [], [], 0

        def flush():
            key, row, cls = np.concatenate(keys), np.concatenate(rows), np.concatenate(classes)
            bucket = (key % U64(buckets)).astype(np.int64)
            o = np.argsort(bucket * len(cls) + row, kind="stable")
            key, row, bucket = key[o], row[o], bucket[o]
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
            parts = [((key // U64(buckets)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES], bucket), (cls[row[head]], bucket[head]),
                     (np.diff(np.concatenate([head, [len(key)]])).astype(np.uint32), bucket[head])]
            full = np.unique(bucket)
            blobs = []
            for values, place in parts:
                values, cut = np.ascontiguousarray(values), np.append(np.searchsorted(place, full), len(place))
                blobs.append(pa.array([values[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *blobs], names=["bucket", "keys", "nodes", "runs"])

        for batch in batches:
            for a, b, words in word_runs(batch.column(0), lower=True):
                s = Sets(words, b - a, k)
                cls = s.classes()
                keep = np.zeros(b - a, bool)
                for i, c in enumerate(cls.tolist()):   # a class once in each task
                    if c not in seen:
                        seen.add(c)
                        keep[i] = True
                key, row = s.keys(bands, keep)
                if len(key):
                    keys.append(key)
                    rows.append(row + base)
                    classes.append(cls)
                    base += len(cls)
                if sum(map(len, keys)) >= FLUSH_KEYS:
                    yield flush()
                    keys, rows, classes, base = [], [], [], 0
        if keys:
            yield flush()

    def match(t: pa.Table) -> pa.Table:
        short = unpacked(t.column("keys"), np.uint8).reshape(-1, KEY_BYTES)
        key = np.zeros((len(short), 8), np.uint8)
        key[:, :KEY_BYTES] = short
        key = key.view(np.uint64).ravel()
        del short
        o = np.argsort(key, kind="stable")
        k2 = key[o]
        del key
        same = k2[1:] == k2[:-1]
        multi = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        k2, o = k2[multi], o[multi]
        n2 = np.repeat(unpacked(t.column("nodes"), np.int64), unpacked(t.column("runs"), np.uint32))[o]
        o = np.lexsort((n2, k2))
        k2, n2 = k2[o], n2[o]
        if len(k2):
            new = np.concatenate([[True], (k2[1:] != k2[:-1]) | (n2[1:] != n2[:-1])])
            k2, n2 = k2[new], n2[new]
            start = np.flatnonzero(np.concatenate([[True], k2[1:] != k2[:-1]]))
            size = np.diff(np.concatenate([start, [len(k2)]]))
            head, size = np.repeat(n2[start], size), np.repeat(size, size)
            k2, n2, head = k2[size > 1], n2[size > 1], head[size > 1]
        else:
            head = n2
        k2 = k2 * U64(buckets) + U64(t.column("bucket")[0].as_py())   # keys of different buckets differ
        return pa.table({"key": signed(k2), "cls": pa.array(n2), "head": pa.array(head)})

    packed = src.mapInArrow(pack, "bucket int, keys binary, nodes binary, runs binary")
    return packed.groupBy("bucket").applyInArrow(match, "key long, cls long, head long")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Necessary for a link: sizes fit, and the sketches differ in no more bits than the sets may in elements."""
    c = lambda s, x: F.col(f"{s}{x}")
    bits = sum((F.bit_count(c(a, f"s{i}").bitwiseXOR(c(b, f"s{i}"))) for i in range(1, SKETCH_WORDS)),
               F.bit_count(c(a, "s0").bitwiseXOR(c(b, "s0"))))
    small, large = F.least(c(a, "n"), c(b, "n")), F.greatest(c(a, "n"), c(b, "n"))
    return (small * den >= large * num) & (bits * (den + num) <= (small + large) * (den - num))


def _side(classes: DataFrame, p: str) -> DataFrame:
    return classes.select(*[F.col(c).alias(p + c) for c in classes.columns])


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs of ids that link, decided on the whole texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = small(ids, BROADCAST_IDS)
    # repeated rows of one id: the classes' representatives are single rows of it
    texts = src.join(ids, F.col("id") == F.col("want"), "left_semi")
    texts = written(texts.select("id", "text").distinct(), "texts")
    both = (pairs.join(_side(texts, "a_"), F.col("a") == F.col("a_id"))
                 .join(_side(texts, "b_"), F.col("b") == F.col("b_id"))
                 .select("a", "b", F.col("a_text").alias("x"), F.col("b_text").alias("y")))

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.maximum.reduce([np.diff(text_buffer(batch.column(i))[1]) for i in (2, 3)])
            cut = [0]
            while cut[-1] < batch.num_rows:
                far = np.searchsorted(np.cumsum(size[cut[-1]:]), CHUNK_BYTES, "right")
                cut.append(min(batch.num_rows, cut[-1] + max(1, int(far))))
            for lo, hi in zip(cut[:-1], cut[1:]):
                part, sets = batch.slice(lo, hi - lo), []
                for i in (2, 3):
                    data, off = text_buffer(part.column(i))
                    sets.append(Sets(Words(data, off, lower=True), hi - lo, k))
                h = np.concatenate([s.h for s in sets])
                row = np.concatenate([s.row for s in sets])
                o = np.lexsort((h, row))
                h, row = h[o], row[o]
                equal = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                both_n = np.bincount(row[1:][equal], minlength=hi - lo)
                union = sets[0].n + sets[1].n - both_n
                ok = (den * both_n >= num * union) & (union > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(work, "a long, b long").distinct()


def join(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: the link classes of the documents."""
    docs = docs.select(id_col, text_col)
    members = written(memberships(docs, id_col, text_col, shingle), "members")
    sk = [f"s{i}" for i in range(SKETCH_WORDS)]
    classes = written(members.where("id is not null and n > 0").groupBy("cls")
                             .agg(F.min("id").alias("rep"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in sk]), "classes")
    volume = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(6 * volume / BUCKET_BYTES))
    shared = written(shared_keys(docs, id_col, text_col, shingle, num, den, buckets), "shared")

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs of classes (x, y) -> pairs of representatives that the sketches do not rule out."""
        return (pairs.join(_side(classes, "x_"), F.col("x") == F.col("x_cls"))
                     .join(_side(classes, "y_"), (F.col("y") == F.col("y_cls")) & _may_link("x_", "y_", num, den))
                     .select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))
                     .where("a < b").distinct())

    def apart(known: DataFrame) -> DataFrame:
        """Rows of the keys whose classes are still in several components."""
        place = classes.join(known, F.col("rep") == F.col("node"), "left").select(
            "cls", "rep", "n", *sk, F.coalesce("component", "rep").alias("comp"))
        placed = shared.select("key", "cls").join(place, "cls").drop("cls")
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return written(placed.join(mixed, "key"), "apart")

    def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))
        return written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")

    tried = written(candidates(shared.where("cls <> head").select(F.col("head").alias("x"), F.col("cls").alias("y")).distinct()), "pairs")
    links = written(verify(tried, docs, id_col, text_col, shingle, num, den), "links")
    known = components(links, "a", "b")
    rest = apart(known)
    for _ in range(HUB_ROUNDS):
        rows, pairs = rest.groupBy("key").count().agg(F.sum("count"), F.sum(F.expr("count * (count - 1) / 2"))).first()
        if (pairs or 0) <= 2 * (rows or 0):
            break
        # large groups: a star around each key's member with the most links so far
        degree = links.select(F.explode(F.array("a", "b")).alias("d_rep")).groupBy("d_rep").count()
        rated = rest.join(degree, F.col("rep") == F.col("d_rep"), "left")
        hubs = rated.groupBy(F.col("key").alias("x_key")).agg(F.max(F.struct(
            F.coalesce("count", F.lit(0)), -F.col("rep"), *[F.col(c).alias("x_" + c) for c in ("rep", "comp", "n", *sk)])).alias("hub"))
        hubs = hubs.select("x_key", *[f"hub.x_{c}" for c in ("rep", "comp", "n", *sk)])
        y = _side(rest, "y_")
        stars = untried(hubs.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_comp") != F.col("y_comp"))
                                  & _may_link("x_", "y_", num, den)), tried)
        more = written(verify(stars, docs, id_col, text_col, shingle, num, den), "links")
        tried = tried.unionByName(stars)
        found = more.count()
        if found:
            links = links.unionByName(more)
            known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
            rest = apart(known)
        if found < FEW_LINKS:
            break

    # what is still apart is paired in full
    y = _side(rest, "y_")
    last = untried(_side(rest, "x_").join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_comp") < F.col("y_comp"))
                                          & _may_link("x_", "y_", num, den)), tried)
    more = verify(last, docs, id_col, text_col, shingle, num, den)
    final = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")

    reps = classes.select(F.col("cls").alias("c_cls"), "rep")
    return (members.join(reps, F.col("cls") == F.col("c_cls"), "left")
                   .join(final, F.col("rep") == F.col("node"), "left")
                   .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                           F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "rep"))
                            .otherwise(F.col("id")).alias("component_id")))
