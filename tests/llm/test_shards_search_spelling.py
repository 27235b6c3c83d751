"""Sharding, lexical search and spelling variants against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lexical_search, sharding, spelling

DOCS = "doc_id long, text string, id string, n long, shard string, slot string, item string, word string, bag string"


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "x", 7, "s", None, "i", "w", "b") for i, t in rows], DOCS)


# --- sharding -----------------------------------------------------------------------------------

def check_shards(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]
    return loads


def test_shards_are_even_and_groups_stay_together(spark):
    rng = np.random.default_rng(4)
    texts = ["t%d " % i * int(rng.integers(1, 60)) for i in range(300)]
    rows = [(i, texts[int(rng.integers(300))] if i % 3 else f"own {i} " * int(rng.integers(1, 40))) for i in range(1500)]
    out = sharding.shard(frame(spark, rows), shards=8)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"),
                          ("slot", "bigint"), ("grown_shard", "int")]
    got = out.collect()
    loads = check_shards(rows, got, 8)
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    at, text = defaultdict(set), dict(rows)
    for r in got:
        at[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in at.values())
    groups = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, group string")
    assert sharding.spread_of_groups(out, groups).where("n_shards > 1").count() == 0


def test_a_group_larger_than_a_shard_fills_few_shards(spark):
    rows = [(i, "the same text " * 5) for i in range(1000)] + [(1000 + i, f"another text of its own {i} " * 3) for i in range(2000)]
    got = sharding.shard(frame(spark, rows), shards=16).collect()
    loads = check_shards(rows, got, 16)
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 16
    share = 1000 * len("the same text " * 5 + "1") / (sum(loads) / 16)
    assert len({r["shard"] for r in got if r["doc_id"] < 1000}) <= math.ceil(share) + 2


def test_shards_without_free_documents(spark):
    rows = [(i, f"text {i % 150} " * (1 + i % 11)) for i in range(1650)]   # every text has several documents
    loads = check_shards(rows, sharding.shard(frame(spark, rows), shards=5).collect(), 5)
    assert max(loads) <= 1.05 * sum(loads) / 5


def test_shards_of_awkward_rows(spark, texts):
    docs = frame(spark, texts)
    got = sharding.shard(docs, shards=4).collect()
    check_shards(texts, got, 4)
    assert sharding.shard(docs.limit(0), shards=4).count() == 0
    nothing = frame(spark, [(1, None), (2, None), (3, "")])
    assert [r["size"] for r in sharding.shard(nothing, shards=1).orderBy("slot").collect()] == [1, 1, 1]


def test_quotas_keep_shards_within_their_capacity():
    wanted = np.array([[0, 50, 10], [5, 0, 0], [40, 0, 0]], float)
    load = np.array([100., 95, 60])
    take = sharding.quotas(wanted, load, 100)
    moved = wanted * take[None, :]
    assert (load - moved.sum(axis=1) + moved.sum(axis=0) <= 100 + 1e-3).all() and moved.sum() > 0


# --- lexical search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(rows, items, k):
    docs = [(i, Counter(terms_of(t))) for i, t in rows]
    many = sum(bool(c) for _, c in docs)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    bags = defaultdict(Counter)
    for i, t in dict.fromkeys(items):
        if i is not None:
            bags[i] += Counter(terms_of(t))
    out = []
    for item, bag in bags.items():
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * many // total if total else 0
            s = sum(reps * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, reps in bag.items() if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ITEMS = [(1, "alpha1 ALPHA2 tail"), (2, "one two two"), (3, None), (4, " .,; "), (None, "one"), (5, "köln w3x3 rep rep"),
         (1, "own here"), (1, "own here"), (6, "nowhere"), (7, "é 漢字 Grüße")]


def items_frame(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in ITEMS], "item_id long, text string, doc_id string, score double")


@pytest.mark.parametrize("k, block", [(3, 2048), (20, 2)])
def test_lexical_search_equals_brute_force(spark, texts, k, block):
    rows = [*texts, (20, "漢字 GRÜSSE Grüße é"), *((100 + i, f"one w{i % 7} rep x{i % 3}") for i in range(200))]
    out = lexical_search.search(frame(spark, rows), items_frame(spark), k=k, block=block)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect())) == brute_search(rows, ITEMS, k)


def test_lexical_search_of_nothing(spark, texts):
    docs, items = frame(spark, texts), items_frame(spark)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(frame(spark, [(1, None), (2, " .")]), items).count() == 0


def test_long_texts_are_cut_between_terms():
    rng = np.random.default_rng(0)
    text = " ".join("".join("abcdé"[j] for j in rng.integers(0, 5, int(rng.integers(1, 9)))) for _ in range(250_000)) + " " + "z" * 900_000
    want = Counter(terms_of(text))
    ids = np.zeros(len(want), np.int64)
    words = lexical_search.Terms(np.frombuffer(" ".join(want).encode(), np.uint8), np.array([0, len(" ".join(want).encode())]))
    index = lexical_search.Index(np.array([0]), ids, words.hashes(0), words.hashes(1), np.ones(len(want), np.int64))
    (a, b, parts), = lexical_search.term_runs(pa.array([text]))
    parts = list(parts)
    assert len(parts) > 2
    row, term, tf, total = index.counts(iter(parts), b - a)
    assert total[0] == sum(want.values()) and sorted(tf.tolist()) == sorted(want.values())


def test_scores_beyond_doubles_are_exact():
    index = lexical_search.Index(np.array([5]), np.zeros(2, np.int64), np.array([1, 2], np.uint64), np.array([1, 2], np.uint64),
                                 np.array([2 ** 23, 1], np.int64))
    index.weigh(np.array([1, 1]), 100, 500)
    assert not index.in_doubles
    (_, s), = index.scores(np.array([0, 0]), np.array([0, 1]), np.array([3, 4]), np.array([7]))
    m, w = 75 + 25 * 7 * 100 // 500, math.floor(1000 * math.log(202 / 3))
    assert s[0, 0] == 2 ** 23 * w * (3 * 10 ** 9 // (3000 + 12 * m)) + w * (4 * 10 ** 9 // (4000 + 12 * m))


# --- spelling variants --------------------------------------------------------------------------

def brute_words(rows, change=97):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % change == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((j for j, x in enumerate(a) if x != b[j]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variant_rows(seed):
    rng = np.random.default_rng(seed)
    letters = "abceilnorstuéàÿ÷Z"
    base = ["".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(4, 12)))) for _ in range(25)] + ["aaaaa", "aaaaaa", "abababa"]
    words = []
    for w in base:
        for _ in range(12):
            v = list(w)
            at, kind = int(rng.integers(len(v))), int(rng.integers(3))
            v[at:at + (kind > 0)] = [] if kind == 1 else [letters[int(rng.integers(len(letters)))]]
            words += ["".join(v)] * int(rng.integers(1, 7)) + [w]
    rng.shuffle(words)
    return [(i, " ".join(words[i * 9:i * 9 + 9])) for i in range(len(words) // 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants_equal_brute_force(spark, texts, seed):
    long = "q" * 30_000
    chain = " ".join(["lmnopq"] * 4 + ["lmnopr"] * 9 + ["lmnosr"] * 25)
    rows = [*variant_rows(seed), (9500, chain), *((i + 9000 if i else i, t) for i, t in texts), *((9100 + i, f"{long}x {long} {long}y") for i in range(3))]
    out = spelling.variants(frame(spark, rows))
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    got = list(map(tuple, out.collect()))
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)
    assert any(r[1] and r[1] != r[2] for r in got)   # a chain of forms


def test_spelling_of_nothing(spark, texts):
    docs = frame(spark, texts)
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (None, None), (2, "")])).count() == 0


def test_generated_neighbours_hold_every_edit():
    rng = np.random.default_rng(9)
    for _ in range(200):
        w = "".join(chr(spelling.LETTERS[j]) for j in rng.integers(0, len(spelling.LETTERS), int(rng.integers(2, 9))))
        at = int(rng.integers(len(w)))
        for v in (w[:at] + w[at + 1:], w[:at] + chr(spelling.LETTERS[int(rng.integers(90))]) + w[at + 1:]):
            own, bag, *_ = spelling.neighbourhoods([v])
            _, _, _, key, rest, shorter = spelling.neighbourhoods([w])
            lacks = {x % 2 ** 64 for x in spelling._lacks()}
            assert any(int(k) == int(own[0]) and int(r ^ bag[0]) in lacks and s == (len(v) < len(w)) for k, r, s in zip(key, rest, shorter))
