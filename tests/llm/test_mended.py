"""Cases that earlier versions got wrong: clashing column names, hot lines, remembered
words, large integer scores, broken markup, rows that repeat an id."""

import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html_extract, line_dedup, substring_dedup, topk_search

from .test_text_operators import brute_lines

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def vary(rng, s, most):
    s = list(s)
    for _ in range(int(rng.integers(0, most + 1))):
        at, kind = int(rng.integers(len(s) + 1)), int(rng.integers(3))
        s[at:at + (kind > 0)] = [] if kind == 1 else ["abé🙂"[int(rng.integers(4))]]
    return "".join(s)


def test_bit_parallel_edits_equal_the_table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(1500):
        a = "".join("abcd é"[i] for i in rng.integers(0, 6, int(rng.integers(0, 40))))
        b = vary(rng, a, 4) if a else "x" * int(rng.integers(0, 4))
        if abs(len(a) - len(b)) <= 2:
            rows.append((a, b, edits(a, b) <= 2))
    df = spark.createDataFrame(rows, "a string, b string, w boolean")
    assert df.where(line_dedup.within_edits(F.col("a"), F.col("b")) != F.col("w")).count() == 0
    assert {w for *_, w in rows} == {True, False}


@pytest.mark.parametrize("most", [1, 3])
def test_a_crowd_of_near_lines(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    rng = np.random.default_rng(most)
    base = ["in this family every line is a near copy of one", "of all that is the other so much longer second family of lines here"]
    rows = [(i, "\n".join([vary(rng, base[i % 2], most), "tail " + "".join("abcdefgh"[j] for j in rng.integers(0, 8, 30))])) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in line_dedup.dedup(docs).collect()) == brute_lines(rows)


def test_columns_of_any_name(spark):
    base = " ".join(f"alpha{i}" for i in range(40))
    names = ["want", "_doc", "_drop", "_parts", "doc", "gone", "parts", "spans", "s_doc", "_x", "done", "found", "_leaks_0", "pos", "line", "h"]
    docs = spark.createDataFrame([(i, base, *["x"] * len(names)) for i in range(3)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, " ".join(base.split()[:12]))], "item_id long, text string")
    for out, more in ((line_dedup.dedup(docs), ["n_lines", "n_removed"]), (substring_dedup.dedup(docs), ["n_words", "n_removed", "kept"]),
                      (decontaminate.decontaminate(docs, items), ["leaks"])):
        assert out.columns == [*docs.columns, *more]
        assert all(r[n] == "x" for r in out.collect() for n in names)
    again = line_dedup.dedup(docs.withColumn("n_removed", F.lit("old")))
    assert again.columns == [*docs.columns, "n_lines", "n_removed"] and {r["n_removed"] for r in again.collect()} == {0, 1}


def test_remembered_words_cost_a_lookup():
    class Older(dict):
        def __iter__(self):
            raise AssertionError("walks what is remembered")

    coder = bpe.Coder(bpe.Vocabulary(bpe.load_ranks(PATH)), public_tokenizers.PATTERN)
    want = coder.encode("some qzx words wqz")
    coder.older = Older(coder.known)
    coder.known = {}
    assert coder.encode("some qzx words wqz") == want and " qzx" in coder.known


def test_short_pretokens_merge_as_long_ones(monkeypatch):
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(PATH))}
    rng = np.random.default_rng(1)
    words = ["".join("aeinrst é漢"[i] for i in rng.integers(0, 10, int(rng.integers(1, 30)))).encode() for _ in range(400)]
    short = [bpe.merge_short(w, ranks) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.merge_bytes(w, ranks) for w in words] == short


def test_large_scores_are_exact(spark):
    big = 2 ** 30
    rows = [(0, [float(big), 1.0]), *((i, [float(big), float(i)]) for i in range(1, 8)), (8, [-float(big), 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk_search.search(df, k=5, query_every=20, scale=1).orderBy("rank").collect()]
    assert got == [(i, big * big + i) for i in (7, 6, 5, 4, 3)]
    far = spark.createDataFrame([(i, [2.0 ** 40] * 4) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.search(far, k=2, query_every=20, scale=1).collect()


def test_top_block_prunes_alike_for_large_and_small_values():
    rng = np.random.default_rng(2)
    for scale in (10, 10 ** 8):
        x = rng.integers(-scale, scale, (900, 16))
        q, ids = x[:30], np.arange(900)
        a, b, s = topk_search.top_block(ids[:30], q, ids, x, 5, tile=64)
        for k in range(30):
            full = sorted(((-sum(int(u) * int(v) for u, v in zip(q[k], x[j])), j) for j in range(900) if j != k))[:5]
            assert [(-t, j) for t, j in full] == list(zip(s[a == k].tolist(), b[a == k].tolist()))


def test_inline_elements_and_broken_markup():
    text = lambda html: [b.text for b in html_extract.parse(html)]
    assert text("<p>Energy is <math><mi>E</mi>=mc2</math> here.</p>") == ["Energy is E=mc2 here."]
    assert text("<p>One <svg><g> two</p><p>three") == ["One two", "three"]
    assert text("<p title='a>b'>one</p><p title=\"a<b>c\">two</p><p>c < d and x <y then") == ["one", "two", "c < d and x <y then"]
    assert text("<script>if (a < b) { '</p>' }</script><p>kept</p><script>open") == ["kept"]


def test_markup_takes_linear_time():
    for piece in ("<a x='", "<a '>'", "</1 ", "<b ", "</script ", "<p title=\"a<b\">x</p>", "<!-", "<p a='\"'>"):
        began = time.perf_counter()
        html_extract.parse(piece * 30_000)
        assert time.perf_counter() - began < 10, piece


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark, sf001):
    import corpus_pipeline as cp
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, words("a")), (1, words("b")), (2, words("b") + " tail"), (3, words("c")), (3, words("c")), (4, words("d")),
            (4, words("a")), (None, words("a")), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(cp.STAGES)["near_duplicates"]
    got = sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, sf001).collect()), key=str)
    want = [(1, words("a")), (1, words("b")), (3, words("c")), (4, words("d")), (None, words("a")), (5, None), (5, "")]
    assert got == sorted(want, key=str)
    once = docs.where("doc_id in (2, 4) and text not like 'a%'")
    assert stage(spark, once, sf001).count() == 2


