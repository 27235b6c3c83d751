"""URL filter, main text, top-k search, byte-level BPE and the pipeline against brute force."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe, html_extract, topk_search, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- URL filter ---------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("ORG", "/a", "block"), ("org", "/a", "allow"), (None, "/", "block"), ("co.uk", "", "block")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    best = None
    for h, p, v in RULES:
        h = h.lower() if h else h
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), v == "block")
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_urls_against_brute_force(spark):
    urls = ["http://a.Example.com/en/1?x=/en/", "https://www.example.com/en/2#t", "http://x.www.example.com/en/", "http://example.com",
            "http://example.com/", "https://b.net/es/9", "https://b.net/ES/9", "http://net/es/", "http://xnet/es/", "//b.net/es/", "", None,
            "://", "http://?q", "http://a.org/abc", "http://u:p@a.org:80/abc", "http://shop.co.uk?x", "http://" + "a." * 300 + "com/" + "d/" * 500,
            "ftp://com/en/://x.net/es/", "http://b.net/es/9", "http://b.net/es/9"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, urls[0], "c", "c")],
                                  "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {(r["page_id"]): tuple(r)[1:] for r in url_filter.judge_pages(pages, rules).collect()}
    assert got == {**{i: brute_url(u) for i, u in enumerate(urls)}, None: brute_url(urls[0])}
    plan = url_filter.judge_pages(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # the prefix of the digest is the only key of the join with the rules
    joins = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "Join" in line and "rule_key" in line]
    assert joins and all("x_key" in line and "x_digest" not in line.split("Inner")[0] for line in joins)


def test_url_rules_that_share_a_digest_prefix(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX_HEX", 1)
    rules = spark.createDataFrame([(f"h{i}.net", f"/{i % 7}/", "block" if i % 2 else "allow") for i in range(200)],
                                  "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://a.h{i}.net/{i % 5}/x") for i in range(250)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_pages(pages, rules).collect()}
    fits = lambda i: i < 200 and i % 7 == i % 5
    assert got == {i: (f"h{i}.net/{i % 7}/", "block" if i % 2 else "allow") if fits(i) else (None, "allow") for i in range(250)}


def test_urls_without_pages_or_rules(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://b.net/es/")], "page_id long, url string")
    assert url_filter.judge_pages(pages.limit(0), rules).count() == 0
    assert url_filter.judge_pages(pages, rules.limit(0)).first()["verdict"] == "allow"


# --- main text ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def crf():
    return html_extract.train(html_extract.labelled_pages())


def test_crf_on_held_out_layouts(crf):
    good = total = 0
    for blocks, labels in html_extract.labelled_pages(200, seed=77):
        good += sum(a == b for a, b in zip(crf.decode(blocks), labels))
        total += len(labels)
    assert good / total > 0.99


def test_main_text(crf):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body>"
            "<header><h1>Site</h1></header><nav><ul><li><a href='/x'>Home</a><li><a href=\"/a>b\">News</a></ul></nav>"
            "<div class='cookie-notice'>We use cookies.</div><article><h1>Title &amp;&lt;b&gt;</h1><p>First <b>bold.<br>line\n two&nbsp;end"
            "<p>Second, with words.</p><!-- <p>hidden</p> --><div class='ad'>Buy now</div><ul><li>one thing here<li>another thing there</ul>"
            "<form><label>Mail</label><input><button>Send</button></form><section class='comments'><h3>Comments</h3><p>Great article, "
            "thank you very much for it.</p></section></article><aside><p>Related stories are here for you.</p></aside><footer>&copy; me</footer>")
    assert html_extract.main_text(page, crf) == ("Title &<b>\n\nFirst bold. line two end\n\nSecond, with words.\n\none thing here\n\n"
                                                 "another thing there")
    for empty in (None, "", "   ", "<html></html>", "<script>x</script>", "<!-- x", "<p", "</p></div>"):
        assert html_extract.main_text(empty, crf) in ("", "<p")
    long = "<article>" + "".join(f"<p>Paragraph {i}, with some words in it.</p>" for i in range(5000)) + "</article>"
    assert html_extract.main_text(long, crf).count("\n\n") == 4999


def test_viterbi_is_the_best_path(crf):
    import itertools
    blocks = html_extract.labelled_pages(1, seed=5)[0][0][:10]
    score = lambda y: (crf.first[y[0]] + sum(crf.step[a, b] for a, b in zip(y, y[1:]))
                       + sum(crf._score(html_extract.path_features(b.path) + html_extract.text_features(b.text, b.linked))[k]
                             for b, k in zip(blocks, y)))
    best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
    assert score(crf.decode(blocks)) == pytest.approx(score(best))


def test_extract_of_awkward_rows(spark, crf):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<article><p>Some text, here.</p></article>", "t"),
                                   (1, "u", None, "t")], "page_id long, url string, html string, path string")
    got = html_extract.extract(pages, crf)
    assert got.columns == [*pages.columns, "text"]
    assert sorted(r["text"] for r in got.collect()) == ["", "", "", "Some text, here."]
    assert html_extract.extract(pages.limit(0), crf).count() == 0


# --- top-k search -------------------------------------------------------------------------------

def brute_topk(rows, k, every):
    vec = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            vec[i] = np.floor(64 * np.array(v, float)).astype(int)
    dim = max(set(map(len, vec.values())), key=lambda d: (sum(len(v) == d for v in vec.values()), -d))
    vec = {i: v for i, v in vec.items() if len(v) == dim}
    out = []
    for q in vec:
        if q % every == 0:
            best = sorted((-int(vec[q] @ v), i) for i, v in vec.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim,k", [(64, 20), (7, 3), (1, 5)])
def test_topk_against_brute_force(spark, dim, k):
    rng = np.random.default_rng(dim)
    centers = rng.normal(size=(8, dim))
    rows = [(i, (centers[i % 8] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]     # ties
    rows += [(2000, None), (2020, [float("nan")] * dim), (2040, [None] * dim), (2060, []), (None, rows[0][1]), (2080, [1.0] * (dim + 1)),
             (2100, [float("inf")] * dim), (-20, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, v string")
    got = topk_search.search(df, k=k, query_block=16, candidate_block=150)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, k, 20)


def test_topk_of_little(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.search(df).collect()] == [(20, 1, 3, 64 * 32 + 128 * 32)]
    assert topk_search.search(df.limit(0)).count() == 0 and topk_search.search(df.where("vec_id = 3")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    exact = x @ y.T
    last = None
    for s in topk_search.segment_levels(64):
        bound = topk_search.segment_stats(x, s) @ topk_search.segment_stats(y, s).T
        assert (bound >= exact - 1e-9).all()
        assert last is None or (bound <= last + 1e-9).all()     # finer is tighter
        last = bound


# --- byte-level BPE -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, reference, texts):
    rng = np.random.default_rng(3)
    odd = ["<|endoftext|> a", "naïve 漢字仮名 🙂🙂 ‍é", "x" * 3000, "\u0000\u0001\r\n\t  \n", "".join(map(chr, rng.integers(1, 0xD7FF, 3000)))]
    rows = [*texts, *((100 + i, t) for i, t in enumerate(odd))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe.encode_decode(df, PATH, public_tokenizers.PATTERN)
    key = lambda r: (str(r[0]), r[2])
    have = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got.collect()), key=key)
    want = sorted(((i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=key)
    assert have == want
    assert bpe.encode_decode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    tokens = bpe.load_ranks(PATH)
    keys = bpe.byte_hashes(tokens)
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(len(tokens)))


def test_small_memory_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    coder = bpe.Coder(bpe.Vocabulary(bpe.load_ranks(PATH)), public_tokenizers.PATTERN)
    for t in ["some words that are new", "some words that are old and unknownish", "zzqx words some zzqx"] * 3:
        assert coder.encode(t) == reference.encode_ordinary(t) and coder.decode(coder.encode(t)) == t.encode()


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, sf001, reference):
    import corpus_pipeline as cp
    from tessera.llm import decontaminate

    from .test_text_operators import brute_join, brute_lines, split

    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    before, out = rows(docs), {}
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf001).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = out[name] = rows(docs)
        if name == "quality":
            kept = {i for i, _ in after}
            assert all(i in kept for i, _ in before if labels.get(i) == 1)
            assert sum(i in kept for i, _ in before if labels.get(i) == 0) <= 1
        elif name == "line_dedup":
            assert after == [(i, t) for i, t, _, n in brute_lines(before) if n == 0 or t.strip()]
        elif name == "near_duplicates":
            assert [i for i, _ in after] == sorted(i for i, _, c in brute_join(before, 5, 80, 100) if i == c)
        elif name == "decontamination":
            items = [[w.decode() for w in split(r["text"], True)] for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
            leak = {i for i, t in before for w in [[x.decode() for x in split(t, True)]]
                    if any(decontaminate.best_match(x, w) <= int(0.2 * len(x) + 1e-9) for x in items)}
            assert [i for i, _ in after] == [i for i, _ in before if i not in leak]
        before = after
    got = {r["doc_id"]: r["token_ids"] for r in cp.STAGES[-1][1](spark, docs, sf001).collect()}
    assert got == {i: reference.encode_ordinary(t) for i, t in before}


def test_run_gives_the_last_stage(spark, sf001):
    import corpus_pipeline as cp
    got = cp.run(spark, sf001)
    assert got.columns[:4] == ["doc_id", "lang", "source", "n_tokens"] and got.count() > 100


def test_each_vector_length_is_searched_among_its_own(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)] if i < 60 else [float(i % 5), 2.0]) for i in range(100)]
    got = {}
    for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, query_every=20, scale=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in rows[::20]:
        best = sorted((-int(sum(64 * x * 64 * y for x, y in zip(v, w))), i) for i, w in rows if i != q and len(w) == len(v))[:3]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
