"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between the borders of block-level
elements.  Comments, declarations, scripts, styles, titles and other raw
elements hold no text; inline elements and line breaks do not end a block
(a line break is white space).  Character references are decoded, white space
becomes one space, empty blocks go.

Each block has features of its ancestors (tags, words of their classes, ids
and roles) and of its text (length, words in links, sentence marks, fixed
words of notices).  A two-label CRF (main text or not) scores blocks and their
neighbours, is trained by maximum likelihood on labelled pages, and is decoded
by Viterbi over the page.  The labelled pages are laid out by rules in this
module (``labelled_pages``): articles in many containers, surrounded and
interrupted by menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, with a label for each block.

Main-text blocks are joined in page order by two line feeds; nothing else is
dropped or cut.  Null, empty and text-less pages give the empty text.  Broken
markup is read as far as it goes: unclosed elements end with their parent,
stray end tags are ignored, unclosed quotes and tags end at the next tag; the
time is linear in the page, of any length.  Text in ``svg``, ``math`` and other
inline elements belongs to its block.  Repeated rows stay repeated; other
columns are carried, a column of the name of the result is replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

DIM = 1 << 13
CHUNK_PAGES = 200

BLOCK_TAGS = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript "
    "object ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul video".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is no markup and runs to their own end tag.
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes".split())
ENDS_P = BLOCK_TAGS - {"button", "label", "object", "iframe", "option", "optgroup", "legend", "caption"}
#: An opening tag closes an open sibling of these.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "thead"), "tbody": ("tbody", "thead", "tr", "td", "th")}
#: An open sibling is not looked for beyond these.
FENCES = frozenset("ul ol dl table select body html article section div main nav aside form header footer".split())

#: A comment, declaration or stray end mark, or a tag.  A tag whose quotes hold no "<" is matched whole;
#: the attributes of any other are read by ``_tag_end``, so that no match is tried beyond the next "<".
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^A-Za-z][^>]*(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/<>]*)(?:((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>)?", re.S)
_STOP = re.compile(r"[<>\"']")
_NAMES = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.!?,;:]")
_NOTICE = re.compile(r"©|\b(?:copyright|rights reserved|cookies?|subscribe|newsletter|sign up|log ?in|privacy|terms of|advert\w*|"
                     r"sponsored|share (?:this|on)|leave a (?:reply|comment)|replied|read more|related)\b", re.I)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


def _ancestor(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of one element: its tag and the words of its names."""
    out = [f"<{tag}"]
    if "=" in attrs:
        for m in _NAMES.finditer(attrs):
            out += [f".{w.lower()}" for w in _PART.findall(unescape(m[1]))]
    return tuple(dict.fromkeys(out))


def _tag_end(html: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """(end of the attributes, end of the tag) for a tag whose name ends at
    ``at``.  A quote that is never closed is an ordinary character; a tag that
    is not closed ends at the next tag.  Every character is passed once."""
    while m := _STOP.search(html, at):
        mark, at = m[0], m.end()
        if mark == ">":
            return at - 1, at
        if mark == "<":
            return at - 1, at - 1
        if at <= last[mark]:
            at = html.index(mark, at) + 1
    return len(html), len(html)


def parse(html: str | None) -> list[Block]:
    """Leaf blocks of a page, in page order."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, linked, at, n = 0, 0, 0, len(html)
    last = {mark: html.rfind(mark) for mark in "\"'>"}

    def close_block():
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(x[1] for x in stack), text, min(1.0, linked / max(1, sum(map(len, parts))))))
            parts, linked = [], 0

    def close_to(names, fences=()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in fences:
                return

    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            parts.append(html[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag, attrs = m[2], m[3]
        if not tag:
            continue
        if attrs is None:
            if m.start() > last[">"]:   # no tag ends from here on
                parts.append(m[0])
                continue
            stop, begin = _tag_end(html, at, last), at
            attrs, at = html[begin:stop[0]], stop[1]
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                close_block()
                close_to((tag,))
            elif tag == "a":
                links = max(0, links - 1)
            continue
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if tag in BLOCK_TAGS:
                close_block()
            at = stop.end() if stop else n
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            close_block()
            links = 0
            if tag in ENDS_P:
                close_to(("p",), FENCES)
            if tag in SIBLINGS:
                close_to(SIBLINGS[tag], FENCES - set(SIBLINGS[tag]))
            if tag not in VOID_TAGS:
                stack.append((tag, _ancestor(tag, attrs)))
        elif tag == "a":
            links += 1
    close_block()
    return out


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIM


NEAR_TAGS = frozenset("<aside <form <nav <footer <section <noscript <template <video <audio <canvas <object".split())


def path_features(path: tuple) -> list[str]:
    out = ["path:" + x for x in dict.fromkeys(x for a in path for x in a)]
    if path:
        out.append("own:" + path[-1][0])
    # names nearest to the block count on their own, as an advert inside an article is an advert
    out += ["near:" + x for a in path[-3:] for x in a if x.startswith(".") or x in NEAR_TAGS]
    return out


def text_features(text: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    marks = len(_MARKS.findall(text))
    return [f"words:{min(words, 200).bit_length()}", f"linked:{int(linked * 4)}", f"marks:{min(marks, 60).bit_length()}",
            "notice" if words < 40 and _NOTICE.search(text) else "plain", "bias"]


class Crf:
    """Weights of a two-label chain: emissions by hashed feature, transitions, first label."""

    def __init__(self):
        self.emit = np.zeros((DIM, 2))
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)
        self._paths: dict[tuple, tuple[float, float]] = {}

    def _score(self, features: list[str]) -> tuple[float, float]:
        s = self.emit[[_slot(f) for f in features]].sum(axis=0)
        return float(s[0]), float(s[1])

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        known, (t0, t1), back = self._paths, self.step.tolist(), []
        a = b = 0.0
        for i, x in enumerate(blocks):
            e = known.get(x.path)
            if e is None:
                if len(known) > 20_000:
                    known.clear()
                e = known[x.path] = self._score(path_features(x.path))
            t = self._text(x.text, x.linked)
            e0, e1 = e[0] + t[0], e[1] + t[1]
            if not i:
                a, b = self.first[0] + e0, self.first[1] + e1
                continue
            from0 = 0 if a + t0[0] >= b + t1[0] else 1
            from1 = 0 if a + t0[1] >= b + t1[1] else 1
            back.append((from0, from1))
            a, b = (e0 + (b + t1[0] if from0 else a + t0[0])), (e1 + (b + t1[1] if from1 else a + t0[1]))
        y = [1 if b > a else 0]
        for f in reversed(back):
            y.append(f[y[-1]])
        return y[::-1]

    def _text(self, text: str, linked: float) -> tuple[float, float]:
        key = tuple(text_features(text, linked))
        e = self._paths.get(key)
        if e is None:
            e = self._paths[key] = self._score(list(key))
        return e


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam; forward and backward passes run over all pages at once."""
    crf = Crf()
    pages = [p for p in pages if p[0]]
    n, t = len(pages), max(len(p[0]) for p in pages)
    slots, where = [], []
    y = np.zeros((n, t), np.int64)
    live = np.zeros((n, t), bool)
    for i, (blocks, labels) in enumerate(pages):
        live[i, :len(blocks)] = True
        y[i, :len(blocks)] = labels
        for j, b in enumerate(blocks):
            s = [_slot(f) for f in path_features(b.path) + text_features(b.text, b.linked)]
            slots += s
            where += [i * t + j] * len(s)
    slots, where = np.array(slots), np.array(where)
    gold = np.eye(2)[y] * live[..., None]
    pairs = live[:, 1:] & live[:, :-1]
    gold_step = np.einsum("ita,itb->ab", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    total = live.sum()
    params = [crf.emit, crf.step, crf.first]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for k in range(1, rounds + 1):
        e = np.stack([np.bincount(where, crf.emit[slots, c], minlength=n * t).reshape(n, t) for c in (0, 1)], axis=2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = crf.first + e[:, 0]
        for j in range(1, t):
            new = lse(fwd[:, j - 1, :, None] + crf.step, 1) + e[:, j]
            fwd[:, j] = np.where(live[:, j, None], new, fwd[:, j - 1])
        for j in range(t - 2, -1, -1):
            new = lse(crf.step + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
            bwd[:, j] = np.where(live[:, j + 1, None], new, 0)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        two = np.exp(fwd[:, :-1, :, None] + crf.step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g_e = (p - gold).reshape(n * t, 2)
        grads = [np.stack([np.bincount(slots, g_e[where, c], minlength=DIM) for c in (0, 1)], axis=1) / total + decay * crf.emit / total,
                 ((two * pairs[..., None, None]).sum(axis=(0, 1)) - gold_step) / total, (p[:, 0] - gold[:, 0]).sum(axis=0) / n]
        for i, (x, g) in enumerate(zip(params, grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.999 ** k)) + 1e-6)
    return crf


# Names that layouts use: fixed values of the labelled pages.
MAIN_BOXES = ["<article>", "<main>", "<article class='post'>", "<div class='content'>", "<div id='main-content'>", "<section class='story'>",
              "<div class='entry-content'>", "<main role='main'>", "<div class='article-body'>", "<div class='post-text'>",
              "<div itemprop='articleBody'>", "<td class='text'>", "<div id='text'>", "<section>", "<div>", ""]
OTHER_BOXES = ["<nav>", "<header>", "<footer>", "<aside>", "<div class='sidebar'>", "<div id='menu'>", "<ul class='nav'>", "<div class='ad'>",
               "<div class='advert'>", "<div class='advertisement'>", "<div class='ads banner'>", "<div class='promo'>", "<div class='sponsored'>",
               "<div class='cookie-notice'>", "<div class='notice'>", "<div class='consent'>", "<div class='popup'>", "<div class='alert'>",
               "<div class='newsletter'>", "<div class='subscribe'>", "<div class='share'>", "<div class='social'>", "<div class='related'>",
               "<section class='comments'>", "<div id='comments'>", "<div class='comment'>", "<ol class='comment-list'>", "<div class='reply'>",
               "<div class='discussion'>", "<div class='breadcrumb'>", "<div class='pagination'>", "<div class='widget'>", "<form>",
               "<div class='footer'>", "<div class='header'>", "<div class='copyright'>", "<div class='login'>", "<div class='search'>",
               "<div class='tags'>", "<div class='toolbar'>", "<div class='disclaimer'>", "<div role='navigation'>", "<div role='banner'>",
               "<noscript>", "<template>", "<video>", "<audio>", "<canvas>", "<object>"]


def labelled_pages(count: int = 500, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Pages laid out by rules, each with a label for every block.  The label
    travels as a mark in front of the block's text and is taken off again."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = ["ka", "lo", "mer", "tin", "sa", "vu", "pel", "no", "ri", "dan", "eu", "sch"]

    def words(lo, hi, stop=True):
        out = ["".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(lo, hi)))]
        for i in range(len(out)):
            if stop and rng.random() < 0.12:
                out[i] += pick([",", ".", ".", ";"])
        return " ".join(out) + ("." if stop and rng.random() < 0.9 else "")

    def end(tag):
        return f"</{re.match(r'<([a-z0-9]+)', tag)[1]}>" if tag else ""

    def other(depth=0):
        box, kind = pick(OTHER_BOXES), rng.random()
        if kind < 0.35:
            inner = "<ul>" + "".join(f"<li><a href='/x'>0|{words(1, 3, False)}</a></li>" for _ in range(int(rng.integers(2, 7)))) + "</ul>"
        elif kind < 0.6:
            inner = "".join(f"<p>0|{words(4, 40)}</p>" for _ in range(int(rng.integers(1, 4))))
        elif kind < 0.75:
            inner = "0|" + pick(["©", "", "We use cookies.", "Subscribe to our newsletter.", "All rights reserved.", "Advertisement"]) + " " + words(2, 25)
        elif kind < 0.85:
            inner = f"<h3>0|{words(1, 4, False)}</h3><div>0|{words(3, 30)}</div>"
        else:
            inner = f"<label>0|{words(1, 3, False)}</label><input><button>0|{words(1, 2, False)}</button>"
        if depth == 0 and rng.random() < 0.2:
            inner += other(1)
        return box + inner + end(box)

    def main():
        box, out = pick(MAIN_BOXES), []
        if rng.random() < 0.7:
            out.append(f"<{(h := pick(['h1', 'h2']))}>1|{words(1, 14, False)}</{h}>")
        for _ in range(int(rng.integers(1, 9))):
            k = rng.random()
            if k < 0.2:
                out.append(f"<p>1|{words(1, 4, rng.random() < 0.5)}</p>")
            elif k < 0.72:
                out.append(f"<p>1|{'<b>' if rng.random() < 0.2 else ''}{words(1, 120)}{'<br>' if rng.random() < 0.2 else ''}</p>")
            elif k < 0.78:
                out.append(f"<h2>1|{words(1, 8, False)}</h2>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>1|{words(2, 20)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote>1|{words(6, 40)}</blockquote>")
            else:
                out.append(other())
        inner = "".join(out)
        if rng.random() < 0.3:
            wrap = pick(["<div>", "<div class='inner'>", "<section>", "<div class='text'>"])
            inner = wrap + inner + end(wrap)
        return box + inner + end(box)

    out = []
    for _ in range(count):
        body = "".join(other() for _ in range(int(rng.integers(1, 4)))) + main() + "".join(other() for _ in range(int(rng.integers(1, 4))))
        if rng.random() < 0.3:
            wrap = pick(["<div id='page'>", "<div class='wrapper'>", "<div class='container'>", "<table><tr><td>"])
            body = wrap + body
        blocks, labels = [], []
        for b in parse(f"<html><body>{body}</body></html>"):
            if b.text[:2] in ("0|", "1|"):
                blocks.append(Block(b.path, b.text[2:].strip() or "-", b.linked))
                labels.append(int(b.text[0]))
        out.append((blocks, labels))
    return out


def main_text(html: str | None, crf: Crf) -> str:
    blocks = parse(html)
    return "\n\n".join(b.text for b, y in zip(blocks, crf.decode(blocks)) if y)


def extract(pages: DataFrame, crf: Crf | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The pages' columns and the main text."""
    shared = pages.sparkSession.sparkContext.broadcast(crf or train(labelled_pages()))

    @lean
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for col in batches:
            texts: list[pa.Array] = []
            for a in range(0, len(col), CHUNK_PAGES):
                texts.append(pa.array([main_text(h.as_py(), model) for h in col.slice(a, CHUNK_PAGES)], pa.string()))
            yield pa.concat_arrays(texts) if texts else pa.array([], pa.string())

    return pages.withColumn(out_col, F.arrow_udf(work, "string").asNondeterministic()(html_col))
