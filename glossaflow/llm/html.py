"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags, inline tags
inside) by a forgiving tokenizer. Each block becomes a vector: the tags on its path,
hashed words of their class, id and role, hashed words of its text, and a few
measures. A bidirectional LSTM in numpy reads the blocks of a page in order and
labels each as article or not, with the whole document as context; the label alone
decides. It is trained here, on generated pages, once a process. Of elements that
articles seldom stand in, such as a form, a vector tells what share of the page's text
the nearest and the outermost one hold, and whether a title or an article element stands
inside: so a page-wide form and a long sidebar look different.

What is on a path is kept once an element, as bits, and vectors are made in bounded
pieces, so deep and long pages take memory in proportion to their size.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, spread

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!(?!--)[^>]*+>?|<\?[^>]*+>?"""
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attr2>[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W_]+")
#: Fixed values of HTML: elements whose content isn't text of the page, those without content, block-level and inline ones.
_RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: Those of them that reach to the end of a page that doesn't end them.
_TO_END = frozenset("script style title textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAGS = (
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre figure figcaption "
    "nav header footer aside form fieldset legend button select option label address details summary center dialog hgroup menu"
).split()
_TAG_NO = {t: i for i, t in enumerate(_TAGS)}
_CLOSES_P = frozenset(_TAGS) - {"label", "button", "select", "option", "legend"}
_NEVER = frozenset("nav footer aside form button select option dialog menu head".split())
_TITLED = frozenset("article main h1".split())
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "p": ("div", "article", "section", "td", "th", "li", "body", "blockquote", "main", "aside", "nav", "footer", "header", "form", "figure", "button")}
_HASH_NAMES, _HASH_WORDS, _MEASURES = 256, 64, 14
_AT_NAMES = 2 * len(_TAGS)
_AT_WORDS = _AT_NAMES + 2 * _HASH_NAMES
WIDTH = _AT_WORDS + _HASH_WORDS + _MEASURES


@dataclass(slots=True)
class Block:
    marks: int  # bits of the vector's first places: path, last tag, words of class, id and role, those of the nearest element with any
    text: str
    linked: int  # characters inside links
    inner: list[int] | None = None  # of the nearest _NEVER element: characters of its blocks, and whether a title or an article stands in it
    outer: list[int] | None = None  # of the outermost one


class _Element:
    """An open element, with the marks of a block right inside."""

    __slots__ = ("tag", "path", "near", "marks", "held", "inner", "outer", "around")

    def __init__(self, tag: str, words: set[str], parent: _Element | None):
        self.tag = tag
        own = 1 << _TAG_NO[tag]
        near = 0
        for w in words:
            bit = 1 << _AT_NAMES + _slot(w, _HASH_NAMES)
            own |= bit
            near |= bit << _HASH_NAMES
        self.path = own | (parent.path if parent else 0)
        self.near = near or (parent.near if parent else 0)
        self.marks = self.path | 1 << len(_TAGS) + _TAG_NO[tag] | self.near
        self.around = parent.inner if parent else None
        self.held = [0, 0] if tag in _NEVER else None
        self.inner = self.around if self.held is None else self.held
        self.outer = (parent.outer if parent else None) or self.inner
        if tag in _TITLED and self.inner:
            self.inner[1] = 1

    def closed(self) -> None:
        """Hands what it held on to the _NEVER element around it."""
        if self.held and self.around:
            self.around[0] += self.held[0]
            self.around[1] |= self.held[1]


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with references decoded and white space collapsed."""
    out: list[Block] = []
    stack: list[_Element] = []
    open_: Counter = Counter()
    held: list[str] = []
    state = {"link": 0, "linked": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            last = stack[-1] if stack else None
            out.append(Block(last.marks if last else 0, text, min(state["linked"], len(text)), last and last.inner, last and last.outer))
            if last and last.inner:
                last.inner[0] += len(text)
        state["linked"] = 0

    def add(text: str) -> None:
        held.append(text)
        if state["link"]:
            state["linked"] += len(text)

    def close(tag: str, stop: tuple[str, ...] = ()) -> None:
        if not open_[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                for e in reversed(stack[i:]):
                    open_[e.tag] -= 1
                    e.closed()
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    source = page or ""
    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a":
                state["link"] = 0
            elif tag in _TAG_NO:
                flush()
                close(tag)
            elif tag == "br":
                add(" ")
            continue
        attr = m["attr"] or m["attr2"] or ""
        if tag in _RAW and not attr.rstrip().endswith("/"):
            end = _raw_end(tag).search(source, at)
            if end or tag in _TO_END:
                at = end.end() if end else len(source)
            continue
        if tag in ("br", "img", "wbr", "input"):
            add("" if tag == "wbr" else " ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            state["link"] = 1
        elif tag in _TAG_NO:
            flush()
            if tag in _CLOSES_P:
                close("p", _SCOPE["p"])
            if tag in _SCOPE and tag != "p":
                close(tag, _SCOPE[tag])
            words = {w.lower() for v in _ATTR.findall(attr) for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(v)).replace("_", " "))}
            stack.append(_Element(tag, words, stack[-1] if stack else None))
            open_[tag] += 1
            state["link"] = 0
    flush()
    for e in reversed(stack):
        e.closed()
    return out


@functools.lru_cache(maxsize=16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def vectors(page: list[Block], begin: int = 0, end: int | None = None, longest: int | None = None) -> np.ndarray:
    """Of the page's blocks from begin to end; longest: characters of the page's longest block."""
    part = page[begin:end]
    out = np.zeros((len(part), WIDTH), np.float32)
    size = -(-_AT_WORDS // 8)
    marks = np.frombuffer(b"".join(b.marks.to_bytes(size, "little") for b in part), np.uint8).reshape(len(part), size)
    out[:, :_AT_WORDS] = np.unpackbits(marks, axis=1, bitorder="little")[:, :_AT_WORDS]
    longest = longest or max((len(b.text) for b in page), default=1)
    whole = sum(len(b.text) for b in page)
    for i, b in enumerate(part, begin):
        row = out[i - begin]
        words = [w.lower() for w in _WORD.findall(b.text)]
        n = len(words) or 1
        for w in words:
            row[_AT_WORDS + _slot(w, _HASH_WORDS)] += 2.0 / n
        k = WIDTH - _MEASURES
        chars = len(b.text)
        row[k : k + _MEASURES] = (
            np.log1p(chars) / 8,
            b.linked / chars,
            min(1.0, 10 * sum(b.text.count(c) for c in ".,;:!?") / chars),
            b.text[-1] in ".!?…\"»”",
            "©" in b.text or "®" in b.text,
            sum(map(str.isdigit, b.text)) / chars,
            i / len(page),
            (len(page) - 1 - i) / len(page),
            chars / longest,
            min(1.0, len(words) / 10),
            *((b.inner[0] / whole, b.inner[1]) if b.inner else (0, 0)),
            *((b.outer[0] / whole, b.outer[1]) if b.outer else (0, 0)),
        )
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output; sequences of a batch are padded at the end."""

    def __init__(self, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (r.normal(size=(WIDTH, 4 * hidden)) * 0.1).astype(np.float32)
            self.p["h" + d] = (r.normal(size=(hidden, 4 * hidden)) * 0.2).astype(np.float32)
            self.p["c" + d] = np.repeat(np.float32([0, 1, 0, 0]), hidden)  # in, forget, out, new
        self.p["o"] = (r.normal(size=2 * hidden) * 0.2).astype(np.float32)
        self.p["s"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (T, B, W). Hidden states in page order, and what the backward pass needs."""
        return self._steps(x @ self.p["x" + d] + self.p["c" + d], mask, d, keep)

    def _steps(self, z: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        T, B, _ = z.shape
        H = self.hidden
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        out, trace = np.zeros((T, B, H), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            g = z[t] + h @ self.p["h" + d]
            i, f, o = (self._sigmoid(g[:, k * H : (k + 1) * H]) for k in range(3))
            n = np.tanh(g[:, 3 * H :])
            m = mask[t][:, None]
            c2 = f * c + i * n
            th = np.tanh(c2)
            h2 = o * th
            if keep:
                trace.append((t, h, c, i, f, o, n, th, m))
            c, h = m * c2 + (1 - m) * c, m * h2 + (1 - m) * h
            out[t] = h
        return out, trace

    def _scores(self, hf, hb):
        H = self.hidden
        return hf @ self.p["o"][:H] + hb @ self.p["o"][H:] + self.p["s"]

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        H = self.hidden
        hf, tf = self._run(x, mask, "f", True)
        hb, tb = self._run(x, mask, "b", True)
        d = (self._sigmoid(self._scores(hf, hb)) - y) * mask / mask.sum()
        grad = {"o": np.r_[np.tensordot(d, hf, 2), np.tensordot(d, hb, 2)], "s": np.array([d.sum()])}
        for k, trace, w in (("f", tf, self.p["o"][:H]), ("b", tb, self.p["o"][H:])):
            dz = np.zeros((*x.shape[:2], 4 * H), np.float32)
            dh, dc = np.zeros((x.shape[1], H), np.float32), np.zeros((x.shape[1], H), np.float32)
            gh = np.zeros_like(self.p["h" + k])
            for t, h, c, i, f, o, n, th, m in reversed(trace):
                dh = dh + d[t][:, None] * w
                d2, c2 = dh * m, dc * m
                c2 = c2 + d2 * o * (1 - th * th)
                g = np.concatenate([c2 * n * i * (1 - i), c2 * c * f * (1 - f), d2 * th * o * (1 - o), c2 * i * (1 - n * n)], axis=1)
                dz[t] = g
                gh += h.T @ g
                dh, dc = dh * (1 - m) + g @ self.p["h" + k].T, dc * (1 - m) + c2 * f
            grad["x" + k] = np.tensordot(x, dz, ((0, 1), (0, 1)))
            grad["h" + k] = gh
            grad["c" + k] = dz.sum((0, 1))
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 24, rate: float = 0.01, seed: int = 1) -> Labeller:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        n = 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(pages), batch):
                x, mask, y = padded([pages[i] for i in order[at : at + batch]])
                n += 1
                for k, g in self.step(x, y, mask).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.99**n) / (1 - 0.9**n)
                    self.p[k] = (self.p[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]], cells: int = 1 << 14) -> list[np.ndarray]:
        """Probability of each block; pages of like length share a batch of at most cells blocks (a longer page is its own)."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= cells:
                end += 1
            ids = order[at:end]
            mask = np.zeros((len(pages[ids[-1]]), len(ids)), np.float32)
            for j, i in enumerate(ids):
                mask[: len(pages[i]), j] = 1
            hidden = []
            for some in ("fb",) if len(mask) <= cells else ("f", "b"):  # a long page is read twice, to hold less at a time
                z = self._inputs(pages, ids, mask.shape, some, cells)
                hidden += [self._steps(z.pop(d), mask, d, False)[0] for d in some]
            p = self._sigmoid(self._scores(*hidden))
            for j, i in enumerate(ids):
                out[i] = p[: len(pages[i]), j]
            at = end
        return out

    def _inputs(self, pages: list[list[Block]], ids: list[int], shape: tuple[int, int], directions: str, cells: int) -> dict[str, np.ndarray]:
        """What the cells of each direction get from a batch's blocks; vectors are made for at most cells blocks at a time."""
        z = {d: np.zeros((*shape, 4 * self.hidden), np.float32) for d in directions}
        for j, i in enumerate(ids):
            longest = max(len(b.text) for b in pages[i])
            for begin in range(0, len(pages[i]), cells):
                part = vectors(pages[i], begin, begin + cells, longest)
                for d in directions:
                    z[d][begin : begin + len(part), j] = part @ self.p["x" + d] + self.p["c" + d]
        return z


def padded(pages: list[tuple[np.ndarray, np.ndarray]]):
    T = max(len(x) for x, _ in pages)
    x = np.zeros((T, len(pages), WIDTH), np.float32)
    mask, y = np.zeros((T, len(pages)), np.float32), np.zeros((T, len(pages)), np.float32)
    for j, (v, t) in enumerate(pages):
        x[: len(v), j], mask[: len(v), j], y[: len(v), j] = v, 1, t
    return x, mask, y



def generated(r: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout, and its article blocks."""
    syllables = [r.choice("bcdfghlmnprstvz") + r.choice("aeiouéäó") + r.choice(["", "n", "r", "s"]) for _ in range(40)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))

    def prose(lo: int, hi: int) -> str:
        ws = [word() for _ in range(r.randrange(lo, hi))]
        text = " ".join(w + ("," if r.random() < 0.08 else ". " if r.random() < 0.08 else "") for w in ws)
        return text[:1].upper() + text[1:] + r.choice([".", ".", ".", "", "!"])

    gold: list[str] = []

    def good(text: str) -> str:
        gold.append(" ".join(text.split()))
        return text

    def attr(*names: str) -> str:
        picked = r.choice(names)
        extra = "" if r.random() < 0.6 else " " + word()
        return f' {r.choice(["class", "class", "id"])}="{picked}{extra}"' if picked else ""

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{r.choice([word(), word() + " " + word(), "Home", "About", "Contact", "News"])}</a></li>' for _ in range(n))

    def menu() -> str:
        return r.choice([f"<nav><ul>{links(r.randrange(2, 9))}</ul></nav>", f"<div{attr('menu', 'nav', 'navbar', 'navigation', 'topnav', 'main-menu')}><ul>{links(r.randrange(2, 9))}</ul></div>", f"<ul{attr('menu', 'nav', 'breadcrumb', 'breadcrumbs')}>{links(r.randrange(2, 7))}</ul>"])

    def header() -> str:
        inner = r.choice([f"<h1>{word()}</h1>", f"<div>{prose(2, 8)}</div>", f"<p>{prose(2, 9)}</p>", f'<a href="/">{word()} {word()}</a>'])
        return r.choice([f"<header>{inner}{menu() if r.random() < 0.5 else ''}</header>", f"<div{attr('header', 'site-header', 'masthead', 'top-bar')}>{inner}</div>"])

    def footer() -> str:
        text = r.choice([f"&copy; {word()}.example.com &middot; {prose(4, 20)}", f"Copyright 2020 {word()}. All rights reserved.", prose(4, 25), f"<ul>{links(4)}</ul>"])
        return r.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p><p>{prose(3, 9)}</p></footer>", f"<div{attr('footer', 'site-footer', 'bottom', 'copyright', 'legal')}>{text}</div>"])

    def advert() -> str:
        text = r.choice([prose(3, 20), f"Sponsored: {prose(3, 10)}", f"Advertisement {prose(2, 8)}", f'<a href="/">{prose(3, 9)}</a>'])
        return f"<!-- ad -->" * r.randrange(2) + f"<{(t := r.choice(['div', 'div', 'section', 'p']))}{attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'ad-slot', 'adbox')}>{text}</{t}>"

    def notice() -> str:
        text = r.choice(["We use cookies to improve this site.", f"This site uses cookies. {prose(4, 12)}", prose(5, 20), "Accept all cookies", f"Subscribe to our newsletter {prose(3, 9)}"])
        return f"<div{attr('cookie', 'cookie-banner', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'newsletter', 'subscribe', 'modal', 'cookie-notice')}><p>{text}</p>{'<button>OK</button>' if r.random() < 0.5 else ''}</div>"

    def sidebar() -> str:
        inner = "".join(r.choice([f"<p>{prose(4, 25)}</p>", f"<h3>{prose(1, 4)}</h3>", f"<ul>{links(r.randrange(2, 6))}</ul>"]) for _ in range(r.randrange(1, 5) if r.random() < 0.75 else r.randrange(5, 16)))
        return r.choice([f"<aside>{inner}</aside>", f"<aside><h3>{prose(1, 4)}</h3>{''.join(f'<p>{prose(8, 60)}</p>' for _ in range(r.randrange(1, 8)))}</aside>", f"<div{attr('sidebar', 'side', 'widget', 'related', 'recommended', 'popular', 'trending', 'more-stories', 'share', 'social')}>{inner}</div>"])

    def form() -> str:
        if r.random() < 0.4:
            return f"<form{attr('', 'signup', 'subscribe', 'survey')}>{''.join(f'<p>{prose(3, 40)}</p>' for _ in range(r.randrange(1, 6)))}{r.choice(['', '<input name=e>'])}<button>{word()}</button></form>"
        return f"<form action='/s'><label>{prose(1, 4)}</label><input name=q>{'<p>' + prose(3, 12) + '</p>' if r.random() < 0.4 else ''}<button>{r.choice(['Search', 'Send', word()])}</button></form>"

    def comments() -> str:
        each = "".join(f"<{(t := r.choice(['div', 'li', 'article', 'p']))}{attr('comment', 'reply', 'comment-body')}>{'<b>' + word() + '</b> ' if r.random() < 0.5 else ''}{'<p>' if t != 'p' and r.random() < 0.5 else ''}{prose(3, 40)}</{t}>" for _ in range(r.randrange(1, 6)))
        return f"<{(t := r.choice(['div', 'section', 'ol', 'div']))}{attr('comments', 'comment-list', 'discussion', 'replies', 'respond', 'reader-comments')}><h3>{r.choice(['Comments', prose(1, 3), '3 comments'])}</h3>{each}</{t}>"

    def article() -> str:
        title = prose(3, 14)
        made = [f"<h1>{good(title)}</h1>"] if r.random() < 0.85 else []
        sloppy = r.random() < 0.35
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.72:
                short = r.random() < 0.25
                text = r.choice([word().capitalize() + ".", word()[:2], prose(1, 4), prose(1, 4)]) if short else prose(8, 90)
                if r.random() < 0.03:  # as footers have it
                    text = r.choice([f"This {word()} is licensed under the {word()} Public License, version {r.randrange(1, 5)}.", f"All rights reserved by {word()} {word()}.", f"Licensed under {prose(2, 8)}"])
                if r.random() < 0.06:  # figures only, over lines at times
                    figures = [str(r.randrange(10 ** r.randrange(1, 6))) for _ in range(r.randrange(1, 7))]
                    made.append("<p>" + r.choice(["<br>", " "]).join(figures) + "</p>")
                    good(" ".join(figures))
                    continue
                if r.random() < 0.04:  # one word over and over
                    text = word() + f" {word()[: r.randrange(1, 4)]}" * r.randrange(20, 400) + r.choice([".", ""])
                bold = "<b>" if sloppy and r.random() < 0.3 else ""
                made.append(f"<p>{bold}{good(text)}" + ("<br>" if sloppy and r.random() < 0.3 else "</p>"))
            elif kind < 0.80:
                made.append(f"<h2>{good(prose(1, 7))}</h2>")
            elif kind < 0.86:
                made.append("<ul>" + "".join(f"<li>{good(prose(2, 15))}</li>" for _ in range(r.randrange(1, 6))) + "</ul>")
            elif kind < 0.89:
                made.append(f"<blockquote>{good(prose(4, 30))}</blockquote>")
            elif kind < 0.91:
                made.append("<table>" + "".join("<tr>" + "".join(f"<td>{good(prose(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.93:
                made.append(f"<div>{good(prose(8, 60))}</div>")
            elif kind < 0.96:
                made.append(advert())
            else:
                made.append(r.choice([sidebar, form, form, notice])())
        if r.random() < 0.12:
            made.append(comments())
        body = "\n".join(made)
        return r.choice(
            [f"<article>{body}</article>"] * 5
            + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div{attr('content', 'article', 'post', 'entry-content', 'story', 'article-body', 'main', 'text')}>{body}</div>", f"<div{attr('', word())}>{body}</div>", f"<section>{body}</section>", body]
        )

    parts = []
    for f, chance in ((notice, 0.3), (header, 0.4), (menu, 0.8), (advert, 0.6), (form, 0.15), (sidebar, 0.2)):
        if r.random() < chance:
            parts.append(f())
    parts.append(article())
    for f, chance in ((comments, 0.3), (sidebar, 0.35), (advert, 0.25), (form, 0.15), (notice, 0.2), (footer, 0.85)):
        if r.random() < chance:
            parts.append(f())
    page = "".join(parts)
    wrap = r.random()
    if wrap < 0.06:
        page = f"<form method=post action='/'{attr('', 'aspnetForm', 'form1')}><div>{page}</div></form>"
    elif wrap < 0.09:
        page = f"<{r.choice(['form', 'aside', 'nav'])}>{page}"
    if r.random() < 0.9:
        page = f"<!DOCTYPE html><html><head><title>{prose(2, 9)}</title><style>p{{}}</style></head><body>{page}" + ("</body></html>" if r.random() < 0.8 else "")
    return page, gold


@functools.lru_cache(maxsize=2)
def model(pages: int = 600, seed: int = 5) -> Labeller:
    """The labeller, fitted once a process on generated pages; it is the same for all data."""
    r = random.Random(seed)
    made = []
    for _ in range(pages):
        page, gold = generated(r)
        left = list(gold)
        found = blocks(page)
        y = np.zeros(len(found))
        for i, b in enumerate(found):
            if b.text in left:
                left.remove(b.text)
                y[i] = 1
        if found:
            made.append((vectors(found), y))
    return Labeller(seed=seed).train(made)


def main_texts(pages: list[str | None], labeller: Labeller) -> list[list[str]]:
    """The article blocks of each page."""
    found = [blocks(p) for p in pages]
    return [[b.text for b, p in zip(bs, ps) if p > 0.5] for bs, ps in zip(found, labeller.label(found))]


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with out: the article's blocks, joined by blank lines ('' if there are none, or html is null or empty).

    out gets underscores before it if pages has it. Repeated rows get equal texts, an
    empty table gives an empty one. A page of any length and depth is read whole, in
    memory in proportion to its size.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = shared.value
        for batch in batches:
            made: list[str] = []
            rows = batch.tolist()
            at = 0
            while at < len(rows):  # about four million characters at a time
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(rows[end] or "") <= 1 << 22):
                    size += len(rows[end] or "")
                    end += 1
                made += ["\n\n".join(t) for t in main_texts(rows[at:end], labeller)]
                at = end
            yield pd.Series(made, dtype=object)

    return spread(pages).withColumn(free_name(pages, out), text(F.col(f"`{html}`")))
