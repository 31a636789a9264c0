"""Main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  Each block is read as a vector of its hashed tag path (tags, class and id
words), its hashed words and a few shape numbers; a bidirectional LSTM in numpy labels every block from the context of
the whole page, and the blocks labelled main are the text.

Nothing is labelled in the table, so the network learns from a bounded sample of pages whose markup says what is main
(``markup_label``), and from new pages built of their texts (``rebuilt``): the article in another container, its texts as
paragraphs, subheadings, lists, tables, quotes, captions, links and headers, and around and inside it menus, headers,
sidebars, notices, adverts, forms and reader comments, under telling class names and under made-up ones.
"""

from __future__ import annotations

import html as references
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

TAG_BUCKETS, NAME_BUCKETS, WORD_BUCKETS, SHAPE, HIDDEN = 80, 64, 16, 12, 20  # the tags of the path, and that of the leaf
WIDTH = 2 * TAG_BUCKETS + NAME_BUCKETS + WORD_BUCKETS + SHAPE
SAMPLE_PAGES, REBUILT, REBUILT_BLOCKS = 240, 9, 3000  # pages; copies of each; a longer page has fewer copies, one at least
FORGOTTEN, DECAY = 0.1, 0.02  # share of the inputs left out in a training step, weight decay
SLAB = 4096  # blocks of one page whose vectors are held at once

_SPLIT = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: The elements of HTML that break a line, have no content, or hold raw text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN_TEXT = frozenset("script style template iframe noembed noframes".split())
#: Class and id words that say what a part of a page is.
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus feedback footer form gdpr header login menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related reply replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
OTHER_TAGS = frozenset("aside button dialog fieldset footer form head label legend menu nav noscript option search select textarea title".split())


@dataclass
class Block:
    path: list[tuple[str, tuple[str, ...]]]
    text: str
    linked: int
    shared: int = 0  #: how many of its elements it has in common with the block before
    label: int = 0


def page_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: references decoded, white space single, empty blocks left out."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    where: list[tuple[str, tuple[str, ...]]] = []
    linked, raw, low, links = 0, None, 0, 0

    def flush() -> None:
        nonlocal parts, linked, low
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(where, text, min(linked, len(text)), min(low, len(where))))
                low = len(stack)
            parts, linked = [], 0

    def close(at: int) -> None:
        nonlocal low, links
        links -= sum(tag == "a" for tag, _ in stack[at:])
        del stack[at:]
        low = min(low, at)

    position, size = 0, len(page)
    while position < size:
        if raw:  # everything up to the element's own end tag is text
            end = re.compile(rf"</{raw}(?=[\s/>]|\Z)", re.I).search(page, position)
            stop = end.start() if end else size
            if raw not in HIDDEN_TEXT and stop > position:
                where = list(stack)
                parts.append(references.unescape(page[position:stop]))
            raw, position = None, stop
            if position >= size:
                break
        found = _SPLIT.match(page, position)
        position = found.end()
        text = found["text"]
        if text is not None:
            if not parts:
                where = list(stack)
            text = references.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)
            continue
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        closing = (found["close"] or found["close2"]) == "/"
        if tag in BLOCK:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            while stack and stack[-1][0] not in BLOCK:  # inline elements end with their block here
                close(len(stack) - 1)
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option")):
                close(len(stack) - 1)
        attributes = found["attributes"] or found["attributes2"] or ""
        names = tuple(w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())) if attributes else ()
        stack.append((tag, names))
        links += tag == "a"
        if tag in RAW:
            raw = tag
    flush()
    return out


def markup_label(blocks: list[Block]) -> list[int] | None:
    """1 for blocks that the markup shows to be the article's, 0 for others; None if the markup says nothing of any."""
    out = []
    for block in blocks:
        main = False
        for tag, names in block.path:
            if tag in ("article", "main") or not OTHER_WORDS.intersection(names) and MAIN_WORDS.intersection(names):
                main = True
            elif tag in OTHER_TAGS or OTHER_WORDS.intersection(names) or tag == "header" and not main:
                main = False
                break
        out.append(int(main))
    return out if any(out) else None


@lru_cache(1 << 16)
def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


_TAG_PLACE = {tag: i for i, tag in enumerate([*sorted(BLOCK), "a", "span"])}


def _tag(tag: str) -> int:
    """Known elements have places of their own, others share the last ones."""
    return _TAG_PLACE[tag] if tag in _TAG_PLACE else len(_TAG_PLACE) + _bucket(tag, TAG_BUCKETS - len(_TAG_PLACE))


def block_vectors(blocks: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """The vectors (blocks, WIDTH) of a page's blocks from ``start`` to ``stop``."""
    part = blocks[start:stop]
    x = np.zeros((len(part), WIDTH), np.float32)
    name_at = 2 * TAG_BUCKETS
    word_at = name_at + NAME_BUCKETS
    for i, (row, block) in enumerate(zip(x, part, strict=True), start):
        at = []
        for tag, names in block.path:
            at.append(_tag(tag))
            at += [name_at + _bucket("." + name, NAME_BUCKETS) for name in names]
        own = next((tag for tag, _ in reversed(block.path) if tag in BLOCK), "")
        at.append(TAG_BUCKETS + _tag(own))
        row[at] = 1
        words = block.text.split()
        np.add.at(row, [word_at + _bucket(w, WORD_BUCKETS) for w in words[:1] + words[-1:]], 0.5)
        n, depth = len(words), len(block.path)
        ends = block.text.count(".") + block.text.count("!") + block.text.count("?")
        following = blocks[i + 1].shared if i + 1 < len(blocks) else 0
        row[-SHAPE:] = (math.log1p(n) / 5, block.linked / len(block.text), ends > 0, ends / (n + 1), i == 0, i / len(blocks), "©" in block.text, 1, depth / 10, block.shared / (depth + 1), following / (depth + 1), n < 8)
    return x


@dataclass
class Labeller:
    """Input, recurrent and output weights of both directions; gates in the order input, forget, output, candidate."""

    w: np.ndarray  # (2, D, 4H)
    u: np.ndarray  # (2, H, 4H)
    b: np.ndarray  # (2, 1, 4H)
    v: np.ndarray  # (2, H)
    c: np.ndarray  # (1,)

    @classmethod
    def fresh(cls, seed: int = 3) -> Labeller:
        rng, d, h = np.random.RandomState(seed), WIDTH, HIDDEN
        b = np.zeros((2, 1, 4 * h))
        b[:, :, h : 2 * h] = 1
        return cls(*(x.astype(np.float32) for x in (rng.normal(0, 0.2, (2, d, 4 * h)), rng.normal(0, 0.2, (2, h, 4 * h)), b, rng.normal(0, 0.3, (2, h)), np.zeros(1))))

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """``x`` (T, B, D) and ``mask`` (T, B) -> logits (T, B); masked steps leave the state as it is."""
        t, n, h = len(x), x.shape[1], HIDDEN
        both, masks = np.stack([x, x[::-1]], 1), np.stack([mask, mask[::-1]], 1)[..., None].astype(np.float32)
        inputs = np.matmul(both, self.w) + self.b  # (T, 2, B, 4H)
        hs, cs, gates = np.zeros((t + 1, 2, n, h), np.float32), np.zeros((t + 1, 2, n, h), np.float32), []
        for i in range(t):
            a = inputs[i] + hs[i] @ self.u
            g = 1 / (1 + np.exp(-a[..., : 3 * h]))
            new = np.tanh(a[..., 3 * h :])
            cell = g[..., h : 2 * h] * cs[i] + g[..., :h] * new
            squashed = np.tanh(cell)
            cs[i + 1] = cs[i] + masks[i] * (cell - cs[i])
            hs[i + 1] = hs[i] + masks[i] * (g[..., 2 * h :] * squashed - hs[i])
            if keep:
                gates.append((g, new, squashed))
        logits = hs[1:, 0] @ self.v[0] + (hs[1:, 1] @ self.v[1])[::-1] + self.c
        return (logits, both, masks, hs, cs, gates) if keep else logits


    def label(self, blocks: list[Block]) -> np.ndarray:
        """Logits of one page of any length, with the vectors of ``SLAB`` blocks at once: the states are carried over."""
        total = np.full(len(blocks), self.c[0], np.float32)
        for k in (0, 1):
            one = Labeller(self.w[k : k + 1], self.u[k : k + 1], self.b[k : k + 1], self.v[k : k + 1], self.c)
            state = np.zeros((2, 1, 1, HIDDEN), np.float32)
            starts = range(0, len(blocks), SLAB)
            for at in starts if k == 0 else reversed(starts):
                x = block_vectors(blocks, at, at + SLAB)
                scores, state = one._one_way(x if k == 0 else x[::-1], state)
                total[at : at + SLAB] += scores if k == 0 else scores[::-1]
        return total

    def _one_way(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, inputs, out = HIDDEN, x @ self.w[0] + self.b[0], np.empty(len(x), np.float32)
        hidden, cell = state[0, 0, 0], state[1, 0, 0]
        for i, own in enumerate(inputs):
            a = own + hidden @ self.u[0]
            g = 1 / (1 + np.exp(-a[: 3 * h]))
            cell = g[h : 2 * h] * cell + g[:h] * np.tanh(a[3 * h :])
            hidden = g[2 * h :] * np.tanh(cell)
            out[i] = hidden @ self.v[0]
        return out, np.stack([hidden, cell])[:, None, None]


def gradients(net: Labeller, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    logits, both, masks, hs, cs, gates = net.run(x, mask, keep=True)
    t, h = len(x), HIDDEN
    p = 1 / (1 + np.exp(-logits))
    n = max(1, mask.sum())
    loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
    d = (mask * (p - y) / n).astype(np.float32)
    out = np.stack([d, d[::-1]], 1)  # (T, 2, B) in reading order
    dv = np.einsum("tkb,tkbh->kh", out, hs[1:])
    dw, du, db = np.zeros_like(net.w), np.zeros_like(net.u), np.zeros_like(net.b)
    dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
    for i in range(t - 1, -1, -1):
        g, new, squashed = gates[i]
        dh = dh + out[i][..., None] * net.v[:, None, :]
        here_h, here_c = dh * masks[i], dc * masks[i]
        d_cell = here_c + here_h * g[..., 2 * h :] * (1 - squashed**2)
        d_in, d_forget, d_out, d_new = d_cell * new, d_cell * cs[i], here_h * squashed, d_cell * g[..., :h]
        da = np.concatenate([d_in, d_forget, d_out], -1) * g * (1 - g)
        da = np.concatenate([da, d_new * (1 - new**2)], -1)
        dw += both[i].transpose(0, 2, 1) @ da
        du += hs[i].transpose(0, 2, 1) @ da
        db += da.sum(1, keepdims=True)
        dh = dh - here_h + da @ net.u.transpose(0, 2, 1)
        dc = dc - here_c + d_cell * g[..., h : 2 * h]
    return loss, [dw, du, db, dv, np.array([d.sum()], np.float32)]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), pages[0].shape[1]), np.float32), np.zeros((t, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


#: How pages name the parts that are not the article, beside the words above, and the article's containers.
OTHER_PARTS = (
    ("aside", ""), ("aside", ""), ("aside", ""), ("div", "sidebar"), ("div", "cookie-notice"), ("div", "cookie consent"), ("div", "advert"), ("div", "ad"), ("div", "ads"), ("div", "promo"), ("div", "sponsored"), ("div", "notice"), ("div", "share"),
    ("div", "social"), ("div", "related"), ("section", "related-posts"), ("div", "newsletter"), ("div", "banner"), ("div", "popup"), ("div", "breadcrumbs"), ("ul", "tags"), ("div", "pagination"), ("div", "widget"), ("nav", ""), ("form", ""),
)
COMMENT_PARTS = (("div", "comments"), ("section", "comments"), ("ol", "commentlist"), ("div", "comment"), ("section", "replies"), ("div", "responses"), ("div", "disqus_thread"), ("section", "discussion"), ("aside", "comments"), ("div", "feedback"))
MAIN_PARTS = (("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("div", "story"), ("section", "article"), ("div", "article-body"), ("td", "content"), ("div", "main"))
#: marks texts of the article in rebuilt pages until they are parsed
_MAIN = "\ue000"


def _name(rng: np.random.RandomState) -> str:
    """A class name that says nothing."""
    return "".join(chr(97 + rng.randint(26)) for _ in range(rng.randint(2, 9))) + ("" if rng.rand() < 0.6 else f"-{rng.randint(100)}")


def _element(tag: str, name: str, inside: str, rng: np.random.RandomState) -> str:
    return f'<{tag} {"id" if rng.rand() < 0.2 else "class"}="{name}">{inside}</{tag}>' if name else f"<{tag}>{inside}</{tag}>"


class _Builder:
    """Pages of a sampled page's texts with other markup."""

    def __init__(self, own: list[str], other: list[str], rng: np.random.RandomState):
        self.own, self.other, self.rng = own or ["."], other or ["."], rng
        self.words = [w for t in own + other for w in t.split()[:200]] or ["."]

    def some(self, least: int, most: int) -> str:
        """Words of the page, as a text."""
        words = [self.words[self.rng.randint(len(self.words))] for _ in range(self.rng.randint(least, most + 1))]
        return references.escape(" ".join(words))

    def pick(self, of):
        return of[self.rng.randint(len(of))]

    def link(self, text: str) -> str:
        return f'<a href="/x">{text}</a>'

    def article(self) -> list[str]:
        """The article's texts in rising pieces, each text marked."""
        rng, out, mark = self.rng, [], lambda t: _MAIN + t
        rich = rng.rand() < 0.8
        texts = [references.escape(t) for t in self.own]
        if rng.rand() < 0.8:
            heading = f"<h{1 if rng.rand() < 0.8 else 2}>{mark(texts[0] if rng.rand() < 0.4 else self.some(1, 9))}</h1>"
            out.append(f"<header>{heading}{f'<p>{mark(self.some(2, 15))}</p>' if rng.rand() < 0.5 else ''}</header>" if rng.rand() < 0.4 else heading)
            texts = texts[1:]
        for text in texts:
            way = rng.randint(19) if rich else 0
            if way == 1:
                out.append(f"<h{rng.randint(2, 5)}>{mark(self.some(1, 8))}</h2><p>{mark(text)}</p>")
            elif way == 2:
                out.append(_element(self.pick(["ul", "ol"]), "", "".join(f"<li>{self.link(mark(t)) if rng.rand() < 0.3 else mark(t)}</li>" for t in (self.some(1, 15) for _ in range(rng.randint(1, 7)))), rng))
            elif way == 3:
                cell = lambda tag: f"<{tag}>{self.link(mark(self.some(1, 4))) if rng.rand() < 0.1 else mark(self.some(1, 4))}</{tag}>"
                columns = rng.randint(1, 5)
                rows = "".join("<tr>" + "".join(cell("th" if r == 0 and rng.rand() < 0.6 else "td") for _ in range(columns)) + "</tr>" for r in range(rng.randint(1, 5)))
                out.append(f"<table>{f'<caption>{mark(self.some(1, 6))}</caption>' if rng.rand() < 0.3 else ''}{f'<tbody>{rows}</tbody>' if rng.rand() < 0.5 else rows}</table>")
            elif way in (4, 13, 16):
                out.append(f"<p>{self.link(mark(text if rng.rand() < 0.5 else self.some(1, 12)))}</p>")
            elif way == 5:
                out.append(f"<blockquote>{f'<p>{mark(text)}</p>' if rng.rand() < 0.6 else mark(text)}</blockquote>")
            elif way == 6:
                out.append(f"<figure><img src=x><figcaption>{mark(self.some(2, 20))}</figcaption></figure>")
            elif way == 7:
                out.append(f"<pre>{mark(text)}</pre>")
            elif way == 8:
                out.append("<dl>" + "".join(f"<dt>{mark(self.some(1, 4))}</dt><dd>{mark(self.some(2, 20))}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>")
            elif way == 9:
                out.append(_element(self.pick(["div", "section"]), self.pick(["", _name(rng)]), f"<p>{mark(text)}</p>", rng))
            elif way == 10:
                out.append(f"<div>{mark(text)}</div>")
            elif way == 11:
                out.append(f"<p>{mark(self.some(1, 3))}</p>")
            elif way == 12:
                out.append(f"<p>{mark(self.some(3, 20))} {self.link(self.some(1, 5))} {text}</p>")
            else:
                out.append(f"<p>{mark(text)}</p>")
        return out

    def menu(self) -> str:
        items = "".join(f"<li>{self.link(self.some(1, 3))}</li>" for _ in range(self.rng.randint(2, 9)))
        return _element(*self.pick([("nav", ""), ("nav", ""), ("div", "menu"), ("div", "navbar"), ("div", "nav")]), f"<ul>{items}</ul>", self.rng)

    def comments(self, part: tuple[str, str]) -> str:
        rng, leaf = self.rng, self.pick(["div", "li", "article", "p", "div"]) if part[0] != "ol" else "li"
        named = self.pick(["comment", "reply", "", _name(rng)])
        one = lambda: (
            (self.pick([f"<b>{self.some(1, 2)}</b>", f"<h4>{self.some(1, 2)}</h4>", f'<span>{self.link(self.some(1, 2))}</span>', ""]))
            + (references.escape(self.pick(self.other)) if leaf == "p" else f"<p>{self.some(1, 40) if rng.rand() < 0.7 else references.escape(self.pick(self.own))}</p>")
            + (self.link(self.some(1, 1)) if rng.rand() < 0.3 else "")
        )
        head = f"<h{rng.randint(2, 5)}>{self.some(1, 3)}</h3>" if rng.rand() < 0.5 else ""
        return _element(*part, head + "".join(_element(leaf, named, one(), rng) for _ in range(rng.randint(1, 6))), rng)

    def aside(self) -> str:
        rng, part = self.rng, self.pick(OTHER_PARTS)
        if part[0] == "form":
            return f"<form><label>{self.some(1, 4)}</label><input name=q><select><option>{self.some(1, 2)}<option>{self.some(1, 2)}</select><button>{self.some(1, 2)}</button></form>"
        if part[0] in ("ul", "nav") or rng.rand() < 0.2:
            inside = "".join(f"<li>{self.link(self.some(1, 8))}</li>" for _ in range(rng.randint(1, 6)))
            return _element(*part, inside if part[0] == "ul" else f"<ul>{inside}</ul>", rng)
        head = f"<h3>{self.some(1, 4)}</h3>" if rng.rand() < 0.4 else ""
        body = self.pick([lambda: self.some(2, 40), lambda: "".join(f"<p>{self.some(2, 30)}</p>" for _ in range(rng.randint(1, 4))), lambda: f"<p>{self.link(self.some(1, 8))}</p>", lambda: references.escape(self.pick(self.other))])()
        return _element(*part, head + body, rng)

    def page(self) -> str:
        rng = self.rng
        main, pieces = self.pick(MAIN_PARTS), self.article()
        telling = main[0] in ("article", "main")
        if telling and rng.rand() < 0.3:
            main = (main[0], _name(rng))
        for _ in range(rng.randint(0, 3)):  # inside the article, but not of it
            pieces.insert(rng.randint(0, len(pieces) + 1), self.aside())
        if rng.rand() < 0.25:
            pieces.append(self.comments(self.pick(COMMENT_PARTS)))
        if rng.rand() < 0.15:
            pieces.append(f"<footer>{self.some(1, 12)}</footer>")
        body = _element(*main, "".join(pieces), rng)
        if main[0] == "td":
            body = f"<table><tr>{f'<td>{self.menu()}</td>' if rng.rand() < 0.5 else ''}{body}</tr></table>"
        before = [self.menu()] if rng.rand() < 0.85 else []
        if rng.rand() < 0.5:
            before.insert(0, _element(*self.pick([("header", ""), ("div", "header"), ("header", _name(rng))]), self.pick([f"<h1>{self.some(1, 4)}</h1>", f"<div>{self.link(self.some(1, 3))}</div>", f"<p>{self.some(1, 8)}</p>", self.menu()]), rng))
        before += [self.aside() for _ in range(rng.randint(0, 3))]
        after = [self.aside() for _ in range(rng.randint(0, 3))]
        if rng.rand() < 0.5:  # comments beside the article; under a made-up name only where the article's own container tells
            after.insert(0, self.comments((self.pick(["div", "section"]), _name(rng)) if telling and rng.rand() < 0.5 else self.pick(COMMENT_PARTS)))
        if rng.rand() < 0.8:
            after.append(_element(*self.pick([("footer", ""), ("footer", ""), ("div", "footer"), ("div", "copyright")]), self.pick([f"&copy; {self.some(1, 12)}", f"<p>{self.some(1, 20)}</p>", self.menu()]), rng))
        whole = "".join(before) + body + "".join(after)
        for _ in range(rng.randint(0, 3)):
            whole = _element(self.pick(["div", "div", "section"]), self.pick(["", "page", "wrapper", "container", _name(rng)]), whole, rng)
        return f"<html><head><title>{self.some(1, 8)}</title></head><body>{whole}</body></html>"


def rebuilt(blocks: list[Block], rng: np.random.RandomState) -> list[Block]:
    """The labelled blocks of a new page made of a labelled page's texts."""
    own, other = [b.text for b in blocks if b.label], [b.text for b in blocks if not b.label]
    out = page_blocks(_Builder(own, other, rng).page())
    for block in out:
        block.label = int(_MAIN in block.text)
        block.text = block.text.replace(_MAIN, "") or "."
    return out


def train(pages: list[str], *, epochs: int = 12, rate: float = 0.01, seed: int = 3) -> Labeller | None:
    """Adam over the whole block sequences of the sample's labelled pages and of pages rebuilt from them."""
    rng, sets = np.random.RandomState(seed), []
    for page in pages:
        blocks = page_blocks(page)
        labels = markup_label(blocks)
        if labels is None:
            continue
        for block, label in zip(blocks, labels, strict=True):
            block.label = label
        copies = min(REBUILT, max(1, REBUILT_BLOCKS // len(blocks)))
        for version in [blocks, *(rebuilt(blocks, rng) for _ in range(copies))]:
            sets.append((block_vectors(version), np.array([b.label for b in version], np.float32)))
    if not sets:
        return None
    net = Labeller.fresh(seed)
    values = [net.w, net.u, net.b, net.v, net.c]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    groups = list(together([len(s[0]) for s in sets]))
    for _ in range(epochs):
        for i in rng.permutation(len(groups)):
            own = [sets[k] for k in groups[i]]
            x, mask = padded([s[0] for s in own])
            x[..., WIDTH - SHAPE - WORD_BUCKETS : WIDTH - SHAPE] *= (rng.rand(*mask.shape) < 0.5)[..., None]  # no block is known by its words alone
            x *= rng.rand(*x.shape) > FORGOTTEN
            y = np.zeros_like(mask)
            for k, s in enumerate(own):
                y[: len(s[1]), k] = s[1]
            _, grads = gradients(net, x, mask, y)
            step += 1
            now = rate * (1 - step / (epochs * len(groups) + 1))
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (now * ((m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6) + DECAY * v)).astype(np.float32)
    return net


def together(lengths: list[int], pages: int = 32, blocks: int = 2 * SLAB) -> Iterator[list[int]]:
    """Pages of like length in groups of at most ``pages`` whose padded blocks stay within ``blocks``; a longer page alone."""
    order, at = sorted(range(len(lengths)), key=lengths.__getitem__), 0
    while at < len(order):
        n = 1
        while n < pages and at + n < len(order) and lengths[order[at + n]] * (n + 1) <= blocks:
            n += 1
        yield order[at : at + n]
        at += n


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    """The text of each page; pages of like length are labelled together, a very long one by slabs."""
    blocks = [page_blocks(p or "") for p in pages]
    out = [""] * len(pages)
    some = [i for i, b in enumerate(blocks) if b]
    for group in together([len(blocks[i]) for i in some]):
        part = [some[k] for k in group]
        if len(part) == 1 and len(blocks[part[0]]) > SLAB:
            chosen = net.label(blocks[part[0]])[:, None] > 0
        else:
            x, mask = padded([block_vectors(blocks[i]) for i in part])
            chosen = net.run(x, mask) > 0
        for k, i in enumerate(part):
            out[i] = "\n".join(b.text for b, main in zip(blocks[i], chosen[:, k], strict=False) if main)
    return out


def extract_column(net: Labeller | None):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            texts: list[str] = []
            for at in range(0, len(pages), 256):
                part = list(pages.iloc[at : at + 256])
                texts += main_texts(net, part) if net else [""] * len(part)
            yield pd.Series(texts, dtype=object)

    return run


@F.pandas_udf(T.BooleanType())
def labelled_column(pages: pd.Series) -> pd.Series:
    return pd.Series([markup_label(page_blocks(p or "")) is not None for p in pages], dtype=bool)


def fit(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Labeller | None:
    """A labeller from at most ``sample`` pages whose markup labels them, those with the least hashes of id and text.

    Pages that name neither an article nor any main class cannot be labelled; a hash threshold that about three times the
    sample passes is drawn among the others, and only those are parsed.  If too few of them are labelled, the threshold
    grows fourfold, up to all pages.
    """
    telling = rf"(?i)<(article|main)[\s>]|\b(class|id|role|itemprop)\s*=[^>]*\b({'|'.join(sorted(MAIN_WORDS))})\b"
    rows = pages.where(F.col(html_col).rlike(telling)).select(F.col(html_col).alias("h"), F.xxhash64(F.col(id_col), F.col(html_col)).alias("k"))
    n = rows.agg(F.approx_count_distinct("k", 0.02)).first()[0]
    share = min(1.0, 3.0 * sample / max(1, n))
    while True:
        some = rows if share >= 1 else rows.where(F.col("k") <= int(share * 2.0**64 - 2.0**63))
        found = [r["k"] for r in some.where(labelled_column(F.col("h"))).select("k").distinct().orderBy("k").limit(sample).collect()]
        if len(found) >= sample or share >= 1:
            break
        share = min(1.0, 4 * share)
    chosen = rows.where(F.col("k").isin(found)).groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect() if found else []
    return train([r["h"] for r in chosen])


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page, and one without a main block, has an empty text; where no page of the sample shows an article
    in its markup, all texts are empty; repeated rows come back each; an empty table gives an empty result; other
    columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    text = extract_column(fit(pages, id_col=id_col, html_col=html_col))(F.col(html_col))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
