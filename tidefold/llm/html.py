"""Main text of web pages: a bidirectional LSTM labels every text block of a page."""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidefold.llm.common import fresh, hash_unit, table

#: Bounds of the training sample, and of one training sequence.
TRAIN_PAGES = 300
TRAIN_CHARS = 20_000
#: Pages to train on where all are longer than that.
LONG_PAGES = 20
TRAIN_BLOCKS = 80
VARIANTS = 7
EPOCHS = 6
HIDDEN = 24
PATH_BINS = 192
WORD_BINS = 32
NUMBERS = 23
WIDTH = PATH_BINS + WORD_BINS + NUMBERS
#: Blocks (with padding) that go through the network at once.
BATCH_BLOCKS = 20_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|title|svg|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attr2>[^>]*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
#: An open element that a new one of these kinds ends, if no element of the second set stands between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = _BLOCK - {"button", "label", "option", "optgroup", "select", "textarea", "legend", "caption"}


class _Bins(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, key: str) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[key] = zlib.crc32(key.encode("utf-8", "replace")) % self.n
        return b


#: 1 for the bytes of punctuation, 2 for digits.
_BYTE_KINDS = np.zeros(256, np.uint8)
_BYTE_KINDS[list(b".,;:!?")], _BYTE_KINDS[list(b"0123456789")] = 1, 2
_path_bins, _word_bins = _Bins(PATH_BINS), _Bins(WORD_BINS)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int
    inside: tuple[int, ...] = ()  # numbers of the block-level elements around it, outermost first


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order: text between block-level tags, references decoded, white space as one blank.

    Comments, scripts, styles and the title are no text.  Unclosed elements are
    ended as a browser would, so that broken markup still has a sensible path.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    parts: list[str] = []
    links = opened = 0
    path: tuple[str, ...] = ()
    inside: tuple[int, ...] = ()

    def flush() -> None:
        nonlocal links, path, inside
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path, links, inside))
            parts.clear()
        links = 0
        path = inside = ()

    def place() -> None:
        nonlocal path, inside
        path = tuple(x for t, names, _ in stack for x in (t, *names))
        inside = tuple(n for t, _, n in stack if t in _BLOCK and t not in ("html", "body"))

    def close_to(k: int) -> None:
        if any(t in _BLOCK for t, _, _ in stack[k:]):
            flush()
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if not parts or not path:
                place()
            parts.append(piece)
            if any(t == "a" for t, _, _ in stack):
                links += len(piece)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
            else:
                if tag in _BLOCK:
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close_to(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if tag in _CLOSES:
                ends, walls = _CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        close_to(k)
                        break
                    if stack[k][0] in walls:
                        break
        if tag not in _VOID:
            attrs = m["attr"] or m["attr2"] or ""
            names = ()
            if "=" in attrs:
                names = tuple("." + p for a, b, c in _NAMES.findall(attrs) for p in _NAME_PARTS.findall((a or b or c).lower()))
            opened += 1
            stack.append((tag, names, opened))
    if at < len(page):
        if not path:
            place()
        parts.append(page[at:])
    flush()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """Tag-path bins, hashed-word bins and a few numbers for each block of a page.

    The numbers tell about the block and about the three innermost elements around
    it (share of the page's text, links, blocks), so a layout without telling names
    still shows where the text is.
    """
    n = len(page)
    x = np.zeros((n, WIDTH), np.float32)
    rows, bins, wrows, wbins = [], [], [], []
    for i, b in enumerate(page):
        steps = [*b.path, "^" + ">".join(p for p in b.path[-4:] if p[0] != ".")]
        rows += [i] * len(steps)
        bins += map(_path_bins.__getitem__, steps)
        words = b.text.lower().split()
        wrows.append(len(words))
        wbins += map(_word_bins.__getitem__, words)
    words = np.array(wrows)
    x[:, :PATH_BINS] = np.minimum(np.bincount(np.array(rows) * PATH_BINS + np.array(bins), minlength=n * PATH_BINS).reshape(n, PATH_BINS), 2)
    counts = np.bincount(np.repeat(np.arange(n), wrows) * WORD_BINS + np.array(wbins), minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    x[:, PATH_BINS : PATH_BINS + WORD_BINS] = counts / np.maximum(1, words)[:, None] * 2

    coded = [b.text.encode("utf-8", "replace") for b in page]
    starts = np.cumsum([0, *map(len, coded[:-1])])
    kinds = _BYTE_KINDS[np.frombuffer(b"".join(coded), np.uint8)]
    chars = np.array([len(b.text) for b in page])
    linked = np.array([min(b.link_chars, len(b.text)) for b in page])
    around = np.array([(0, 0, 0, *b.inside)[-3:] for b in page])  # 0 is the page itself
    numbers = [np.log1p(chars) / 6, np.log1p(words) / 5, linked / chars]
    marks, digits = (np.add.reduceat(kinds == k, starts, dtype=np.int64) / chars for k in (1, 2))
    numbers += [marks * 10, [b.text[-1] in ".!?" for b in page], digits * 4]
    numbers += [np.arange(n) / n, np.arange(n)[::-1] / n, words >= 12]
    elements, at = np.unique(np.concatenate([around, np.zeros((n, 1), np.int64)], axis=1), return_inverse=True)
    at = at.reshape(n, 4)
    sums = np.zeros((3, len(elements)))
    for k in range(4):
        new = at[:, k] > 0 if k < 3 else at[:, k] == 0  # the page, element 0, counts each block once
        for j, v in enumerate((chars, linked, np.ones(n))):
            sums[j] += np.bincount(at[new, k], v[new], len(elements))
    for k in range(3):
        inner, inner_links, inner_blocks = sums[:, at[:, k]]
        numbers += [inner / chars.sum(), inner_links / np.maximum(1, inner), np.log1p(inner_blocks) / 3]
    for k in (0, 1):
        same = around[1:, k] == around[:-1, k]
        numbers += [np.concatenate([[False], same]), np.concatenate([same, [False]])]
    numbers.append(np.array([len(b.inside) for b in page]) / 8)
    x[:, -NUMBERS:] = np.stack(numbers, axis=1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters: for each direction input, recurrent and bias weights; an output layer."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 0) -> Network:
        rnd = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["w" + d] = (rnd.standard_normal((WIDTH, 4 * HIDDEN)) / np.sqrt(WIDTH)).astype(np.float32)
            p["u" + d] = (rnd.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            p["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            p["c" + d][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        p["v"] = (rnd.standard_normal((2 * HIDDEN + WIDTH, 1)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        p["b"] = np.zeros(1, np.float32)
        return Network(p)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H); padding leaves the state as it is."""
        steps, size, _ = x.shape
        gates = x.reshape(-1, WIDTH) @ self.p["w" + d]
        gates = gates.reshape(steps, size, -1) + self.p["c" + d]
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        out = np.empty((steps, size, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.p["u" + d]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c1 = f * c + i * g
            tc = np.tanh(c1)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c1 + (1 - m) * c
            out[t] = h
        return out

    def score(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            take = [order.pop() for _ in range(min(len(order), max(1, BATCH_BLOCKS // longest)))]
            x, mask = _padded([pages[k] for k in take])
            h = np.concatenate([self._pass(x, mask, "f", None), self._pass(x, mask, "b", None), x], axis=2)
            y = _sigmoid((h.reshape(-1, h.shape[2]) @ self.p["v"] + self.p["b"]).reshape(h.shape[:2]))
            for j, k in enumerate(take):
                out[k] = y[: len(pages[k]), j]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._pass(x, mask, "f", kept["f"]), self._pass(x, mask, "b", kept["b"]), x], axis=2)
        flat = h.reshape(-1, h.shape[2])
        p = _sigmoid((flat @ self.p["v"] + self.p["b"]).reshape(mask.shape))
        n = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        dz = (mask * (p - y) / n).reshape(-1, 1).astype(np.float32)
        g = {"v": flat.T @ dz, "b": dz.sum(axis=0)}
        dh_all = (dz @ self.p["v"].T).reshape(h.shape)
        for k, d in enumerate("fb"):
            dgates = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            gu = np.zeros_like(self.p["u" + d])
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, gg, tc, m in reversed(kept[d]):
                dh = dh + dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dho, dc1 = m * dh, m * dc
                dc1 = dc1 + dho * o * (1 - tc**2)
                dz_t = np.concatenate([dc1 * gg * i * (1 - i), dc1 * c0 * f * (1 - f), dho * tc * o * (1 - o), dc1 * i * (1 - gg**2)], axis=1)
                dgates[t] = dz_t
                gu += h0.T @ dz_t
                dh = (1 - m) * dh + dz_t @ self.p["u" + d].T
                dc = (1 - m) * dc + dc1 * f
            g["u" + d] = gu
            g["w" + d] = x.reshape(-1, WIDTH).T @ dgates.reshape(-1, 4 * HIDDEN)
            g["c" + d] = dgates.sum(axis=(0, 1))
        return loss, g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, v in enumerate(pages):
        x[: len(v), j], mask[: len(v), j] = v, 1
    return x, mask


def fit_network(examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on the mean log loss of the blocks; sequences of similar length share a batch."""
    net, rnd = Network.fresh(seed), random.Random(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(range(len(examples)), key=lambda k: (len(examples[k][0]), rnd.random()))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rnd.shuffle(groups)
        for g in groups:
            x, mask = _padded([examples[k][0] for k in g])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(g):
                y[: len(examples[k][1]), j] = examples[k][1]
            _, grad = net.gradients(x, mask, y)
            norm = np.sqrt(sum(float((a**2).sum()) for a in grad.values()))
            step += 1
            lr = rate * (0.5 if epoch >= epochs // 2 else 1.0) * (0.4 if epoch == epochs - 1 else 1.0)
            for k, a in grad.items():
                a = a * min(1.0, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v2[k] = 0.999 * v2[k] + 0.001 * a**2
                net.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return net


_MAIN = {"article", "main"}
_OTHER = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "label", "menu", "dialog"}
_OTHER_NAMES = frozenset(
    "." + w
    for w in "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer form header login "
    "menu modal nav navbar navigation newsletter notice pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)


def weak_labels(page: list[Block]) -> list[int] | None:
    """1 for blocks inside article or main elements that no boilerplate element encloses; None for a page without such an element."""
    if not any(_MAIN & set(b.path) for b in page):
        return None
    return [int(bool(_MAIN & set(b.path)) and not (_OTHER & set(b.path)) and not (_OTHER_NAMES & set(b.path))) for b in page]


#: Containers that synthetic pages draw from.
_BODIES = (
    ["<article>", "<main>", "<main><article>", '<div class="content">', '<div class="post-body">', '<div class="entry-content">', '<div id="main">', '<section class="article">']
    + ['<div class="story">', '<div id="content">', '<article class="post">', '<div class="text">', '<main id="main" class="page">', '<td class="content">', '<div class="main">', '<div>', '<section>']
)
_BEFORE = ["<header>", '<div class="header">', '<div id="header">', '<div class="notice">', '<div class="cookie-banner">', '<div class="alert notice" role="alert">', '<div class="ad">', '<div class="banner">', '<div class="breadcrumbs">', '<div class="promo">', "<aside>", '<section class="notice">', '<div class="topbar">']
_AFTER = ["<footer>", '<div class="footer">', '<div id="footer">', "<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div class="related">', '<section class="comments">', '<div class="comments">', '<div id="comments">', '<div class="newsletter">', '<div class="ad">', '<div class="share">', '<div class="sponsored">', '<ol class="commentlist">', '<div class="widget">']
_INSIDE = ["<aside>", '<div class="ad">', '<div class="advert">', '<div class="share">', '<div class="notice">', '<div class="related">', '<div class="promo">', '<section class="comments">', '<div class="comments">', '<nav class="toc">']
#: How a page names its containers: as above, not at all, by words that say nothing, or in cells of a table.
STYLES = ("named", "named", "plain", "foreign", "cells")


def _closing(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opened)))


def synthetic_page(texts: list[str], rnd: random.Random, style: str | None = None) -> tuple[str, list[int]]:
    """A page in a random layout with texts from ``texts``, and the labels of its blocks.

    Pages of style ``named`` draw their containers from the lists above.  In the
    others nothing but place, length, links and repetition tells boilerplate apart,
    so it is short there, or a thread of replies, and the article has several blocks.
    """
    style = style or rnd.choice(STYLES)
    named = style == "named"
    labels: list[int] = []
    parts = ["<html><head><title>t</title></head><body>"]
    made_up = ["".join(rnd.choice("bcdfghklmnprstvwz") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))) for _ in range(12)]

    def pick() -> str:
        return entities.escape(rnd.choice(texts), quote=False)

    def cut(lo: int, hi: int) -> str:
        return " ".join(pick().split()[: rnd.randint(lo, hi)]) or "more"

    def short() -> str:
        return cut(1, 4)

    def aside() -> str:
        return pick() if named else cut(2, 18)

    def dress(tag: str, cell: bool = False) -> str:
        if named or tag.startswith(("<form", "<ul", "<ol", "<p", "<li")) and style == "plain" and "class" not in tag:
            return tag
        if style == "cells" and cell:
            return "<td>"
        kind = rnd.choice(["div", "div", "div", "section"]) if style == "plain" or rnd.random() < 0.8 else rnd.choice(["article", "main", "aside", "footer", "header"])
        kind = re.match(r"<([a-z]+)", tag)[1] if tag.startswith(("<ol", "<li", "<form", "<p")) else kind if kind in ("div", "section") or kind in tag else "div"
        return f"<{kind}>" if style != "foreign" else f'<{kind} {rnd.choice(["class", "id"])}="{rnd.choice(made_up)}">'

    def put(html: str, *new: int) -> None:
        parts.append(html)
        labels.extend(new)

    def links(tag: str, cell: bool = False) -> None:
        tag = dress(tag, cell)
        if named or rnd.random() < 0.5:
            n = rnd.randint(2, 8)
            put(tag + "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(n)) + "</ul>" + _closing(tag), *[0] * n)
        elif rnd.random() < 0.5:
            n = rnd.randint(2, 6)
            put(tag + "".join(f'<div><a href="/x">{short()}</a></div>' for _ in range(n)) + _closing(tag), *[0] * n)
        else:
            put(tag + rnd.choice([" | ", " ", " &middot; "]).join(f'<a href="/x">{short()}</a>' for _ in range(rnd.randint(2, 8))) + _closing(tag), 0)

    def form() -> None:
        put(rnd.choice(["<form>", '<form class="search">', '<form action="/s">']))
        put(f"<label>{short()}</label><input type='text'><button>{short()}</button>", 0, 0)
        if rnd.random() < 0.4:
            put(f"<p>{pick()}</p>", 0)
        put("</form>")

    def replies(tag: str, cell: bool) -> None:
        inner = "li" if tag.startswith("<ol") else "div"
        tag = dress(tag, cell)
        inner = "div" if inner == "li" and "<ol" not in tag else inner
        put(tag)
        if not named or rnd.random() < 0.6:
            put(f"<h3>{short()}</h3>", 0)
        author = "<p class=\"author\">" if named else rnd.choice(["<p>", "<div>", "<h4>", "<p><b>"])
        for _ in range(rnd.randint(1, 5) if named else rnd.randint(2, 6)):
            one = f'<{inner} class="{rnd.choice(["comment", "reply", "comment-body"])}">'
            one = one if named else f"<{inner}>" if style != "foreign" else f'<{inner} class="{made_up[0]}">'
            put(one)
            if not named or rnd.random() < 0.5:
                put(f"{author}{short()}{_closing(author)}", 0)
            put(f"<p>{pick()}</p></{inner}>", 0)
        if rnd.random() < 0.4:
            form()
        put(_closing(tag))

    def extra(tag: str, cell: bool = False) -> None:
        if "comment" in tag:
            replies(tag, cell)
        elif rnd.random() < 0.3:
            links(tag, cell)
        else:
            tag = dress(tag, cell)
            if rnd.random() < 0.5:
                put(f"{tag}{aside()}{_closing(tag)}", 0)
                return
            put(tag)
            if rnd.random() < 0.3:
                put(f"<h3>{short()}</h3>", 0)
            for _ in range(rnd.randint(1, 3)):
                put(f"<p>{aside()}</p>", 0)
            put(_closing(tag))

    def paragraph() -> None:
        kind = rnd.random()
        if kind < 0.08:
            put(f"<h2>{short()}</h2>", 1)
        elif kind < 0.14:
            put(f"<blockquote>{pick()}</blockquote>", 1)
        elif kind < 0.2:
            n = rnd.randint(1, 4)
            put("<ul>" + "".join(f"<li>{pick() if rnd.random() < 0.5 else short()}</li>" for _ in range(n)) + "</ul>", *[1] * n)
        elif kind < 0.26:
            put(f"<pre>{rnd.choice(['', '<code>'])}{cut(3, 30)}\n  {short()} = {rnd.randint(0, 99)};</pre>", 1)
        elif kind < 0.3:
            rows, cols = rnd.randint(2, 4), rnd.randint(2, 3)
            put("<table>" + "".join("<tr>" + "".join(f"<td>{short() if rnd.random() < 0.6 else rnd.randint(1, 999)}</td>" for _ in range(cols)) + "</tr>" for _ in range(rows)) + "</table>", *[1] * rows * cols)
        elif kind < 0.33:
            put(f"<dl><dt>{short()}</dt><dd>{pick()}</dd><dt>{short()}</dt><dd>{cut(3, 15)}</dd></dl>", 1, 1, 1, 1)
        elif kind < 0.36:
            put(f"<figure><img src='/i.png'><figcaption>{cut(3, 15)}</figcaption></figure>", 1)
        elif kind < 0.46:
            put(f"<p><b>{pick()}<br>", 1)
        elif kind < 0.54:
            put(f'<p>{pick()} <a href="/y">{short()}</a> {cut(2, 20)}</p>', 1)
        elif kind < 0.6 and not named:
            put(f"<p>{cut(2, 12)}</p>", 1)
        else:
            put(f"{inner}{pick()}{_closing(inner)}", 1)

    wrap = "" if named and rnd.random() < 0.6 else rnd.choice(["", "<div>", "<div><div>"])
    put("<table><tr>" if style == "cells" else wrap)
    for _ in range(rnd.randint(0, 3)):
        kind = rnd.random()
        if kind < 0.5:
            links(rnd.choice(["<nav>", '<div class="menu">', '<div id="nav">', '<nav class="main-nav">', "<header><nav>"]), True)
        elif kind < 0.6 and style != "cells":
            form()
        else:
            extra(rnd.choice(_BEFORE), True)
    if style == "cells" and rnd.random() < 0.5:
        put("</tr><tr>")
    title = f"<h1>{' '.join(pick().split()[:9]) or 'title'}</h1>"
    if not named and style != "cells" and rnd.random() < 0.15:
        put(title, 1)
        title = ""
    body = rnd.choice(_BODIES)
    body = body if rnd.random() < 0.3 and not named and style != "cells" and body.startswith(("<article>", "<main>")) else dress(body, True)
    inner = "<p>" if named or rnd.random() < 0.75 else "<div>"
    put(body)
    if title and rnd.random() < 0.8:
        put(title, 1)
    for k in range(rnd.choice([1, 2, 3, 5, 9]) if named else rnd.randint(3, 10)):
        if k == 0:
            put(f"{inner}{pick()}{_closing(inner)}", 1)
        else:
            paragraph()
        if rnd.random() < (0.2 if named else 0.05):
            extra(rnd.choice(_INSIDE))
    put(_closing(body))
    if style == "cells" and rnd.random() < 0.5:
        put("</tr><tr>")
    for _ in range(rnd.randint(0, 4)):
        if rnd.random() < 0.12 and style != "cells":
            form()
        else:
            extra(rnd.choice(_AFTER), True)
    put(("</tr></table>" if style == "cells" else _closing(wrap)) + "</body></html>")
    return "".join(parts), labels


def examples_of(pages: list[str], seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences: weakly labelled pages, and synthetic layouts of their texts."""
    rnd, out, texts = random.Random(seed), [], []
    for page in pages:
        found = blocks(page)
        texts += [b.text[:600] for b in found if len(b.text.split()) >= 4]
        labels = weak_labels(found)
        if labels:
            lo = rnd.randrange(max(1, len(found) - TRAIN_BLOCKS + 1))
            out.append((vectors(found[:])[lo : lo + TRAIN_BLOCKS], np.array(labels[lo : lo + TRAIN_BLOCKS], np.float32)))
    if texts:
        for _ in range(VARIANTS * len(pages)):
            page, labels = synthetic_page(texts, rnd)
            found = blocks(page)
            if len(found) == len(labels):
                out.append((vectors(found)[:TRAIN_BLOCKS], np.array(labels[:TRAIN_BLOCKS], np.float32)))
    return out


def train_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Network:
    """Fit on at most ``TRAIN_PAGES`` pages of up to ``TRAIN_CHARS`` characters, the first in a hash order of their ids.

    Without such pages the ``LONG_PAGES`` shortest are taken.  Null ids and empty
    pages are left out, of several pages of one id the last in order is taken; a table without others gives an untrained network, which has nothing to label.
    """
    given = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("h")).where(F.col("_id").isNotNull() & (F.length("h") > 0))
    usable = given.where(F.length("h") <= TRAIN_CHARS)
    ids = usable.select("_id").distinct().orderBy(hash_unit(F.col("_id"), "html"), "_id").limit(TRAIN_PAGES)
    rows = usable.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.max("h").alias("h")).collect()  # one page an id
    if not rows:
        rows = given.orderBy(F.length("h"), "_id", "h").limit(LONG_PAGES).collect()
    once = {r["_id"]: r["h"] for r in sorted(rows, key=lambda r: (r["_id"], r["h"]))}
    return fit_network(examples_of(list(once.values())))


def extract(network: Network, pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    scores = network.score([vectors(b) if b else np.zeros((0, WIDTH), np.float32) for b in found])
    return ["\n".join(b.text for b, s in zip(bs, ss) if s >= 0.5) for bs, ss in zip(found, scores)]


def main_text(pages: DataFrame, network: Network, html_col: str = "html", out_cols: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``pages`` without the html, and with the main text and its code points as ``out_cols`` (underscores are added to taken names).

    One row per input row.  Null or empty html, and pages without main text, give
    an empty text; all other columns, null ids and repeated rows pass through.
    """
    names = [c for c in pages.columns if c != html_col]
    rest = pages.select(*names)
    outs = [fresh(rest, c) for c in out_cols]
    schema = StructType([*rest.schema.fields, StructField(outs[0], StringType()), StructField(outs[1], LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = extract(network, part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    [*names, *outs],
                )

    return pages.select(*names, html_col).mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; nulls, repeated rows and empty tables: as ``main_text``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, train_labeller(pages))
