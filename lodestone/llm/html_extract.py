"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with character references decoded and white
space turned into single spaces. Scripts, styles and other raw elements have no text, nor have closed drawings, media
and templates; formulas have. A numpy bidirectional LSTM reads the sequence of a page's blocks, each as vectors of its
hashed tag path (tags, class and id words, neighbours on the path) and of its hashed words, with a few shapes (length,
share of links, marks), and labels every block as main text or not with the whole page as context. Main blocks in page
order, joined by an empty line, are the text.

No labelled pages exist, so the labeller is trained on pages that this module generates: random words in many
templates (articles in article, main, div, section or table tags, with menus, headers, footers, sidebars, notices,
adverts, forms, share bars and reader comments before, inside and after them). Training is seeded and bounded, and
done once for each driver process.

Defined results: a null, empty or blank page has empty text; a page without main blocks has empty text; unclosed and
cut-off tags are tolerated; repeated rows are pages each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import textkernel as tk

PATH_DIM, WORD_DIM, SHAPES, HIDDEN = 16, 6, 8, 24
PATH_ROWS, WORD_ROWS = 2048, 1024
PAGES, EPOCHS, BATCH = 1500, 6, 12

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose content isn't markup: without an end tag they run to the end of the page.
RAW = frozenset("script style noscript iframe noframes xmp".split())
#: Elements left out with their content where they are closed; of an unclosed one only the tag is left out.
UNSEEN = frozenset("template svg object canvas audio video".split())
VOID = frozenset("hr br img input meta link base col area source track wbr param embed".split())
#: An opening tag of the key ends open elements of the named kinds that it cannot be inside of.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where such a search stops.
SCOPE = frozenset("ul ol dl table tbody thead tfoot select body html nav article section div".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|<[/a-zA-Z][^<>]*+\Z", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@lru_cache(1 << 16)
def _path_id(word: str) -> int:
    return zlib.crc32(word.encode()) % PATH_ROWS


class _Open:
    """The open elements of a page, and how often each path id stands among them: what a path costs doesn't hang on how
    deep it is, only on how many different ids it has (at most ``PATH_ROWS``)."""

    def __init__(self):
        self.tags: list[str] = []
        self.own: list[list[int]] = []
        self.ids: Counter[int] = Counter()
        self.count: Counter[str] = Counter()

    def push(self, tag: str, names) -> None:
        ids = []
        if tag not in ("html", "body"):
            ids = [_path_id(tag), *(_path_id(f".{n}") for n in names)]
            if self.tags:
                ids.append(_path_id(f"{self.tags[-1]}>{tag}"))
        self.tags.append(tag)
        self.own.append(ids)
        self.ids.update(ids)
        self.count[tag] += 1

    def cut(self, depth: int) -> None:
        """Close all elements from a depth on."""
        while len(self.tags) > depth:
            self.count[self.tags.pop()] -= 1
            for i in self.own.pop():
                self.ids[i] -= 1
                if not self.ids[i]:
                    del self.ids[i]

    def path(self) -> tuple[int, ...]:
        ids = set(self.ids)
        if self.tags:
            ids.add(_path_id(f"leaf:{self.tags[-1]}"))
        return tuple(sorted(ids)) or (0,)


def _closed(page: str, name: str) -> dict[int, int]:
    """Where the closed elements of a name start and end; nested ones count, comments and raw elements don't."""
    ends, opened = {}, []
    raw = "|".join(RAW)
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<({raw})(?=[\s/>])(?:[^>]*/>|[^>]*>.*?(?:</\1(?=[\s/>])|\Z))|<(/?){name}(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", page, re.I | re.S):
        if m[2] == "" and not m[3].endswith("/"):
            opened.append(m.start())
        elif m[2] == "/" and opened:
            ends[opened.pop()] = m.end()
    return ends


def blocks(page: str) -> list[tuple[tuple[int, ...], str, int]]:
    """Leaf blocks of a page in order: hashed path words, text, code points inside links."""
    out: list[tuple[tuple[int, ...], str, int]] = []
    stack = _Open()
    path: tuple[int, ...] | None = None
    text: list[str] = []
    linked, in_link, at, end = 0, False, 0, len(page)
    closed: dict[str, dict[int, int]] = {}

    def flush():
        nonlocal text, linked, path
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                if path is None:
                    path = stack.path()
                out.append((path, line, linked))
        text, linked = [], 0

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            said = page[at : m.start()]
            text.append(said)
            if in_link:
                linked += len(said.strip())
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, rest = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name == "a":
            in_link = not closing
        elif name == "br":
            text.append(" ")
        elif name in RAW:
            if not closing and not rest.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
        elif name in UNSEEN:
            if not closing and not rest.endswith("/"):
                if name not in closed:
                    closed[name] = _closed(page, name)
                at = max(at, closed[name].get(m.start(), at))
        elif name in BLOCK:
            flush()
            in_link = False
            path = None
            if closing:
                if stack.count[name]:
                    stack.cut(len(stack.tags) - 1 - stack.tags[::-1].index(name) if stack.tags[-1] != name else len(stack.tags) - 1)
            elif name not in VOID:
                if stack.tags and stack.tags[-1] == "p":  # no block can be inside a paragraph
                    stack.cut(len(stack.tags) - 1)
                ended = CLOSES.get(name, ())
                if any(stack.count[t] for t in ended):
                    for i in range(len(stack.tags) - 1, -1, -1):
                        if stack.tags[i] in ended:
                            stack.cut(i)
                            break
                        if stack.tags[i] in SCOPE:
                            break
                names = tuple(w for g in _NAMES.findall(rest) for w in _PART.findall("".join(g).lower())) if rest else ()
                stack.push(name, names)
    flush()
    return out


def encode(pages: list[list[tuple[tuple[str, ...], str, int]]]):
    """Vectors' indexes of all blocks of some pages, one page after another: path ids, word ids (both with offsets),
    shapes."""
    flat = [b for page in pages for b in page]
    ids = [np.array(b[0], np.int64) for b in flat]
    path_at = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
    buf, offs = tk.load(pa.array([b[1] for b in flat], pa.large_string()))
    low = tk.LOWER[buf]
    starts, ends, row = tk.spans(low, offs, tk.IS_WHITE)
    words = (tk.hash_spans(low, starts, ends) % np.uint64(WORD_ROWS)).astype(np.int64)
    count = np.bincount(row, minlength=len(flat))
    chars = np.array([len(b[1]) for b in flat], float)
    linked = np.array([b[2] for b in flat], float)
    last = [b[1][-1] for b in flat]
    place = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in pages]) if flat else np.zeros(0)
    stops = tk.per_row(tk.table(b".,;:!?")[buf], offs)
    shapes = np.column_stack(
        [np.log1p(count) / 4, np.minimum(linked / np.maximum(chars, 1), 1), np.array([c in ".!?" for c in last], float), np.minimum(chars / np.maximum(count, 1) / 10, 2), place, np.minimum(stops / np.maximum(count, 1), 1), np.array(["©" in b[1] for b in flat], float), np.ones(len(flat))]
    )
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), path_at, words, np.concatenate(([0], np.cumsum(count))), shapes


def _bag(table, ids, at):
    n = np.diff(at)
    out = np.zeros((len(n), table.shape[1]), table.dtype)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(table[ids], at[full], axis=0)
    return out


class Labeller:
    """Two LSTMs over a page's blocks, one in each direction, and a logistic output on both states."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + SHAPES
        self.p = {"path": g.normal(0, 0.2, (PATH_ROWS, PATH_DIM)), "word": g.normal(0, 0.05, (WORD_ROWS, WORD_DIM)), "out": g.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for way in "fb":
            self.p[f"x{way}"] = g.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
            self.p[f"h{way}"] = g.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p[f"b{way}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _inputs(self, coded):
        ids, path_at, words, word_at, shapes = coded
        n = np.maximum(np.diff(word_at), 1)[:, None]
        return np.concatenate((_bag(self.p["path"], ids, path_at), _bag(self.p["word"], words, word_at) / n, shapes), axis=1).astype(np.float32)

    @staticmethod
    def _order(sizes):
        """Steps of a batch in both directions: at step t the blocks, one for each page that has so many."""
        at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        pages = np.argsort(-sizes, kind="stable")
        at, sizes = at[pages], sizes[pages]
        live = [int(np.count_nonzero(sizes > t)) for t in range(int(sizes[0]) if len(sizes) else 0)]
        return [at[:k] + t for t, k in enumerate(live)], [at[:k] + sizes[:k] - 1 - t for t, k in enumerate(live)]

    def _run(self, x, steps, way, keep):
        zx = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        out = np.zeros((len(x), HIDDEN), np.float32)
        wh = self.p[f"h{way}"]
        k = len(steps[0]) if steps else 0
        h = c = np.zeros((k, HIDDEN), np.float32)
        saved = []
        for rows in steps:
            h, c = h[: len(rows)], c[: len(rows)]
            z = zx[rows] + h @ wh
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                saved.append((i, f, o, g, before, tc, h))
            h = o * tc
            out[rows] = h
        return out, saved

    def logits(self, coded, sizes, keep=False):
        x = self._inputs(coded)
        forward, backward = self._order(sizes)
        hf, sf = self._run(x, forward, "f", keep)
        hb, sb = self._run(x, backward, "b", keep)
        h = np.concatenate((hf, hb), axis=1)
        return h @ self.p["out"] + self.p["bias"][0], (x, h, (forward, sf), (backward, sb))

    def gradients(self, coded, sizes, y):
        z, (x, h, *ways) = self.logits(coded, sizes, keep=True)
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((prob - y) / max(1, len(y))).astype(np.float32)
        grad = {"out": h.T @ dz, "bias": np.array([dz.sum()])}
        dx = np.zeros_like(x)
        for n, (way, (steps, saved)) in enumerate(zip("fb", ways)):
            dh_all = dz[:, None] * self.p["out"][n * HIDDEN : (n + 1) * HIDDEN]
            dzx = np.zeros((len(x), 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{way}"])
            dh = dc = np.zeros((0, HIDDEN), np.float32)
            for rows, (i, f, o, g, before, tc, hp) in zip(reversed(steps), reversed(saved)):
                grow = len(rows) - len(dh)
                dh = np.concatenate((dh, np.zeros((grow, HIDDEN), np.float32))) + dh_all[rows]
                dc = np.concatenate((dc, np.zeros((grow, HIDDEN), np.float32))) + dh * o * (1 - tc * tc)
                d = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                dzx[rows] = d
                gh += hp.T @ d
                dh, dc = d @ self.p[f"h{way}"].T, dc * f
            grad[f"x{way}"], grad[f"h{way}"], grad[f"b{way}"] = x.T @ dzx, gh, dzx.sum(0)
            dx += dzx @ self.p[f"x{way}"].T
        ids, path_at, words, word_at, _ = coded
        grad["path"], grad["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        np.add.at(grad["path"], ids, dx[np.repeat(np.arange(len(x)), np.diff(path_at)), :PATH_DIM])
        n = np.diff(word_at)
        np.add.at(grad["word"], words, (dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(n, 1)[:, None])[np.repeat(np.arange(len(x)), n)])
        return float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))), grad

    def main(self, pages) -> list[list[bool]]:
        """For each page, which of its blocks are main text."""
        sizes = np.array([len(p) for p in pages], np.int64)
        if not sizes.sum():
            return [[] for _ in pages]
        z, _ = self.logits(encode(pages), sizes)
        at = np.concatenate(([0], np.cumsum(sizes)))
        return [(z[a:b] > 0).tolist() for a, b in zip(at, at[1:])]


# --- generated training pages ---------------------------------------------------------------------------------------

_PARTS = "an er in st th ou la de ri mo ka su ve no ti el qu ar ce ba lo mi ña é ü on re sch ung tion ment".split()
NAMES = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp",
    "side": "sidebar side aside widget related recommended rail trending more secondary teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall message warning disclaimer privacy",
    "comments": "comments comment replies reply discussion responses respond feedback thread reader",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc links tabs skip",
    "foot": "footer foot copyright legal bottom colophon credits",
    "head": "header masthead topbar top logo brand branding banner site tagline",
    "form": "form search login signup contact subscribe poll",
    "share": "share sharing social tags meta toolbar actions follow",
    "main": "content main article post entry body story text page single blog news document prose",
}
NAMES = {k: v.split() for k, v in NAMES.items()}


class _Dice:
    """Seeded draws that cost less than a numpy generator's when they are made one at a time."""

    def __init__(self, seed: int):
        self.random = random.Random(seed).random

    def integers(self, lo: int, hi: int | None = None) -> int:
        if hi is None:
            lo, hi = 0, lo
        return lo + int(self.random() * (hi - lo))


class _Page:
    """One generated page and the labels of its leaf blocks."""

    def __init__(self, g: _Dice):
        self.g, self.html, self.labels = g, [], []
        self.title = self.words(3, 12)

    def pick(self, xs):
        return xs[int(self.g.integers(len(xs)))]

    def chance(self, p):
        return self.g.random() < p

    def words(self, lo, hi, stop=True):
        out = ["".join(self.pick(_PARTS) for _ in range(int(self.g.integers(1, 5)))) for _ in range(int(self.g.integers(lo, hi + 1)))]
        for i in range(len(out)):
            if stop and self.chance(0.1):
                out[i] += self.pick([",", ".", ".", ";"])
        return (" ".join(out).capitalize()) + ("." if stop else "")

    def odd(self):
        """Prose of poor form: separators, marks, capitals, numbers, bare words."""
        cut, kind = self.words(1, 60, self.chance(0.5)).split(" "), int(self.g.integers(6))
        if kind == 0:
            return self.pick([" | ", " - ", " * ", " • "]).join(cut) + self.pick(["", " |"])
        if kind == 1:
            return " ".join(w + self.pick(["%%%", "***", "###", "$$$", "!!", "..."]) for w in cut)
        if kind == 2:
            return " ".join(cut).upper() + self.pick(["", "!!", "!!!"])
        if kind == 3:
            return " ".join(w if self.chance(0.7) else str(int(self.g.integers(1, 10**6))) for w in cut)
        if kind == 4:
            return " ".join([cut[0]] * int(self.g.integers(2, 20)))
        return " ".join(cut).rstrip(".,; ") + self.pick([" info@mail.example.com", " +1 (555) 010-0199", " (c) 2020 by the authors", " key=ab12cd34ef56", " © all rights", ""])

    def name(self, kind, p=1.0):
        if not self.chance(p):
            return ""
        n = self.pick(NAMES[kind])
        if self.chance(0.3):
            n = f"{self.pick([self.pick(NAMES[kind]), 'box', 'block', 'wrap', 'inner', 'area', 'item'])}{self.pick(['-', '_', ' '])}{n}"
        return f' {self.pick(["class", "class", "class", "id"])}="{n}"'

    def leaf(self, tag, text, label, attr="", close=True):
        self.html.append(f"<{tag}{attr}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(label)

    def open(self, tag, attr=""):
        self.html.append(f"<{tag}{attr}>")

    def shut(self, tag):
        self.html.append(f"</{tag}>")

    def links(self, label, lo=2, hi=9, tag="ul"):
        self.open(tag)
        for _ in range(int(self.g.integers(lo, hi))):
            self.leaf("li", f'<a href="/x">{self.words(1, 4, False)}</a>', label)
        self.shut(tag)

    def prose(self, label, lo, hi, tag="p"):
        for _ in range(int(self.g.integers(lo, hi))):
            self.leaf(tag, self.words(1, self.pick([6, 30, 90])), label)

    def aside(self, kind):
        """Some block that isn't main text."""
        copy = self.title if self.chance(0.15) else None
        if kind == "nav":
            tag = self.pick(["nav", "nav", "div", "ul"])
            if tag == "ul":
                self.open("div", self.name("nav"))
                self.links(0)
                self.shut("div")
            else:
                self.open(tag, self.name("nav", 0.3 if tag == "nav" else 1))
                if self.chance(0.7):
                    self.links(0)
                else:
                    self.html.append(" ".join(f'<a href="/{i}">{self.words(1, 2, False)}</a>' for i in range(int(self.g.integers(2, 8)))))
                    self.labels.append(0)
                self.shut(tag)
        elif kind in ("ad", "notice", "share"):
            tag = self.pick(["div", "div", "aside", "section", "p"])
            attr = self.name(kind)
            if tag == "p" or self.chance(0.5):
                self.leaf(tag, copy or self.words(1, self.pick([5, 25, 60])), 0, attr)
            else:
                self.open(tag, attr)
                self.prose(0, 1, 3)
                if self.chance(0.4):
                    self.leaf("button", self.words(1, 2, False), 0)
                self.shut(tag)
        elif kind == "side":
            tag = self.pick(["aside", "aside", "div", "section"])
            self.open(tag, self.name("side", 0.4 if tag == "aside" else 1))
            if self.chance(0.7):
                self.leaf(self.pick(["h2", "h3", "h4"]), self.words(1, 5, False), 0)
            self.links(0) if self.chance(0.6) else self.prose(0, 1, 4)
            self.shut(tag)
        elif kind == "form":
            attr = self.name("form", 0.5)
            self.open("form", attr)
            if self.chance(0.6):
                self.leaf(self.pick(["label", "p", "h3", "legend"]), self.words(1, 12), 0)
            self.html.append('<input type="text" name="q">')
            if self.chance(0.4):
                self.open("select")
                for _ in range(int(self.g.integers(1, 4))):
                    self.leaf("option", self.words(1, 2, False), 0, "", self.chance(0.5))
                self.shut("select")
            if self.chance(0.6):
                self.leaf("button", self.words(1, 2, False), 0)
            self.shut("form")
        elif kind == "comments":
            tag = self.pick(["div", "section", "ol", "aside"])
            self.open(tag if tag != "ol" else "div", self.name("comments"))
            if self.chance(0.7):
                self.leaf(self.pick(["h2", "h3"]), self.words(1, 4, False), 0)
            if tag == "ol":
                self.open("ol")
            for _ in range(int(self.g.integers(1, 6))):
                inner = "li" if tag == "ol" else self.pick(["div", "article", "p"])
                if inner == "p":
                    self.leaf("p", self.words(2, 60), 0)
                else:
                    self.open(inner, self.name("comments", 0.7))
                    if self.chance(0.5):
                        self.leaf("div", self.words(1, 3, False), 0)
                    self.prose(0, 1, 3)
                    self.shut(inner)
            if tag == "ol":
                self.shut("ol")
            self.shut(tag if tag != "ol" else "div")
        elif kind == "head":
            tag = self.pick(["header", "header", "div"])
            self.open(tag, self.name("head", 0.4 if tag == "header" else 1))
            self.leaf(self.pick(["h1", "h2", "div", "p"]), copy or self.words(1, 5, False), 0)
            if self.chance(0.4):
                self.leaf("p", self.words(2, 10), 0)
            if self.chance(0.3):
                self.aside("nav")
            self.shut(tag)
        else:
            tag = self.pick(["footer", "footer", "div"])
            attr = self.name("foot", 0.3 if tag == "footer" else 1)
            said = f"{self.pick(['&copy;', '©', ''])} {self.words(1, 3, False)} &middot; {copy or self.words(1, 20)}"
            if self.chance(0.5):
                self.leaf(tag, said, 0, attr)
            else:
                self.open(tag, attr)
                self.leaf("p", said, 0)
                if self.chance(0.5):
                    self.links(0, 1, 5)
                self.shut(tag)

    def article(self):
        shell = self.pick(["article", "article", "article", "main", "main>article", "div", "div", "section", "td"])
        if shell == "td":
            self.html.append("<table><tr>")
            self.open("td", self.name("main"))
        for t in shell.split(">"):
            if t != "td":
                self.open(t, self.name("main", 0.3 if t in ("article", "main") else 1))
        wrap = self.chance(0.25)
        if wrap:
            self.open("div", self.name("main"))
        if self.chance(0.85):
            hat = self.chance(0.15)
            if hat:
                self.open("header")
            self.leaf("h1", self.title, 1, "", True)
            if hat:
                self.shut("header")
        loose = self.chance(0.35)
        for _ in range(int(self.g.integers(1, 16))):
            r = self.g.random()
            if r < 0.72:
                if loose and self.chance(0.4):
                    self.leaf("p", f"<b>{self.words(1, 40)}<br>", 1, "", False)
                elif self.chance(0.12):  # main text of poor form is main text too
                    self.leaf("p", self.odd(), 1, "", True)
                else:
                    said = self.words(1, self.pick([4, 30, 60, 140]))
                    if self.chance(0.15):
                        cut = said.split(" ")
                        i = int(self.g.integers(len(cut)))
                        cut[i] = f'<a href="/y">{cut[i]}</a>'
                        said = " ".join(cut)
                    self.leaf(self.pick(["p", "p", "p", "p", "p", "div"]), said, 1, "", True)
            elif r < 0.79:
                self.leaf(self.pick(["h2", "h3", "h4"]), self.words(1, 8, False), 1)
            elif r < 0.83:
                self.open(tag := self.pick(["ul", "ol"]))
                for _ in range(int(self.g.integers(1, 6))):
                    self.leaf("li", self.words(1, 25), 1)
                self.shut(tag)
            elif r < 0.86:
                tag = self.pick(["blockquote", "pre", "blockquote"])
                self.leaf(tag, self.words(3, 50), 1)
            elif r < 0.88:
                self.html.append("<figure><img src=a.png>")
                self.leaf("figcaption", self.words(2, 15), 1)
                self.shut("figure")
            elif r < 0.90:
                self.html.append("<table>")
                for _ in range(int(self.g.integers(1, 4))):
                    self.html.append("<tr>")
                    for _ in range(2):
                        self.leaf("td", self.words(1, 5), 1)
                    self.html.append("</tr>")
                self.html.append("</table>")
            else:
                self.aside(self.pick(["ad", "ad", "side", "share", "form", "notice", "nav"]))
        if wrap:
            self.shut("div")
        if self.chance(0.15):
            self.aside(self.pick(["comments", "share", "foot", "nav"]))
        for t in reversed(shell.split(">")):
            self.shut(t)
        if shell == "td":
            if self.chance(0.5):
                self.open("td", self.name("side"))
                self.links(0)
                self.shut("td")
            self.html.append("</tr></table>")

    def build(self):
        self.open("html")
        self.open("head")
        self.leaf("title", self.title, 0)
        self.html.append("<style>p{}</style><script>var t='<p>';</script></head>")
        self.open("body")
        outer = self.chance(0.3)
        if outer:
            self.open("div", f' {self.pick(["id", "class"])}="{self.pick(["page", "wrapper", "container", "site", "root", "layout"])}"')
        for kind in ["nav", "head", "ad", "notice", "form", "side"]:
            if self.chance({"nav": 0.7, "head": 0.4, "ad": 0.4}.get(kind, 0.2)):
                self.aside(kind)
        self.article()
        for kind in ["ad", "side", "share", "comments", "form", "notice", "nav", "foot"]:
            if self.chance({"foot": 0.8, "comments": 0.35, "side": 0.3}.get(kind, 0.15)):
                self.aside(kind)
        if outer:
            self.shut("div")
        if self.chance(0.9):
            self.html.append("</body></html>")
        return "".join(self.html), self.labels


def generated(n: int, seed: int = 3) -> list[tuple[list, np.ndarray]]:
    """Blocks and labels of generated pages."""
    g, out = _Dice(seed), []
    while len(out) < n:
        page, labels = _Page(g).build()
        got = blocks(page)
        if len(got) == len(labels):
            out.append((got, np.array(labels, np.float32)))
    return out


@cache
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """A labeller fitted with Adam to generated pages."""
    data, model, g = generated(pages), Labeller(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, total = 0, epochs * (len(data) // BATCH)
    for _ in range(epochs):
        order = g.permutation(len(data))
        for i in range(0, len(order) - BATCH + 1, BATCH):
            part = [data[j] for j in order[i : i + BATCH]]
            coded = encode([p for p, _ in part])
            _, grad = model.gradients(coded, np.array([len(p) for p, _ in part]), np.concatenate([y for _, y in part]))
            step += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            rate = 0.01 * (1 - 0.9 * step / total)
            for k, v in grad.items():
                v = v * min(1.0, 1 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def extract(pages: DataFrame, model: Labeller | None = None, *, id_col="page_id", html_col="html", carry=()) -> DataFrame:
    """For every page: id, carried columns, ``text`` (its main blocks) and ``blocks`` (text and label of each block)."""
    model = model or trained()
    rows = pages.select(id_col, *carry, F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "_html", 1 << 20):
                cut = [blocks(h or "") for h in part.column(part.num_columns - 1).to_pylist()]
                is_main = model.main(cut)
                text = ["\n\n".join(b[1] for b, m in zip(bs, ms) if m) for bs, ms in zip(cut, is_main)]
                labels = [[{"text": b[1], "main": bool(m)} for b, m in zip(bs, ms)] for bs, ms in zip(cut, is_main)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string()), pa.array(labels, pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_())])))], names=[*part.schema.names[:-1], "text", "blocks"])

    from pyspark.sql import types as T

    block = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("main", T.BooleanType())]))
    return map_arrow(rows, run, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("blocks", block)]))
