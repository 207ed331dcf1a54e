"""Main text of web pages: boosted trees over DOM-node features with hierarchical decoding.

A page is read into a tree of block elements; runs of inline text are its leaves. Two boosted-tree models look at each
node: is it pure (all of its text is main text, or none of it) or mixed, and, if pure, which of the two. Decoding picks
for every node in, out or mixed so that the summed log-probabilities are largest and no choice contradicts another:
below "in" everything is in, below "out" everything is out, only below "mixed" are children free.

The models are trained when first used, from pages that ``sample_pages`` makes up from many layouts with a fixed seed;
no table is read for that.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table

TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.25
SAMPLE_PAGES = 800

BLOCKS = frozenset("html body div section article main aside nav header footer form fieldset table thead tbody tfoot tr td th caption ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog center hgroup menu search legend".split())
DROPPED = frozenset("script style template noscript textarea select button title svg iframe object canvas head".split())
RAW = frozenset("script style textarea title iframe".split())
CLOSES = {"li": ("li", frozenset({"ul", "ol", "menu"})), "dt": ("dt dd", frozenset({"dl"})), "dd": ("dt dd", frozenset({"dl"})), "td": ("td th", frozenset({"table", "tr"})), "th": ("td th", frozenset({"table", "tr"})), "tr": ("tr", frozenset({"table"}))}
P_SCOPE = frozenset("td th table caption button html body".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words of class, id, role and label attributes, by what they tend to mark.
TOKENS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination tabs skip sitemap navi topbar",
    "head": "header masthead banner logo branding head hero",
    "foot": "footer copyright legal colophon foot bottom",
    "side": "sidebar aside widget rail related recommended trending popular more also recent archive tags complementary",
    "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner affiliate dfp",
    "note": "cookie cookies consent notice gdpr alert popup modal overlay toast subscribe newsletter paywall signup disclaimer dialog",
    "talk": "comment comments discussion reply replies disqus respond feedback thread reviews",
    "share": "share sharing social follow twitter facebook like buttons toolbar tools print",
    "form": "form search login signin register input contact",
    "text": "article content post entry story main body text page blog prose markdown single news read paragraph",
}
GROUPS = list(TOKENS)
_GROUP: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        _GROUP.setdefault(_w, []).append(_i)
TAGS = ["#t", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "ul", "li", "p", "h", "table", "quote", "figure", "other"]
_TAG = {t: i for i, t in enumerate(TAGS)} | {"body": 17, "html": 17, "ol": 10, "dl": 10, "dt": 11, "dd": 11, "tr": 14, "td": 14, "th": 14, "tbody": 14, "thead": 14, "pre": 15, "blockquote": 15, "figcaption": 16, "fieldset": 9, "search": 9, "menu": 6} | {f"h{i}": 13 for i in range(1, 7)}
ABOVE = ["nav", "header", "footer", "aside", "form", "article", "main"]


class Page:
    """parent, tag, groups (attribute words by kind), hidden, text (of leaves), link (characters in links), fields per node, in page order."""

    __slots__ = ("fields", "groups", "hidden", "link", "parent", "tag", "text")

    def __init__(self):
        self.parent, self.tag, self.groups, self.hidden, self.text, self.link, self.fields = [-1], ["html"], [()], [False], [""], [0], [0]

    def add(self, parent: int, tag: str, groups=(), hidden=False, text="", link=0) -> int:
        for own, v in zip((self.parent, self.tag, self.groups, self.hidden, self.text, self.link, self.fields), (parent, tag, groups, hidden, text, link, 0), strict=True):
            own.append(v)
        return len(self.parent) - 1


def parse(source: str) -> Page:
    """Lenient: unclosed and stray tags, cut-off markup and unquoted attributes are accepted; entities are decoded."""
    page = Page()
    stack = [("html", 0)]
    run: list[str] = []
    linked = [0, False]  # characters in links of this run; inside a link

    def say(t: str) -> None:
        if t:
            t = html.unescape(t)
            run.append(t)
            if linked[1]:
                linked[0] += len(t.strip())

    def flush() -> None:
        if run:
            t = " ".join("".join(run).split())
            if t:
                page.add(stack[-1][1], "#t", text=t, link=min(len(t), linked[0]))
            run.clear()
        linked[0], linked[1] = 0, False

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in DROPPED:
            if closing or attrs.endswith("/"):
                continue
            if name in ("button", "select", "textarea"):
                page.fields[stack[-1][1]] += 1
            depth, close = 1, re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I)
            while depth and (k := close.search(source, at)):
                depth += -1 if k[1] else 0 if name in RAW or name == "head" else 1
                at = k.end()
            if depth:
                if name == "head":  # never closed: its own elements are dropped one by one
                    continue
                at = end
            continue
        if name == "br" or name in ("hr", "img"):
            run.append(" ")
            if name == "hr":
                flush()
        elif name == "a":
            linked[1] = not closing
        elif name == "input":
            page.fields[stack[-1][1]] += 1
        elif name in BLOCKS:
            flush()
            names = [s[0] for s in stack]
            if closing:
                if name in names[1:]:
                    del stack[len(names) - 1 - names[::-1].index(name) :]
                continue
            if name in ("html", "body"):
                name = "body" if name == "body" else "html"
                if name == "html" or "body" in names:
                    continue
            if name in CLOSES:
                own, stop = CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if names[i] in own.split():
                        del stack[i:]
                        break
                    if names[i] in stop:
                        break
            elif "p" in names:
                for i in range(len(stack) - 1, 0, -1):
                    if names[i] == "p":
                        del stack[i:]
                        break
                    if names[i] in P_SCOPE:
                        break
            groups, hidden = set(), False
            if attrs.strip(" /"):
                for k in _ATTR.finditer(attrs):
                    key, value = k[1].lower(), (k[2] or "").strip("\"'")
                    if key in ("class", "id", "role", "aria-label", "itemprop"):
                        for w in _SPLIT.findall(_CAMEL.sub(" ", value).lower()):
                            groups.update(_GROUP.get(w, ()))
                    elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                        hidden = True
            stack.append((name, page.add(stack[-1][1], name, tuple(groups), hidden)))
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.parent)
    parent = page.parent
    chars, words, link, stops, fields, nodes, leaves = (np.zeros(n) for _ in range(7))
    depth, kids = np.zeros(n), np.zeros(n)
    for i, t in enumerate(page.text):
        nodes[i] = 1
        fields[i] = page.fields[i]
        if t:
            chars[i], words[i], link[i], leaves[i] = len(t), t.count(" ") + 1, page.link[i], 1
            stops[i] = t.count(".") + t.count(",") + t.count("?") + t.count("。")
    order, seen = np.zeros(n), np.zeros(n, np.int64)
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        order[i] = kids[p]
        kids[p] += 1
    own = chars.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, words, link, stops, fields, nodes, leaves):
            a[p] += a[i]
    total = max(1.0, chars[0])
    before = np.concatenate([[0.0], np.cumsum(own)[:-1]]) / total
    g = np.zeros((n, len(GROUPS)), np.float32)
    up = np.zeros((n, len(GROUPS)), np.float32)
    inside = np.zeros((n, len(ABOVE)), np.float32)
    hid = np.zeros(n)
    one = np.zeros((n, len(TAGS)), np.float32)
    for i in range(n):
        for k in page.groups[i]:
            g[i, k] = 1
        one[i, _TAG.get(page.tag[i], 17)] = 1
        if i:
            p = parent[i]
            up[i] = np.maximum(up[p], g[p])
            inside[i] = inside[p]
            if page.tag[i] in ABOVE:  # the element itself counts as inside
                inside[i, ABOVE.index(page.tag[i])] = 1
            hid[i] = hid[p] or page.hidden[i]
    up_p = np.array([max(0, p) for p in parent])
    prev = np.zeros(n)
    nxt = np.zeros(n)
    last: dict[int, int] = {}
    for i in range(1, n):
        p = parent[i]
        if p in last:
            prev[i] = chars[last[p]]
            nxt[last[p]] = chars[i]
        last[p] = i
    per = np.maximum(1.0, chars)
    plain = np.stack([np.log1p(chars), words / np.maximum(1, leaves), link / per, stops / np.maximum(1, words), chars / nodes, np.log1p(nodes), depth, kids, order, order / np.maximum(1, kids[up_p]), kids[up_p], chars / total, before, chars / np.maximum(1, chars[up_p]), np.log1p(prev), np.log1p(nxt), fields, hid, leaves / nodes], axis=1)
    return np.concatenate([plain, one, g, up, inside], axis=1).astype(np.float32)


class Boost:
    """Gradient-boosted depth-limited trees with logistic loss over binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boost:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], axis=1).astype(np.int64)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.feature, self.cut, self.leaf = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf, np.float32), np.zeros((trees, 2**depth), np.float32)
        z = np.full(n, self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h, node = y - p, np.maximum(p * (1 - p), 1e-6), np.zeros(n, np.int64)
            for d in range(depth):
                k, first = 2**d, 2**d - 1
                best = np.full(k, 1e-3)
                for j in range(f):
                    if not len(edges[j]):
                        continue
                    m = len(edges[j]) + 1
                    at = node * m + b[:, j]
                    sg, sh = (np.bincount(at, weights=w, minlength=k * m).reshape(k, m) for w in (g, h))
                    lg, lh = sg.cumsum(axis=1)[:, :-1], sh.cumsum(axis=1)[:, :-1]
                    tg, th = sg.sum(axis=1, keepdims=True), sh.sum(axis=1, keepdims=True)
                    gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                    gain[(lh < 2) | (th - lh < 2)] = 0
                    c = gain.argmax(axis=1)
                    top = gain[np.arange(k), c]
                    won = top > best
                    best[won] = top[won]
                    self.feature[t, first : first + k][won] = j
                    self.cut[t, first : first + k][won] = edges[j][c[won]]
                own = first + node
                node = node * 2 + (x[np.arange(n), self.feature[t, own]] > self.cut[t, own])
            sg, sh = (np.bincount(node, weights=w, minlength=2**depth) for w in (g, h))
            self.leaf[t] = rate * sg / (sh + 1)
            z += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z, rows, depth = np.full(len(x), self.base), np.arange(len(x)), self.leaf.shape[1].bit_length() - 1
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for d in range(depth):
                own = 2**d - 1 + node
                node = node * 2 + (x[rows, self.feature[t, own]] > self.cut[t, own])
            z += self.leaf[t][node]
        return 1 / (1 + np.exp(-z))


def decode(page: Page, mixed: np.ndarray, inside: np.ndarray) -> list[bool]:
    """Best consistent choice; True for the leaves that are main text."""
    eps = 1e-4
    m, p = np.clip(mixed, eps, 1 - eps), np.clip(inside, eps, 1 - eps)
    all_in, all_out = (np.log(1 - m) + np.log(p)).tolist(), (np.log(1 - m) + np.log(1 - p)).tolist()
    some = np.log(m).tolist()
    n = len(page.parent)
    for i in range(n):
        if page.text[i]:  # a leaf can't be mixed
            all_in[i], all_out[i], some[i] = float(np.log(p[i])), float(np.log(1 - p[i])), -1e9
    for i in range(n - 1, 0, -1):
        k = page.parent[i]
        best = max(all_in[i], all_out[i], some[i])
        all_in[k] += all_in[i]
        all_out[k] += all_out[i]
        some[k] += best
    state, keep = [""] * n, [False] * n
    for i in range(n):
        above = state[page.parent[i]] if i else "some"
        if above == "some":
            top = max(all_in[i], all_out[i], some[i])
            state[i] = "some" if some[i] == top else "out" if all_out[i] == top else "in"
        else:
            state[i] = above
        keep[i] = state[i] == "in" and bool(page.text[i])
    return keep


def sample_pages(count: int = SAMPLE_PAGES, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """(html, main blocks) of made-up pages. Layouts vary in tags, nesting, attribute words, lengths and order."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chance = lambda p: r.random() < p
    sounds = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

    def word() -> str:
        return "".join(pick(sounds) for _ in range(int(r.integers(1, 5)))) + pick(["", "", "", "", ",", "&amp;", "***", "!!"] if loud else ["", "", "", "", "", "", ",", "é"])

    def said(a: int, b: int, stop: bool = True) -> str:
        t = " ".join(word() for _ in range(int(r.integers(a, b))))
        t = t[:1].upper() + t[1:]
        return (t.upper() if caps else t) + ("." if stop else "")

    def mark(kind: str, p: float = 0.75) -> str:
        if not chance(p):
            return f' class="{pick(["c", "x", "row", "col", "box", "inner", "wrap", "b2"])}{int(r.integers(9))}"' if chance(0.5) else ""
        w = pick(TOKENS[kind].split())
        return f' {pick(["class", "id"])}="{pick(["", "site-", "l-", "js-", "main-" if kind == "text" else "the-"])}{w}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{said(1, 3, False)}</a></li>' for _ in range(n))

    def junk(kind: str) -> str:
        if kind == "menu":
            body = f"<ul>{links(int(r.integers(3, 10)))}</ul>" if chance(0.8) else "".join(f'<a href="/">{said(1, 2, False)}</a> | ' for _ in range(5))
            return f"<nav{mark('menu', 0.4)}>{body}</nav>" if chance(0.6) else f"<div{mark('menu')}>{body}</div>"
        if kind == "head":
            t = pick(["header", "header", "div"])
            return f"<{t}{mark('head', 0.9 if t == 'div' else 0.4)}><a href='/'>{said(1, 3, False)}</a><p>{said(2, 8)}</p></{t}>"
        if kind == "foot":
            t = pick(["footer", "footer", "div"])
            body = f"&copy; {word()} &middot; {said(3, 16)}" if chance(0.6) else f"<p>&copy; {said(2, 9)}</p><ul>{links(4)}</ul>"
            return f"<{t}{mark('foot', 0.95 if t == 'div' else 0.3)}>{body}</{t}>"
        if kind == "side":
            t = pick(["aside", "aside", "div", "section"])
            named = f"<h4>{said(1, 4, False)}</h4>" if t != "aside" or chance(0.5) else ""
            said_so = "".join(f"<p>{said(4, 40)}</p>" for _ in range(pick([1, 1, 2]))) if named or chance(0.6) else said(4, 40)
            body = f"<h3>{said(1, 4, False)}</h3><ul>{links(int(r.integers(2, 8)))}</ul>" if chance(0.4) else named + said_so
            return f"<{t}{mark('side', 0.3 if t == 'aside' else 0.95)}>{body}</{t}>"
        if kind == "ad":
            body = said(2, 25) if chance(0.6) else f"<p>{said(2, 20)}</p><a href='/ad'>{said(1, 4, False)}</a>"
            return f"<!-- ad --><div{mark('ad', 0.97)}>{body}</div>"
        if kind == "note":
            return f"<div{mark('note', 0.97)}><p>{said(5, 30)}</p><button>ok</button></div>"
        if kind == "talk":
            one = "".join(f"<{x}{mark('talk', 0.8)}><b>{word()}</b><p>{said(3, 40)}</p></{x}>" for x in [pick(["li", "div", "article"])] * int(r.integers(1, 6)))
            return f"<{(t := pick(['section', 'div', 'ul']))}{mark('talk', 0.97)}><h3>{said(1, 3, False)}</h3>{one}</{t}>"
        if kind == "share":
            return f"<div{mark('share', 0.95)}><a href='#'>{word()}</a> <a href='#'>{word()}</a></div>"
        return f"<form{mark('form', 0.5)}><label>{said(1, 3, False)}</label><input name=q><p>{said(2, 10)}</p><button>go</button></form>"

    for _ in range(count):
        loud, caps, linked = chance(0.25), chance(0.1), pick([0, 0, 0.1, 0.3])
        main: list[str] = []

        def block(tag: str, t: str) -> str:
            main.append(t)
            if chance(linked):  # the whole block is a link
                t = f'<a href="/{word()}">{t}</a>'
            elif tag == "p" and chance(0.3):
                t = f"<b>{t}{pick(['</b>', '<br>'])}" if chance(0.6) else t.replace(" ", f' <a href="/x">{word()}</a> ', 0)
            close = "" if tag in ("p", "li") and chance(0.25) else f"</{tag}>"
            return f"<{tag}>{t}{close}"

        parts = [block("h1", said(3, 10, False))] if chance(0.85) else []
        for _ in range(int(r.integers(0, 14)) if chance(0.9) else int(r.integers(14, 60))):
            kind = r.random()
            if kind < 0.72:
                parts.append(block("p", said(1, 4) if chance(0.12) else said(5, 90)))
            elif kind < 0.82:
                parts.append(block(pick(["h2", "h3"]), said(1, 7, False)))
            elif kind < 0.88:
                usual, linked = linked, pick([linked, linked, 1])  # a list of references is all links
                parts.append(f"<{(t := pick(['ul', 'ol']))}>" + "".join(block("li", said(1, 18)) for _ in range(int(r.integers(2, 7)))) + f"</{t}>")
                linked = usual
            elif kind < 0.92:
                parts.append(f"<blockquote>{block('p', said(5, 40))}</blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr>{block('td', said(1, 3, False))}{block('td', said(1, 5, False))}</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                parts.append(f"<figure><img src=x>{block('figcaption', said(3, 14))}</figure>")
            else:
                parts.append(block("pre", said(4, 30)))
        if not main:
            parts.append(block("p", said(1, 80)))
        for _ in range(pick([0, 0, 1, 2])):
            parts.insert(int(r.integers(len(parts) + 1)), junk(pick(["ad", "share", "side", "side", "note", "form", "menu"])))
        shape = r.random()
        story = "\n".join(parts) if chance(0.3) else "".join(parts)
        if shape < 0.6:
            story = f"<article{mark('text', 0.4)}>{story}</article>"
        elif shape < 0.75:
            story = f"<main{mark('text', 0.4)}>{story}</main>"
        elif shape < 0.9:
            story = f"<div{mark('text', 0.9)}>{story}</div>"
        if shape >= 0.95:  # a bare page
            yield pick(["", "<html><body>"]) + story, [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", t)).split()) for t in main]
            continue
        if chance(0.4):
            story = f"<{(t := pick(['div', 'main', 'section']))}{mark('text', 0.5)}>{story}{junk('talk') if chance(0.3) else ''}</{t}>"
        before = [junk(k) for k in ("head", "menu", "note", "ad", "form") if chance(0.4 if k != "menu" else 0.8)]
        after = [junk(k) for k in ("share", "talk", "side", "ad", "foot", "note") if chance(0.35 if k != "foot" else 0.85)]
        r.shuffle(before)
        body = "".join(before) + story + "".join(after)
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{said(2, 8, False)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        yield head + body + pick(["</body></html>", ""]), [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", t)).split()) for t in main]


def labelled(source: str, main: list[str]) -> tuple[Page, np.ndarray]:
    """The page and, per node, 1 (all text is main), 0 (none) or -1 (mixed)."""
    page, left = parse(source), list(main)
    n = len(page.parent)
    good, bad = np.zeros(n), np.zeros(n)
    for i, t in enumerate(page.text):
        if t:
            hit = t in left
            if hit:
                left.remove(t)
            (good if hit else bad)[i] = 1
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        bad[page.parent[i]] += bad[i]
    return page, np.where((good > 0) & (bad > 0), -1, np.where(good > 0, 1, 0))


@lru_cache(maxsize=1)
def models() -> tuple[Boost, Boost]:
    got = [labelled(s, m) for s, m in sample_pages()]
    x, y = np.concatenate([features(p) for p, _ in got]), np.concatenate([y for _, y in got])
    inner = np.concatenate([[not t for t in p.text] for p, _ in got])
    pure = y >= 0
    return Boost().fit(x[inner], (y[inner] < 0).astype(float)), Boost().fit(x[pure], y[pure].astype(float))


def extract(sources: list[str], both: tuple[Boost, Boost]) -> list[str]:
    pages = [parse(s) for s in sources]
    x = np.concatenate([features(p) for p in pages]) if pages else np.zeros((0, 1))
    mixed, inside = (b.predict(x) for b in both) if pages else ([], [])
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        keep = decode(p, mixed[at : at + n], inside[at : at + n])
        out.append("\n".join(t for t, k in zip(p.text, keep, strict=True) if k))
        at += n
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text, blocks joined by a line feed, empty if there is none), n_chars.

    Null or empty html gives an empty text. Repeated rows are kept; other columns are not read; no shuffle.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(models())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = shared.value
        for batch in batches:
            for piece in slices(batch, "html", 1 << 20):
                text = extract([h or "" for h in piece.column("html").to_pylist()], both)
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
