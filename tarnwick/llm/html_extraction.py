"""Main-text extraction by boosted trees over DOM-node features, decoded over the tree.

Each block element gets features of itself (tag, words of its attributes,
depth, text, links, marks), of its subtree (density of text and tags, paragraphs,
what it holds), of its ancestors and of its siblings. Boosted trees give the
odds that a node is main text, is not, or is mixed. Decoding picks the likeliest
states for the whole tree at once: below a node that is main text all is main
text, below one that is not nothing is, and only mixed nodes leave their
children free, so ancestors and descendants never contradict each other.

The model is trained here on pages that ``sample_page`` writes, with known
labels, from a fixed seed; ``TRAIN_PAGES`` bounds them. Training takes some
twenty seconds and is kept for the process and in the shared folder; the trees, some 100 kB, go to the workers.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import math
import pathlib
import random
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder
from .gbdt import Boosted
from .html_dom import Node, attribute_tokens, parse

OUT, IN, MIXED = range(3)
TRAIN_PAGES = 2400
#: Characters of pages whose nodes are scored together.
STEP = 4 << 20

# Words of attributes, by what they name. They are a start for the generator; the trees see learned weights of them.
MAIN_WORDS = "article content post entry story body text main prose blog news page hentry section paragraph".split()
AWAY_WORDS = {
    "nav": "nav navbar navigation menu topnav links breadcrumb breadcrumbs crumbs pager pagination tabs toc".split(),
    "header": "header masthead top topbar branding banner logo site".split(),
    "footer": "footer bottom colophon copyright legal credits foot".split(),
    "side": "sidebar aside side rail widget related recommended popular trending more complementary".split(),
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay dialog message privacy paywall".split(),
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted banner commercial".split(),
    "form": "form search newsletter subscribe subscription signup login contact".split(),
    "comments": "comment comments commentlist responses replies discussion disqus thread respond reviews".split(),
    "share": "share sharing social follow tools actions buttons".split(),
}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "notice": "alert", "form": "search"}
PLAIN_WORDS = "row col container wrapper inner block box module grid left right center clearfix wide panel layout unit item group holder outer area region".split()

FEATURES = (
    "tag attr_low attr_high attrs up_tag_low up_tag_high up_attr_low up_attr_high depth place siblings start "
    "chars share links density marks words word_length paragraphs blocks before after before_links after_links alike "
    "parent_share parent_links down_tag_low down_tag_high down_attr_low down_attr_high headings inputs leaf bold hidden items first_main"
).split()
_HEADINGS, _MARKS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(".,;:!?")


def nodes_of(page: str) -> list[Node]:
    """The block nodes of a page in order, parents first; blocks with nothing but text hold it themselves."""
    root, out = parse(page), []
    stack = [root]
    while stack:
        node = stack.pop()
        out.append(node)
        if node.children and all(c.tag == "#text" for c in node.children):
            node.text = [t for c in node.children for t in c.text]
            node.links = sum(c.links for c in node.children)
            node.children = []
        stack.extend(reversed(node.children))
    return out


class Weights:
    """Log odds of main text for tags and attribute words, learned from labelled nodes; unknown words weigh nothing."""

    def __init__(self) -> None:
        self.tags: dict[str, float] = {}
        self.words: dict[str, float] = {}
        self.seen: dict[str, tuple[float, float, int]] = {}

    def fit(self, rows: list[tuple[Node, int]]) -> Weights:
        for known, names in ((self.tags, lambda n: [n.tag]), (self.words, lambda n: set(attribute_tokens(n.attrs)))):
            counts: dict[str, list[float]] = {}
            for node, label in rows:
                if label != MIXED:
                    for name in names(node):
                        counts.setdefault(name, [2.0, 2.0])[label] += 1
            known.update({k: round(math.log(v[IN] / v[OUT]), 4) for k, v in counts.items() if sum(v) >= 12})
        return self

    def of(self, attrs: str) -> tuple[float, float, int]:
        """Lowest and highest weight of the words, and their number."""
        if not attrs:
            return 0.0, 0.0, 0
        if (got := self.seen.get(attrs)) is None:
            tokens = attribute_tokens(attrs)
            w = [self.words.get(t, 0.0) for t in tokens] or [0.0]
            got = (min(0.0, *w), max(0.0, *w), len(tokens))
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[attrs] = got
        return got


def features(pages: list[list[Node]], weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows of all nodes, index of each node's parent or -1)."""
    rows, parents, spans, own = [], [], [], []
    for nodes in pages:
        base = len(parents)
        for k, node in enumerate(nodes):
            node.depth = base + k  # its row, from here on
            parents.append(node.parent.depth if node.parent is not None else -1)
            text = node.text
            chars = words = marks = 0
            for t in text:
                chars += len(t)
                words += t.count(" ") + 1
                marks += t.count(".") + t.count(",") + t.count(";") + t.count("!") + t.count("?")
            low, high, many = weights.of(node.attrs)
            tag = node.tag
            rows.append((weights.tags.get(tag, 0.0), low, high, many, chars, node.links, words, marks, node.tags + 1, tag == "p", tag in _HEADINGS, node.inputs, not node.children, node.bold, node.hidden, tag == "li"))
        spans.append((base, len(parents)))
    parent = np.array(parents, np.int64)
    x = np.array(rows, np.float64).reshape(-1, 16)
    n = len(x)
    tag, low, high = x[:, 0], x[:, 1], x[:, 2]
    sums = np.ascontiguousarray(x[:, 4:16])
    blocks, tag_low, tag_high, attr_low, attr_high = np.ones(n), tag.copy(), tag.copy(), low.copy(), high.copy()
    # by depth: ancestors downwards, sums upwards
    level = np.zeros(n, np.int64)
    for k, p in enumerate(parents):
        if p >= 0:
            level[k] = level[p] + 1
    up = np.zeros((n, 4))
    by_level = [np.flatnonzero(level == d) for d in range(level.max() + 1)] if n else []
    for at in by_level[1:]:
        p = parent[at]
        up[at, 0], up[at, 1] = np.minimum(up[p, 0], tag[p]), np.maximum(up[p, 1], tag[p])
        up[at, 2], up[at, 3] = np.minimum(up[p, 2], low[p]), np.maximum(up[p, 3], high[p])
    for at in reversed(by_level[1:]):
        p = parent[at]
        np.add.at(sums, p, sums[at])
        np.add.at(blocks, p, blocks[at])
        np.minimum.at(tag_low, p, tag_low[at])
        np.maximum.at(tag_high, p, tag_high[at])
        np.minimum.at(attr_low, p, attr_low[at])
        np.maximum.at(attr_high, p, attr_high[at])
    chars, links, words, marks, tags = (sums[:, k] for k in range(5))
    first = np.concatenate([np.full(b - a, a) for a, b in spans]) if spans else np.empty(0, np.int64)
    whole = np.maximum(chars[first], 1)
    start = np.cumsum(x[:, 4]) - x[:, 4]
    start = (start - start[first]) / whole
    # siblings: rows of one parent, in order
    order = np.lexsort((np.arange(n), parent))
    q = parent[order]
    same = np.r_[False, (q[1:] == q[:-1]) & (q[1:] >= 0)] if n else np.empty(0, bool)
    before, after = np.full(n, -1), np.full(n, -1)
    before[order[1:][same[1:]]] = order[:-1][same[1:]]
    after[order[:-1][same[1:]]] = order[1:][same[1:]]
    run = np.maximum.accumulate(np.where(same, 0, np.arange(n))) if n else np.empty(0, np.int64)
    place = np.empty(n)
    place[order] = np.arange(n) - run
    siblings = np.ones(n)
    some = parent >= 0
    siblings[some] = np.bincount(parent[some], minlength=n)[parent[some]]
    alike = np.zeros(n)
    if n:
        _, at, count = np.unique(np.stack((parent, np.round(tag * 1000).astype(np.int64))), axis=1, return_inverse=True, return_counts=True)
        alike = count[at.ravel()]
    link_share = links / np.maximum(chars, 1)
    top = np.maximum(parent, first)
    beside = lambda a, k, none: np.where(k >= 0, a[np.maximum(k, 0)], none)
    log = np.log1p
    cols = [
        tag, low, high, x[:, 3], up[:, 0], up[:, 1], up[:, 2], up[:, 3], level, place, siblings, start,
        log(chars), chars / whole, link_share, log(chars / np.maximum(tags, 1)), marks / np.maximum(words, 1), log(words), chars / np.maximum(words, 1), log(sums[:, 5]), log(blocks),
        beside(log(chars), before, -1), beside(log(chars), after, -1), beside(link_share, before, -1), beside(link_share, after, -1), alike,
        chars[top] / whole, link_share[top], tag_low, tag_high, attr_low, attr_high, log(sums[:, 6]), log(sums[:, 7]), sums[:, 8] == blocks, log(sums[:, 9]), x[:, 14], log(sums[:, 11]), log(chars[first]),
    ]
    return np.stack(cols, axis=1).astype(np.float32), parent


def decode(logp: np.ndarray, parent: np.ndarray, leaf: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """The likeliest consistent states: rows parents first; ``empty`` nodes (no text below) weigh nothing, leaves can't be mixed."""
    n = len(logp)
    best = np.where(empty[:, None], 0.0, logp)
    all_out, all_in = best[:, OUT].copy(), best[:, IN].copy()
    free = best[:, MIXED].copy()
    free[leaf] = -np.inf
    up = parent.tolist()
    o, i, f = all_out.tolist(), all_in.tolist(), free.tolist()
    for k in range(n - 1, -1, -1):
        p = up[k]
        if p >= 0:
            o[p] += o[k]
            i[p] += i[k]
            f[p] += max(o[k], i[k], f[k])
    state = [MIXED] * n
    for k in range(n):
        above = state[up[k]] if up[k] >= 0 else MIXED
        if above != MIXED:
            state[k] = above
        else:
            state[k] = MIXED if f[k] >= max(o[k], i[k]) else IN if i[k] > o[k] else OUT
    return np.array(state)


class Extractor:
    """A trained model."""

    def __init__(self, weights: Weights, trees: Boosted) -> None:
        self.weights, self.trees = weights, trees

    def states(self, pages: list[list[Node]]) -> np.ndarray:
        """The decoded state of each node of the pages."""
        x, parent = features(pages, self.weights)
        chars = x[:, FEATURES.index("chars")]
        return decode(self.trees.log_proba(x), parent, np.array([not n.children for p in pages for n in p]), chars == 0)

    def texts(self, pages: list[str]) -> list[list[str]]:
        """The main text's blocks of each page."""
        trees = [nodes_of(p) for p in pages]
        states = self.states(trees) if trees else []
        out, at = [], 0
        for nodes in trees:
            out.append([t for node, s in zip(nodes, states[at : at + len(nodes)]) if s == IN for t in node.text])
            at += len(nodes)
        return out


# ---------------------------------------------------------------- training pages

_SYLLABLES = "ta re mi on el pa su ver ko lin da ro ne ti ha bo gra che lu fen".split()


#: How a page holds its paragraphs: as such, as divs without names, under hashed names, parted by line breaks alone, all of the page in divs without names, right in the body, or in a table of the page.
LAYOUTS = ("p", "div", "hashed", "breaks", "flat", "bare", "table")
_SHARES = (0.52, 0.09, 0.12, 0.1, 0.07, 0.05, 0.05)


def sample_page(rng: random.Random, layout: str | None = None) -> tuple[str, list[str]]:
    """(a page, its main text's blocks): main text is marked by the private characters U+E000 and U+E001, which ``labelled`` takes out."""
    layout = layout or rng.choices(LAYOUTS, _SHARES)[0]
    plain = layout in ("hashed", "flat") or rng.random() < 0.12  # nothing but meaningless names
    quiet = layout == "flat"  # nothing in the main text that only a name would tell from it

    style = rng.choice(("", "", "", "", "dull", "loud", "marks", "bars", "bare"))  # of the main text
    own = False

    def word() -> str:
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def sentence(lo: int = 1, hi: int = 18) -> str:
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(lo, hi) if rng.random() < 0.85 else rng.randint(1, 2))]
        text = " ".join(words).capitalize().rstrip(",") + rng.choice("...!?")
        if own and style == "dull":
            return " ".join([words[0][: rng.randint(1, 9)]] * rng.randint(4, 14))
        if own and style == "loud":
            return " ".join(w.upper() + "!!" for w in words)
        if own and style == "marks":
            return " ".join(w + rng.choice(("***", "$$$", "&amp;&amp;&amp;", "%%%")) for w in words)
        if own and style == "bars":
            return " | ".join(words)
        return " ".join(words) if own and style == "bare" else text

    def prose(lo: int, hi: int) -> str:
        text = " ".join(sentence() for _ in range(rng.randint(lo, hi)))
        return text if rng.random() < 0.8 else text.replace(" ", f" <a href='/{word()}'>{word()}</a> ", 1) if rng.random() < 0.6 else f"<b>{text}</b>"

    def name(words: list[str]) -> str:
        if layout == "hashed" and rng.random() < 0.9:
            return rng.choice(("css-", "sc-", "_", "jsx-", "x")) + "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((1, 4, 6, 8))))
        if plain or rng.random() < 0.08:
            return word() + str(rng.randint(1, 99)) if rng.random() < 0.6 else rng.choice(PLAIN_WORDS)
        w = rng.choice(words)
        return w if rng.random() < 0.5 else rng.choice("-_").join(rng.sample([w, rng.choice(PLAIN_WORDS + ["site", "main", "page"])], 2)) if rng.random() < 0.8 else w + rng.choice(PLAIN_WORDS).capitalize()

    def attrs(words: list[str]) -> str:
        if layout == "flat":
            return ""
        r = rng.random()
        return f' class="{name(words)}"' if r < 0.6 else f' id="{name(words)}"' if r < 0.75 else f' id={name(words)} class="{name(words)} {rng.choice(PLAIN_WORDS)}"' if r < 0.9 else ""

    def box(kind: str, tags: list[str], body: str, always: bool = False) -> str:
        tag = "div" if layout == "flat" or plain and rng.random() < 0.7 else rng.choice(tags)
        if not plain and kind in ROLES and rng.random() < 0.08:
            return f'<{tag} role="{ROLES[kind]}">{body}</{tag}>'
        a = attrs(AWAY_WORDS[kind]) if always or tag == "div" or rng.random() < 0.5 else ""
        return f"<{tag}{a or (attrs(AWAY_WORDS[kind]) if tag == 'div' else '')}>{body}</{tag}>"

    def menu(lo: int = 2, hi: int = 12) -> str:
        links = [f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a>' for _ in range(rng.randint(lo, hi))]
        r = rng.random()
        return f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>" if r < 0.6 else rng.choice((" | ", " ", " &raquo; ", " / ")).join(links) if r < 0.85 else "".join(f"<div>{x}</div>" for x in links)

    def nav() -> str:
        return box("nav", ["nav", "div", "ul", "div"], menu())

    def ad() -> str:
        body = rng.choice((sentence(), prose(1, 3), f'<a href="/{word()}">{sentence()}</a>', f"<p>{prose(1, 2)}</p>", f"<h4>{sentence(1, 4)}</h4><p>{prose(1, 2)}</p>"))
        return box("ad", ["div", "div", "div", "aside", "section"], body, True)

    def notice() -> str:
        return box("notice", ["div", "div", "section", "aside", "dialog"], rng.choice((f"<p>{prose(1, 2)}</p>", prose(1, 2))) + (rng.choice(("<button>OK</button>", f'<a href="/{word()}">{word()}</a>', "")) ), True)

    def form() -> str:
        fields = "".join(f"<label>{word()}</label><input name={word()}>" for _ in range(rng.randint(1, 4)))
        return rng.choice((f"<form{attrs(AWAY_WORDS['form'])}><p>{sentence()}</p>{fields}<button>{word()}</button></form>", box("form", ["div", "section"], f"<h3>{sentence(1, 4)}</h3><form>{fields}<input type=submit></form>", True)))

    def share() -> str:
        return box("share", ["div", "ul", "p"], rng.choice((menu(2, 5), f"{word()}: " + menu(2, 4))), True)

    def side() -> str:
        parts = [rng.choice((lambda: f"<h3>{sentence(1, 4)}</h3>" + menu(3, 8), lambda: f"<h4>{sentence(1, 3)}</h4><p>{prose(1, 2)}</p>", ad, form, lambda: f"<p>{prose(1, 3)}</p>", lambda: box("side", ["div", "section"], f"<h3>{sentence(1, 4)}</h3>" + menu(2, 7), True)))() for _ in range(rng.randint(1, 4))]
        return box("side", ["aside", "aside", "div", "div", "section"], "".join(parts))

    def comments() -> str:
        n = rng.randint(1, 7)
        kind = rng.random()
        items = []
        for _ in range(n):
            who = rng.choice((f"<b>{word()}</b>", f"<cite>{word()}</cite>", f"<h4>{word()} {word()}</h4>", f'<p class="author">{word()}</p>', f"<div class='meta'>{word()} 12:3{rng.randint(0, 9)}</div>"))
            body = rng.choice((prose(1, 4), f"<p>{prose(1, 5)}</p>", f"<p>{prose(1, 3)}</p><p>{prose(1, 2)}</p>"))
            tag = "li" if kind < 0.4 else rng.choice(("div", "article"))
            items.append(f"<{tag}{attrs(AWAY_WORDS['comments']) if rng.random() < 0.7 else ''}>{who}{body}</{tag}>")
        listed = "".join(items)
        listed = f"<{rng.choice(('ol', 'ul'))}{attrs(AWAY_WORDS['comments'])}>{listed}</ol>".replace("</ol>", "</ol>") if kind < 0.4 else listed
        title = rng.choice((f"<h2>{word()}</h2>", f"<h3>{n} {word()}</h3>", ""))
        return box("comments", ["section", "div", "div"], title + listed + (form() if rng.random() < 0.3 else ""), True)

    def header() -> str:
        parts = [rng.choice((f"<h1>{word()} {word()}</h1>", f'<a href="/">{word()}</a>', f"<div>{word()} {word()}</div>", f"<p>{sentence(1, 6)}</p>"))]
        if rng.random() < 0.5:
            parts.append(nav())
        if rng.random() < 0.3:
            parts.append(form())
        return box("header", ["header", "div"], "".join(parts))

    def footer() -> str:
        parts = [rng.choice((f"{word().capitalize()} {rng.randint(1996, 2024)} {word()} {word()}. {sentence()} {menu(1, 3)}", f"&copy; {word()}.com &middot; {prose(1, 3)}", f"<p>&copy; 2024 {word()}. {sentence()}</p>", prose(1, 3), f"<p>{prose(1, 2)}</p>"))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), menu(2, 8))
        return box("footer", ["footer", "footer", "div"], "".join(parts))

    divs = rng.random() < 0.7

    def broken() -> str:
        """A main text parted by line breaks alone, its title a heading, bold or none."""
        nonlocal own
        own = True
        gap = rng.choice(("<br><br>", "<br/><br/>", "<br>\n<br>", "<br>"))
        lines = [prose(1, 7) for _ in range(rng.choice((2, 3, 4, 6, 9)))]
        title = sentence(1, 10)
        r = rng.random()
        body = f"<h{rng.choice('112')}>{kept(title)}</h1>{kept(gap.join(lines))}" if r < 0.7 else kept(gap.join([f"<b>{title}</b>", *lines])) if r < 0.85 else kept(gap.join(lines))
        own = False
        return f"<{tag}{attrs(MAIN_WORDS)}>{body}</{tag}>" if (tag := rng.choice(("div", "div", "div", "article", "section", "td"))) != "td" else f"<table><tr><td>{menu(3, 8)}</td><td>{body}</td></tr></table>"

    def kept(text: str) -> str:
        return f"\ue000{text}\ue001"

    def para(lo: int = 1, hi: int = 7) -> str:
        text = kept(prose(lo, hi) if rng.random() < 0.97 else prose(30, 150))
        if layout == "div" or layout in ("hashed", "flat") and divs:
            return f"<div{attrs(MAIN_WORDS) if layout != 'div' or rng.random() < 0.1 else ''}>{text}</div>"
        r = rng.random()
        return f"<p>{text}</p>" if r < 0.82 else f"<p>{text}" if r < 0.9 else f"<p><b>{text}<br>" if r < 0.95 else f"<div>{text}</div>"

    def article() -> str:
        nonlocal own
        own = True
        parts = [f"<h1>{kept(sentence(1, 10))}</h1>"] if rng.random() < 0.9 else []
        brief = rng.random() < 0.25
        for k in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            r = rng.random()
            if r < 0.1 and k:
                parts.append(f"<h{rng.randint(2, 4)}>{kept(sentence(1, 7))}</h2>".replace("</h2>", "</h2>"))
            if r > 0.95:
                parts.append(f"<ul>{''.join(f'<li>{kept(prose(1, 2))}</li>' for _ in range(rng.randint(2, 6)))}</ul>")
            elif r > 0.92:
                parts.append(f"<blockquote>{para(1, 3)}</blockquote>")
            elif r > 0.9:
                parts.append(f"<figure><img src=x><figcaption>{kept(sentence())}</figcaption></figure>")
            elif r > 0.885:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{kept(sentence(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif r > 0.87:
                parts.append(f"<pre>{kept(sentence())}</pre>")
            parts.append(para(1, 1) if brief else para())
        own = False
        for extra, chance in ((ad, 0.2), (share, 0.12), (form, 0.1), (side, 0.14), (notice, 0.2)):
            if rng.random() < (0 if quiet else chance):
                parts.insert(rng.randint(1, len(parts)), extra())
        body = "".join(parts)
        if rng.random() < 0.2:
            body = f"<div{attrs(MAIN_WORDS)}>{body}</div>"
        if rng.random() < 0.12:
            body += comments()
        if layout in ("bare", "table"):
            return body
        tag = "div" if layout == "flat" else rng.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        a = attrs(MAIN_WORDS) if tag in ("div", "section") or rng.random() < 0.3 else ""
        return f"<table{attrs(PLAIN_WORDS)}><tr><td>{menu(3, 8)}</td><td>{body}</td></tr></table>" if tag == "td" else f"<{tag}{a}>{body}</{tag}>"

    if quiet:
        ad = notice = share
    top = [f for f, chance in ((notice, 0.2), (header, 0.5), (nav, 0.65), (ad, 0.4), (form, 0.08), (side, 0.12)) if rng.random() < chance]
    end = [f for f, chance in ((share, 0.12), (comments, 0.35), (side, 0.3), (ad, 0.2), (form, 0.12), (notice, 0.12)) if rng.random() < chance]
    rng.shuffle(end)
    middle = "".join(["".join(f() for f in top), broken() if layout == "breaks" else article(), "".join(f() for f in end)])
    if rng.random() < 0.06:
        middle = "".join(f() for f in top + end)  # a page without main text
    for _ in range(0 if layout == "bare" else rng.choice((0, 0, 0, 1, 1, 2))):
        middle = f"<div{attrs(PLAIN_WORDS)}>{middle}</div>"
    foot = footer() if rng.random() < 0.85 else ""
    if layout == "table":  # rows of the page: what stands above, a menu beside the main text, what stands below
        cell = lambda body, a="": f"<td{a or rng.choice(('', '', ' width=150', ' valign=top'))}>{body}</td>"
        rows = [cell(rng.choice((f'<a href="/">{word()}</a>', f"<b>{word()} {word()}</b>", f"<img src=x> {sentence(1, 4)}")), " colspan=2"), cell(menu(3, 9)) + cell(article()), cell("".join(f() for f in end[:1]), " colspan=2") if end and rng.random() < 0.3 else ""]
        if rng.random() < 0.8:
            rows.append(cell(rng.choice((f"&copy; {rng.randint(1996, 2024)} {word()}. {sentence()} {menu(1, 3)}", f"<p>{sentence(1, 5)}</p>", f"{word().capitalize()} {rng.randint(1996, 2024)} {sentence()} {menu(2, 4)}", menu(2, 6))), " colspan=2"))
        middle, foot = f"<table{attrs(PLAIN_WORDS)}>{''.join(f'<tr>{x}</tr>' for x in rows if x)}</table>", ""
    ending = "</body></html>" if rng.random() < 0.8 else ""
    page = f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{middle}<!-- {word()} -->{foot}{ending}"
    return page, [b.split("\ue001")[0] for b in page.split("\ue000")[1:]]


def labelled(page: str) -> list[tuple[Node, int]]:
    """A sample page's nodes with their labels; the marks are gone from the texts."""
    nodes = nodes_of(page)
    good, total = {}, {}
    for node in nodes:
        text = " ".join(node.text)
        marked = "\ue000" in text
        node.text = [t for t in (t.replace("\ue000", "").replace("\ue001", "") for t in node.text) if t]
        total[id(node)] = sum(map(len, node.text))
        good[id(node)] = total[id(node)] if marked else 0
    for node in reversed(nodes):
        if node.parent is not None:
            for count in (good, total):
                count[id(node.parent)] += count[id(node)]
    return [(n, MIXED if 0 < good[id(n)] < total[id(n)] else IN if good[id(n)] else OUT) for n in nodes]


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 3, without: str | None = None) -> Extractor:
    """The model, trained on ``pages`` sample pages, none of them of the layout ``without``."""
    rng = random.Random(seed)
    kinds = [k for k in rng.choices(LAYOUTS, _SHARES, k=2 * pages) if k != without][:pages]
    rows = [labelled(sample_page(rng, k)[0]) for k in kinds]
    weights = Weights().fit([x for page in rows for x in page])
    x, _ = features([[n for n, _ in page] for page in rows], weights)
    y = np.array([label for page in rows for _, label in page])
    some = x[:, FEATURES.index("chars")] > 0
    return Extractor(weights, Boosted(3).fit(x[some], y[some]))


def _packed(model: Extractor) -> bytes:
    out, trees = io.BytesIO(), model.trees
    shape = {k: getattr(trees, k) for k in ("classes", "rounds", "depth", "bins")}
    np.savez_compressed(out, about=np.frombuffer(json.dumps([model.weights.tags, model.weights.words, shape]).encode(), np.uint8), base=trees.base, feature=trees.feature, cut=trees.cut, value=trees.value)
    return out.getvalue()


def _unpacked(data: bytes) -> Extractor:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        tags, words, shape = json.loads(held["about"].tobytes())
        weights, trees = Weights(), Boosted(**shape)
        weights.tags, weights.words = tags, words
        trees.base, trees.feature, trees.cut, trees.value = (held[k] for k in ("base", "feature", "cut", "value"))
    return Extractor(weights, trees)


@functools.lru_cache(maxsize=1)
def _known_as() -> str:
    """What the model follows from: the code that writes its pages, reads them and trains it."""
    here = pathlib.Path(__file__).parent
    return hashlib.sha256(b"".join((here / f"{name}.py").read_bytes() for name in ("html_extraction", "html_dom", "gbdt"))).hexdigest()[:16]


_MODELS: dict[str, Extractor] = {}


def shared_model(spark: SparkSession) -> Extractor:
    """The trained model, kept for the process and in the shared folder: later sessions that name the same folder read it there.

    Each writer has a folder of its own, and all that were finished hold the
    same model, so a write that was broken off, or another session's at the
    same time, is passed over.
    """
    if (key := _known_as()) not in _MODELS:
        path = f"{shared_folder(spark)}/html-model-{key}"
        try:
            found = spark.read.schema("model binary").parquet(f"{path}-*").where("model IS NOT NULL").first()
        except AnalysisException:  # no folder yet
            found = None
        if found is None:
            _MODELS[key] = trained()
            spark.createDataFrame([(bytearray(_packed(_MODELS[key])),)], "model binary").coalesce(1).write.parquet(f"{path}-{uuid.uuid4().hex}")
        else:
            _MODELS[key] = _unpacked(bytes(found["model"]))
    return _MODELS[key]


def _extract(model: Extractor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[str]] = []
            held, size = [], 0
            for page in batch.column(2):
                held.append(page.as_py() or "")
                size += len(held[-1])
                if size > STEP:
                    texts += model.texts(held)
                    held, size = [], 0
            texts += model.texts(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "url", "blocks"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Extractor | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, blocks (the main text's, in page order).

    A null or empty page, and one without main text, has no blocks. Ids, null
    or repeated, and urls pass through. Of an unclosed script nothing is text;
    other broken markup is read as browsers do, roughly. An empty table gives
    no rows; extra columns aren't read.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(_extract(model or shared_model(pages.sparkSession)), "page_id long, url string, blocks array<string>")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for the whole of ``pages``."""
    text = F.array_join("blocks", "\n\n")
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
