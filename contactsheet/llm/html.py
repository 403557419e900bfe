"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of block elements whose leaves are runs of text.  Each node has features of its tag, its
attributes' tokens, its depth, the text, link and punctuation density of its subtree, and its siblings.  Trees boosted
in numpy give each node the log odds of belonging to the main text.  Decoding chooses for the tree as a whole: a
dropped element drops all that is below it, a kept leaf needs all its ancestors kept, and among such choices the one
with the largest sum of log odds (weighted by text) wins, so no node contradicts its ancestors or descendants.

The model is fitted on a bounded sample: pages laid out anew from text runs of at most `sample` given pages, in many
layouts whose parts are known (semantic tags, telling or meaningless class names, none at all), and the given pages
themselves where their own semantic tags say what is what.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, on_workers, steps, table

#: The HTML elements that make blocks, by kind, and those that hold no text to read.
KINDS = {k: i for i, k in enumerate("#text body div section article main p heading list item table cell nav header footer aside form quote pre figure other".split())}
BLOCKS = {
    **{t: t for t in "body div section article main p nav header footer aside form pre figure".split()},
    **{t: "heading" for t in "h1 h2 h3 h4 h5 h6 hgroup".split()}, **{t: "list" for t in "ul ol dl menu".split()}, **{t: "item" for t in "li dt dd".split()},
    **{t: "table" for t in "table tbody thead tfoot tr caption".split()}, **{t: "cell" for t in "td th".split()},
    "blockquote": "quote", **{t: "other" for t in "address details summary dialog fieldset legend figcaption html center search hr".split()},
}
SILENT = set("script style noscript template svg iframe canvas select textarea button title annotation annotation-xml audio video map".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an element of this tag closes when it opens, up to the nearest of the bounds.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
GOOD = set("article articlebody content main post entry story body text blog news prose page copy paragraph post-content entry-content".split())
BAD = set(
    "nav navbar navigation menu menubar header masthead banner footer foot sidebar side aside rail ad ads adv advert advertisement sponsor sponsored promo promotion cookie cookies consent notice alert popup modal overlay "
    "comment comments commentlist reply replies respond discussion disqus share sharing social related recommended widget breadcrumb breadcrumbs pagination pager login signin signup newsletter subscribe form search tags toolbar copyright legal complementary contentinfo skip".split()
)
#: Words after which a name tells what a box has or lacks, not what it is: `post-with-sidebar`, `no-ads`.
ABOUT = set("with without no not has have hide hidden show is".split())
COMMENT = set("comment comments commentlist reply replies respond discussion disqus".split())

#: What follows a tag's name.  Quotation marks bound a value only right behind an equals sign, and only if both are there.
_REST = r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>{_REST})>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
#: One attribute after another, so that nothing within a value is taken for one.
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAMED = set("class id role itemprop aria-label".split())
#: Tells the part of an element of a training page; read there only, so a given page may use it as it likes.
_MARK = "data-part"
#: A tag that closes itself; in `a=b/>` the slash belongs to the value.
_EMPTY = re.compile(r"(?<!=)/\Z")
_BARE_VALUE = re.compile(r"=\s*[^\s\"'>]+\Z")
_SAME = {t: re.compile(rf"<(/?){t}(?=[\s/>])({_REST})>", re.IGNORECASE) for t in SILENT}
_BLOCK = re.compile(r"</?(?:" + "|".join(BLOCKS) + r")(?=[\s/>])", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?;:,](?:\s|$)")


@dataclass
class Dom:
    """Nodes of a batch of pages in document order.  `text` is empty for elements; `part`: what training pages are told."""

    page: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    good: list[int] = field(default_factory=list)
    bad: list[int] = field(default_factory=list)
    talk: list[int] = field(default_factory=list)
    about: list[int] = field(default_factory=list)
    link: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    part: list[int] = field(default_factory=list)

    def node(self, page: int, up: int, kind: int, level: int = 0, good: int = 0, bad: int = 0, talk: int = 0, about: int = 0, link: int = 0, text: str = "", part: int = -1) -> int:
        self.page.append(page), self.up.append(up), self.depth.append(self.depth[up] + 1 if up >= 0 else 0), self.kind.append(kind), self.level.append(level)
        self.good.append(good), self.bad.append(bad), self.talk.append(talk), self.about.append(about), self.link.append(link), self.text.append(text), self.part.append(part)
        return len(self.up) - 1


def _names(value: str) -> tuple[set[str], set[str]]:
    """The words of an attribute's names that say what a box is, and those that say what it has or lacks."""
    own, about = set(), set()
    for name in value.split():
        words, found = own, [x.lower() for x in _NAME.findall(name)]
        for word in found:
            if word in ABOUT and len(found) > 1:
                words = about
            else:
                words.add(word)
    return own, about


def _empty(attrs: str) -> bool:
    return bool(_EMPTY.search(attrs)) and not _BARE_VALUE.search(attrs)


def _silent_end(source: str, tag: str, at: int, flat: set[str]) -> int:
    """Where the silent element that opened before `at` ends.

    It ends with its closing tag; scripts and styles without one run to the end of the page.  Others without one, or
    opened again before it, were left open: they end at the next block, or at once if none follows.  `flat`: elements
    that may nest but were seen unbalanced; they are no longer counted, so a page is read a bounded number of times.
    """
    depth = 1
    for m in _SAME[tag].finditer(source, at):
        if m[1]:
            depth -= 1
            if not depth or tag in ("script", "style"):
                return m.end()
        elif tag in ("script", "style") or _empty(m[2]):
            continue
        elif tag in ("svg", "template") and tag not in flat:
            depth += 1
        else:
            break
    if tag in ("script", "style"):
        return len(source)
    flat.add(tag)
    block = _BLOCK.search(source, at)
    return block.start() if block else at


def _tokens(source: str) -> Iterator[tuple[re.Match, int]]:
    """Tags and comments with where they end; a silent element is one token."""
    at, flat = 0, set()
    while m := _TOKEN.search(source, at):
        at, tag = m.end(), (m["tag"] or "").lower()
        if tag in SILENT and not m["close"] and not _empty(m["attrs"]):
            at = _silent_end(source, tag, at, flat)
        yield m, at


def parse(dom: Dom, page: int, source: str, marked: bool = False) -> None:
    """Adds a page's blocks and text runs to `dom`; `marked`: a training page, whose elements tell their parts."""
    root = dom.node(page, -1, KINDS["body"])
    stack: list[tuple[str, int]] = [("html", root)]
    run: list[str] = []
    linked, anchor = 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                dom.node(page, stack[-1][1], 0, link=min(linked, len(text)), text=text)
            run.clear()
        linked = 0

    def shut(names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in bounds:
                return

    at = 0
    for m, end in _tokens(source):
        if m.start() > at:
            piece = source[at : m.start()]
            run.append(piece)
            if anchor:
                linked += len(piece)
        at = end
        tag = m["tag"]
        if tag is None or tag.lower() in SILENT:
            continue
        tag = tag.lower()
        if tag == "a":
            anchor = 0 if m["close"] else 1
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            if m["close"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            if tag == "body" or tag == "html" or tag == "hr":
                if marked and _MARK in m["attrs"]:
                    dom.part[root] = int(dict((k, a or b or c) for k, a, b, c in _ATTR.findall(m["attrs"]))[_MARK])
                continue
            shut(("p",), ("td", "th", "table", "button")) if stack[-1][0] == "p" else None
            if tag in CLOSES:
                shut(*CLOSES[tag])
            good = bad = talk = about = 0
            part = -1
            if m["attrs"]:
                for key, a, b, c in _ATTR.findall(m["attrs"]):
                    key, value = key.lower(), a or b or c
                    if marked and key == _MARK:
                        part = int(value)
                    elif key in NAMED:
                        names, others = _names(value)
                        good += len(names & GOOD)
                        bad += len(names & BAD)
                        talk += len(names & COMMENT)
                        about += len(others & (GOOD | BAD))
            level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
            here = dom.node(page, stack[-1][1], KINDS[BLOCKS[tag]], level, good, bad, talk, about, part=part)
            stack.append((tag, here))
    if at < len(source):
        run.append(source[at:])
    flush()


def _tree_sum(value: np.ndarray, up: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    out = value.astype(np.float64).copy()
    for at in levels[:0:-1]:
        np.add.at(out, up[at], out[at])
    return out


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def features(dom: Dom) -> np.ndarray:
    up, depth, kind = (np.array(x, np.int64) for x in (dom.up, dom.depth, dom.kind))
    n = len(up)
    if not n:
        return np.zeros((0, 1))
    levels = _levels(depth)
    leaf = kind == 0
    size = np.array([len(t) for t in dom.text], np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in dom.text], np.float64)
    stops = np.array([len(_STOP.findall(t)) if t else 0 for t in dom.text], np.float64)
    ends = np.array([t[-1:] in ".!?…" and t != "" for t in dom.text], np.float64)
    link = np.array(dom.link, np.float64)
    good, bad, talk, about = (np.array(x, np.float64) for x in (dom.good, dom.bad, dom.talk, dom.about))
    is_ = {k: (kind == i).astype(np.float64) for k, i in KINDS.items()}
    safe = np.maximum(up, 0)
    tree = lambda v: _tree_sum(v, up, levels)
    t_size, t_words, t_stops, t_link, t_leaf, t_ends = (tree(v) for v in (size, words, stops, link, leaf.astype(float), ends * words))
    t_p, t_item, t_head = tree(is_["p"]), tree(is_["item"]), tree(is_["heading"])
    t_bad = tree((bad > 0) * 1.0)
    # What ancestors (the node itself too) say, top down.
    chain = {name: v.copy() for name, v in (("good", good), ("bad", bad), ("talk", talk), ("nav", is_["nav"]), ("aside", is_["aside"]), ("footer", is_["footer"]), ("header", is_["header"]), ("form", is_["form"]), ("article", is_["article"]), ("main", is_["main"]), ("list", is_["list"] + is_["item"]), ("p", is_["p"]), ("table", is_["table"]))}
    for v in chain.values():
        for at in levels[1:]:
            v[at] += v[up[at]]
    root = np.arange(n)
    for at in levels[1:]:
        root[at] = root[up[at]]
    children = np.bincount(safe[up >= 0], minlength=n).astype(np.float64)
    rank = np.zeros(n)
    order = np.lexsort((np.arange(n), up))
    fresh = np.concatenate([[True], up[order][1:] != up[order][:-1]])
    rank[order] = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    mates = children[safe]
    mean = lambda v: (np.bincount(safe[up >= 0], v[up >= 0], n) / np.maximum(children, 1))[safe]
    parent = lambda v: np.where(up >= 0, v[safe], 0)
    share = lambda a, b: a / np.maximum(b, 1)
    parent_kind = parent(kind)
    before = np.cumsum(size) - size
    columns = [
        *(is_[k] for k in KINDS), np.array(dom.level, float), depth.astype(float), np.log1p(t_size), np.log1p(t_words), share(t_link, t_size), share(t_stops, t_words), share(t_words, t_leaf), share(t_ends, t_words),
        np.log1p(t_leaf), np.log1p(t_p), np.log1p(t_item), t_head, share(t_bad, t_leaf), good, bad, talk, about, np.log1p(t_leaf[root]), np.log1p(t_size[root]), *chain.values(), children, rank, share(rank, mates), mates,
        share(t_size, t_size[root]), share(t_size, parent(t_size)), mean(np.log1p(t_size)), mean(share(t_link, t_size)), mean(share(t_stops, t_words)), mean(is_["p"]), mean(is_["item"]),
        share(before - before[root], t_size[root]), *(np.where(parent_kind == KINDS[k], 1.0, 0.0) for k in ("p", "heading", "item", "div", "body", "article", "cell")),
        np.log1p(parent(t_size)), parent(share(t_link, t_size)), parent(share(t_stops, t_words)),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Boosted:
    """Trees of equal depth; `cut`: bin limits of each feature; a node goes right if its bin is above `bin_`."""

    cut: np.ndarray
    feature: np.ndarray
    bin_: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cut)], axis=1).astype(np.uint8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.bin_, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, f[at]] > t[at])
            out += leaf[at - (2**depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, penalty: float = 2.0) -> Boosted:
    cut = np.stack([np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]) for c in x.T])
    share = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    model = Boosted(cut, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    b = model.bins(x).astype(np.int64)
    n, m = b.shape
    offset = np.arange(m) * bins
    z = np.full(n, model.base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for d in range(depth):
            first = 2**d - 1
            cell = ((at - first)[:, None] * m * bins + offset + b).ravel()
            total = 2**d * m * bins
            G, H = (np.cumsum(np.bincount(cell, np.repeat(v, m), total).reshape(2**d, m, bins), axis=2) for v in (g, h))
            gl, hl, ga, ha = G[:, :, :-1], H[:, :, :-1], G[:, :, -1:], H[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
            best = gain.reshape(2**d, -1).argmax(axis=1)
            model.feature[k, first : first + 2**d], split = best // (bins - 1), best % (bins - 1)
            model.bin_[k, first : first + 2**d] = np.where(gain.reshape(2**d, -1).max(axis=1) > 1e-9, split, 255)
            at = 2 * at + 1 + (b[np.arange(n), model.feature[k, at]] > model.bin_[k, at])
        at -= 2**depth - 1
        model.leaf[k] = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + penalty)
        z += model.leaf[k][at]
    return model


def decode(dom: Dom, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best choice in which each kept node's parent is kept (the root always is)."""
    up, depth, leaf = np.array(dom.up), np.array(dom.depth), np.array(dom.kind) == 0
    worth = np.where(leaf, odds * np.log2(1 + np.array([len(t) for t in dom.text])), odds)
    levels = _levels(depth)
    best = worth.copy()
    for at in levels[:0:-1]:
        np.add.at(best, up[at], np.maximum(best[at], 0))
    kept = np.ones(len(up), bool)
    for at in levels[1:]:
        kept[at] = kept[up[at]] & (best[at] > 0)
    return kept


#: Names of boxes around a training page's main part.
WRAPS = ("page", "layout", "container", "wrap", "site", "row")

#: Parts of training pages: which to keep.
MAIN, REST = 1, 0


def _layout(rng: np.random.Generator, runs: list[str]) -> str:
    """A page with known parts; `data-part` says what each is and is no feature."""
    pick = lambda *x: x[rng.integers(len(x))]
    text = lambda: runs[rng.integers(len(runs))]
    brief = lambda a=1, b=4: " ".join(text().split()[: rng.integers(a, b + 1)])
    line = lambda: " ".join(text().split()[: rng.integers(4, 25)])
    style = rng.integers(4)  # 0 semantic tags, 1 telling names, 2 both, 3 neither

    def box(part: int, tags: tuple[str, ...], names: tuple[str, ...], body: str) -> str:
        tag = pick(*tags) if style in (0, 2) else "div"
        name = f' {pick("class", "id")}="{pick(*names)}"' if style in (1, 2) else f' class="{pick("a1", "x-7", "box", "col", "wrap", "c3")}"' if rng.random() < 0.5 else ""
        return f'<{tag}{name} {_MARK}="{part}">{body}</{tag}>'

    def told(name: str) -> str:
        """A container's name, at times with what else the page has or lacks."""
        more = f'{pick("with", "no", "has", "without", "is")}-{pick("sidebar", "ads", "nav", "comments", "menu", "banner", "header", "widget", "promo")}'
        return pick(f"{name}-{more}", f"{name} {more}", f"{more} {name}") if rng.random() < 0.3 else name

    def menu(n: int) -> str:
        items = [f'<a href="/{i}">{brief()}</a>' for i in range(n)]
        return pick("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items))

    def prose(n: int) -> str:
        out = []
        for i in range(n):
            r = rng.random()
            body = text()
            if r < 0.2:
                w = body.split()
                k = int(rng.integers(len(w))) if w else 0
                body = " ".join([*w[:k], f'<a href="/y">{" ".join(w[k : k + 3])}</a>', *w[k + 3 :]])
            if r > 0.9:
                out.append("<ul>" + "".join(f"<li>{line()}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif r > 0.85:
                out.append(f"<h{rng.integers(2, 4)}>{brief(2, 7)}</h2>")
            elif r > 0.82:
                out.append(f"<blockquote>{pick(body, f'<p>{body}</p>')}</blockquote>")
            elif r > 0.79:
                out.append("<table>" + "".join(f"<tr><td>{brief()}</td><td>{brief(1, 8)}</td></tr>" for _ in range(rng.integers(2, 5))) + "</table>")
            else:
                out.append(pick("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>" if style == 3 else "<p>{}</p>").format(body))
        return "".join(out)

    title = f"<h1>{brief(2, 12)}</h1>" if rng.random() < 0.85 else ""
    date = f"<div>{brief(1, 4)}</div>" if rng.random() < 0.1 else ""
    inside = ""
    if rng.random() < 0.25:
        inside = box(REST, ("aside", "div"), ("ad", "advert", "promo", "sponsored", "related", "newsletter"), pick(line(), f"<p>{line()}</p>", menu(3)))
    head_in = pick(f"<header>{title}{date}</header>", title + date) if style in (0, 2) else title + date
    half = int(rng.integers(1, 5))
    main = box(MAIN, ("article", "main", "section", "article"), tuple(map(told, ("content", "article-body", "post", "entry-content", "main", "story", "wrap", "page"))), head_in + prose(half) + inside + prose(int(rng.integers(0, 10))))
    if rng.random() < 0.3:
        main = f"<div{pick('', f' class={chr(34)}{told(pick(*WRAPS))}{chr(34)}')}>{main}</div>"
    talk = ""
    if rng.random() < 0.5:
        said = "".join(pick(f"<li><b>{brief()}</b><p>{line()}</p></li>", f'<div class="comment"><p>{text()}</p></div>', f'<div class="comment"><span>{brief()}</span> {line()}</div>') for _ in range(rng.integers(1, 8)))
        talk = f'<{pick("section", "div", "ol")} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "responses comments")}" {_MARK}="0">{pick("", f"<h3>{brief(1, 3)}</h3>")}{said}</div></section></ol>'
    if rng.random() < 0.12:  # a page of little but text: one paragraph, bare text, or text right in the body beside a menu
        bare = pick(text(), f"<p>{text()}</p>", f"<p>{text()}", f"{text()}<p>{text()}</p>", f"{text()}<br><br>{text()}", f"<div>{text()}</div>", f"{title}{text()}", f"<p>{text()}</p><p>{text()}</p>")
        return f'<body {_MARK}="1">{box(REST, ("nav",), ("nav", "menu"), menu(int(rng.integers(2, 6)))) if rng.random() < 0.3 else ""}{bare}</body>'
    parts = {
        "top": box(REST, ("header", "header", "div"), ("header", "masthead", "site-header", "banner"), pick(brief(), f"<h2>{brief()}</h2>", f"<p>{line()}</p>") + (menu(5) if rng.random() < 0.4 else "")),
        "nav": box(REST, ("nav",), ("nav", "menu", "navbar", "breadcrumbs"), menu(int(rng.integers(3, 12)))),
        "ad": f'<div class="{pick("ad", "ads", "advert", "banner-ad", "sponsor", "promo")}" {_MARK}="0">{pick(line(), text(), f"<p>{text()}</p>")}</div>',
        "notice": f'<div {pick("class", "id")}="{pick("cookie-notice", "notice", "cookie-consent", "alert")}" {_MARK}="0">{pick(line(), f"<p>{line()}</p>")}<button>OK</button></div>',
        "side": box(REST, ("aside",), ("sidebar", "side", "widget", "related", "rail"), f"<h3>{brief()}</h3>" + pick(menu(5), f"<p>{line()}</p>" * 2, menu(4) + f"<p>{line()}</p>", "".join(f"<p>{text()}</p>" for _ in range(2)))),
        "form": f'<form action="/s"{pick("", " class=newsletter")} {_MARK}="0"><label>{brief()}</label><input name="q"><p>{line()}</p><button>Go</button></form>',
    }
    chance = {"top": 0.6, "nav": 0.9, "ad": 0.6, "notice": 0.4, "side": 0.5, "form": 0.35}
    used = [k for k in parts if rng.random() < chance[k]]
    ahead = [parts[k] for k in used if k in ("top", "nav") or rng.random() < 0.5]
    after = [parts[k] for k in used if parts[k] not in ahead]
    foot = box(REST, ("footer",), ("footer", "site-footer", "copyright"), pick(f"&copy; {brief()} {line()}", f"<p>{line()}</p>" + menu(4), menu(6)))
    if talk and rng.random() < 0.4:
        close = main.rfind("</", 0, len(main) - 7) if main.endswith("</div></div>") else main.rfind("</")
        main, talk = main[:close] + talk + main[close:], ""
    return f'<html><head><title>{brief()}</title><style>p{{}}</style></head><body>{"".join(ahead)}{main}{talk}{"".join(after)}{foot}</body></html>'


def _truth(dom: Dom) -> np.ndarray:
    """1 main, 0 not, -1 not known: what the nearest ancestor with a part says; elements are main if anything below is."""
    part = np.array(dom.part)
    up = np.array(dom.up)
    levels = _levels(np.array(dom.depth))
    for at in levels[1:]:
        part[at] = np.where(part[at] < 0, part[up[at]], part[at])
    for at in levels[:0:-1]:
        np.maximum.at(part, up[at], part[at])
    return part


def training_pages(pages: DataFrame, sample: int = 300, most: int = 24 << 20) -> DataFrame:
    """html of at most `sample` pages (the smallest hashes of id and url) and `most` bytes of whole pages.

    Pages of more than a sixteenth of `most` are left out.
    """
    size = F.octet_length("html").cast("bigint")
    order = F.xxhash64("page_id", "url"), "page_id", F.xxhash64("html")
    some = pages.where(size.between(1, most // 16)).select("page_id", "url", "html").orderBy(*order).limit(sample)
    so_far = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over `sample` rows
    return some.withColumn("_bytes", so_far).where(F.col("_bytes") <= most).select("html")


def fit(pages: DataFrame, sample: int = 300, layouts: int = 900, longest: int = 2000, seed: int = 2) -> Boosted:
    """A model from `layouts` made pages, of text runs of `training_pages` with at most `longest` characters, and from
    those pages themselves.  Without pages made-up words serve as text."""
    rows = training_pages(pages, sample).toArrow().column("html").to_pylist()
    own = Dom()
    for i, source in enumerate(rows):
        parse(own, i, source)
    # Where a given page says itself what is what by its tags, it is a training page too.
    mains = {p for p, k in zip(own.page, own.kind) if k in (KINDS["article"], KINDS["main"])}
    for i, (p, k) in enumerate(zip(own.page, own.kind)):
        if p in mains and own.up[i] >= 0:
            if k in (KINDS["article"], KINDS["main"]):
                own.part[i] = MAIN
            elif k in (KINDS["nav"], KINDS["footer"], KINDS["aside"], KINDS["form"], KINDS["header"]) or own.bad[i]:
                own.part[i] = REST
    runs = [t for t in own.text if 20 <= len(t) <= longest] or [" ".join("lorem ipsum dolor sit amet consectetur adipiscing elit.".split()[: 3 + i % 6]) * (1 + i % 7) for i in range(40)]
    rng = np.random.default_rng(seed)
    new = Dom()
    for i in range(layouts):
        parse(new, i, _layout(rng, [html.escape(t, quote=False) for t in (runs[j] for j in rng.integers(len(runs), size=30))]), marked=True)
    xs, ys, ws = [], [], []
    for d in (own, new):
        if not d.up:
            continue
        t = _truth(d)
        known = t >= 0
        xs.append(features(d)[known]), ys.append(t[known].astype(float))
        ws.append(np.array([0.3 + np.log1p(len(x)) / 4 for x in d.text])[known])
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    dom = Dom()
    for i, source in enumerate(sources):
        if source:
            parse(dom, i, source)
    out: list[list[str]] = [[] for _ in sources]
    if dom.up:
        kept = decode(dom, model(features(dom)))
        for i in np.flatnonzero(kept & (np.array(dom.kind) == 0)).tolist():
            out[dom.page[i]].append(dom.text[i])
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html, and html without main text, give an empty text.  Whole pages of any length are read, each on its
    own, in one pass; repeated rows and ids give equal results; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column="html", most=4 << 20):
            texts = main_texts(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`; see `extract`."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
