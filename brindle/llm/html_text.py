"""Main text of web pages: gradient-boosted trees over features of DOM nodes, decoded from the root down.

Trees are trained, once a call and from a fixed seed, on generated pages of many layouts whose nodes are labelled. Each
element of a page gets the odds that main text lies in it. Decoding takes the most likely choice in which no element
is kept below a dropped one: a dynamic programme over the tree.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Where a tag may end, or a quoted value begin.
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, if it is the innermost open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SCOPE = frozenset("table td th ul ol dl div article section body html main aside nav footer header form blockquote".split())
#: What never holds main text; all else, forms too, is for the trees to decide.
NEVER = RAW | {"head", "button", "select", "input", "option", "canvas", "object", "audio", "video"}

# Words of class, id and role attributes, by what they speak for.
HINTS = {
    "good": "article content main post body entry story text prose page-content",
    "menu": "nav menu navbar breadcrumb breadcrumbs pagination pager toc tabs toolbar",
    "frame": "header footer masthead copyright colophon bottom topbar legal",
    "side": "sidebar aside related recommended widget rail popular trending more",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense",
    "notice": "cookie consent notice popup modal overlay alert gdpr newsletter subscribe signup",
    "comment": "comment comments reply replies discussion disqus respond",
    "share": "share social tags meta byline author follow",
}
_HINT = {w: i for i, ws in enumerate(HINTS.values()) for w in ws.split()}
TAGS = ["p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "ul", "li", "a", "h", "form", "table", "body", "inline"]


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    hints: tuple[int, ...] = ()
    children: list[int] = field(default_factory=list)
    #: Pieces of text (str) and children (int) in page order.
    content: list = field(default_factory=list)
    main: bool = False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Where each tag begins and ends, its name, whether it is an end tag, and its attributes, in one pass.

    Comments and declarations have no name. A quote that is never closed is a character like others; after the last
    '>' all is text. Nothing inside a raw element is a tag but its end, which comes as a nameless piece.
    """
    at, open_quote = 0, {'"': True, "'": True}
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        m = NAME.match(page, begin)
        if m is None:
            if page[begin + 1 : begin + 2] in ("!", "?"):
                end = page.find(">", begin)
                if end < 0:
                    return
                at = end + 1
                yield begin, at, "", False, ""
            else:
                at = begin + 1
            continue
        at = m.end()
        while True:
            stop = STOP.search(page, at)
            if stop is None:
                return
            at = stop.end()
            if stop[0] == ">":
                break
            if open_quote[stop[0]]:
                close = page.find(stop[0], at)
                if close < 0:
                    open_quote[stop[0]] = False
                else:
                    at = close + 1
        name, ends, rest = m[1].lower(), page[begin + 1] == "/", page[m.end() : at - 1]
        yield begin, at, name, ends, rest
        if name in RAW and not ends and not rest.endswith("/"):
            end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            begin, at = at, end.end() if end else len(page)
            yield begin, at, "", True, name


class Stack:
    """Open elements, and for each tag the places of its open ones."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.at = [0], [""], {}

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def innermost(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def close(self, place: int) -> None:
        for tag in self.tags[place:]:
            self.at[tag].pop()
        del self.nodes[place:], self.tags[place:]


def parse(page: str) -> list[Node]:
    """Elements in page order, parents first; an error-tolerant reading, in time linear in the page."""
    nodes, stack, at = [Node("root", -1, 0)], Stack(), 0

    def text(piece: str) -> None:
        if piece:
            nodes[stack.nodes[-1]].content.append(html.unescape(piece))

    for begin, end, tag, ends, rest in tags(page):
        text(page[at:begin])
        at = end
        if not tag:
            if ends:  # a raw element's content and end
                stack.close(len(stack.nodes) - 1)
            continue
        if ends:
            if place := stack.innermost([tag]):
                stack.close(place)
            continue
        if tag in ENDS_P and (place := stack.innermost(["p"])) > stack.innermost(SCOPE):
            stack.close(place)
        if tag in CLOSES and (place := stack.innermost(CLOSES[tag])) > stack.innermost(SCOPE - CLOSES[tag]):
            stack.close(place)
        hints = []
        for a in ATTRIBUTE.finditer(rest):
            if a[1].lower() in ("class", "id", "role", "itemprop", "aria-label"):
                for w in re.split(r"[^a-z]+", (a[2] or a[3] or a[4] or "").lower()):
                    if w in _HINT:
                        hints.append(_HINT[w])
        parent = stack.nodes[-1]
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, tuple(hints)))
        n = len(nodes) - 1
        nodes[parent].children.append(n)
        nodes[parent].content.append(n)
        if tag not in VOID and not rest.endswith("/"):
            stack.push(n, tag)
    text(page[at:])
    return nodes


_GOOD, _MENU, _FRAME, _SIDE, _NOTICE = (1 << list(HINTS).index(x) for x in ("good", "menu", "frame", "side", "notice"))
#: What a tag says to its descendants, as bits of HINTS.
_SAYS = {"article": _GOOD, "main": _GOOD, "nav": _MENU, "header": _FRAME, "footer": _FRAME, "aside": _SIDE, "form": _NOTICE}
_TAG = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": TAGS.index("h") for i in range(1, 7)}


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    chars, links, marks, kids, paras, words = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag in RAW:
            kids[i] += 1
        else:
            for t in x.content:
                if t.__class__ is str:
                    own = t.split()
                    chars[i] += sum(map(len, own))
                    words[i] += len(own)
                    marks[i] += t.count(". ") + t.count(", ") + t.count("! ") + t.count("? ") + (t[-1:] in ".!?")
            kids[i] += 1
            paras[i] += x.tag == "p"
            if x.tag == "a":
                links[i] = chars[i]
        up = x.parent
        if up >= 0:
            chars[up] += chars[i]
            links[up] += links[i]
            marks[up] += marks[i]
            kids[up] += kids[i]
            paras[up] += paras[i]
            words[up] += words[i]
    kinds, depth, parents, own_bits, up_bits, never = ([0] * n for _ in range(6))
    place, among = [0] * n, [1] * n
    for i, x in enumerate(nodes):
        kinds[i] = _TAG.get(x.tag, TAGS.index("inline"))
        depth[i], parents[i], never[i] = x.depth, max(x.parent, 0), x.tag in NEVER
        for h in x.hints:
            own_bits[i] |= 1 << h
        if x.parent >= 0:
            up_bits[i] = up_bits[x.parent] | own_bits[x.parent] | _SAYS.get(nodes[x.parent].tag, 0)
        for at, c in enumerate(x.children):
            place[c], among[c] = at, len(x.children)
    c, li, m, k, w, up = (np.array(v, float) for v in (chars, links, marks, kids, words, parents))
    some, total = np.maximum(c, 1), max(c[0], 1.0)
    pl, am = np.array(place, float), np.array(among, float)
    bit = np.arange(len(HINTS))
    return np.column_stack([
        np.array(kinds)[:, None] == np.arange(len(TAGS)), np.array(own_bits)[:, None] >> bit & 1, np.array(up_bits)[:, None] >> bit & 1, np.array(depth, float),
        np.log1p(c), c / total, li / some, m / np.maximum(w, 1), np.log1p(k), c / k, np.log1p(np.array(paras, float)), np.minimum(pl, 200), pl / am, np.log1p(am),
        c / np.maximum(c[up.astype(int)], 1), w / k, np.array(never, float),
    ])


class Trees:
    """Gradient boosting for two classes: depth-limited regression trees on quantile bins, Newton steps."""

    def __init__(self, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])
        p = y.mean()
        self.bias = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(coded, q - y, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._apply(tree, x)
        return self

    def _grow(self, coded, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -self.rate * total_g / (total_h + self.ridge)
        if depth == 0 or len(rows) < 20:
            return leaf
        best = (1e-6, None)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            c = coded[rows, f]
            left_g = np.cumsum(np.bincount(c, g[rows], len(cuts) + 1))[:-1]
            left_h = np.cumsum(np.bincount(c, h[rows], len(cuts) + 1))[:-1]
            gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (f, i))
        if best[1] is None:
            return leaf
        f, i = best[1]
        low = coded[rows, f] <= i
        return f, float(self.cuts[f][i]), self._grow(coded, g, h, rows[low], depth - 1), self._grow(coded, g, h, rows[~low], depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        out, under = np.empty(len(x)), x[:, f] <= cut
        out[under], out[~under] = self._apply(low, x[under]), self._apply(high, x[~under])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._apply(t, x) for t in self.trees)


def kept_nodes(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely set of kept nodes in which every kept one's parent is kept. odds: log-odds of each node."""
    gain, keep = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):
        gain[i] += odds[i]
        if i and gain[i] > 0 and nodes[i].tag not in NEVER:
            gain[nodes[i].parent] += gain[i]
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and gain[i] > 0 and nodes[i].tag not in NEVER
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """Blocks of the kept nodes' text in page order, each on its line; nothing kept is cut."""
    blocks: list[list[str]] = [[]]
    todo: list = [("in", 0)]
    while todo:
        what, i = todo.pop()
        if what == "text":
            blocks[-1].append(i)
        elif what == "break":
            blocks.append([])
        elif keep[i] or nodes[i].tag in VOID:
            x = nodes[i]
            steps: list = [("text", c) if isinstance(c, str) else ("in", c) for c in x.content]
            if x.tag in BLOCK:
                steps = [("break", 0), *steps, ("break", 0)]
            todo.extend(reversed(steps))
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


# --- training pages ------------------------------------------------------------------------------------------------

SYLLABLES = "ta ne ri so lu mi ka do pe ver an tion el or is un que ment der ich ad re con ble ing os".split()


def _prose(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
    for i in range(r.randint(4, 9), len(words), r.randint(6, 14)):
        words[i] += r.choice([".", ",", ".", "!", "***", " |"])
    return html.escape(" ".join(words).capitalize()) + r.choice([".", ".", "", "?"])


def training_page(r: random.Random) -> str:
    """A page in one of many layouts; main text is marked by data-main on the elements that hold it."""
    m = ' data-main="1"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{_prose(r, 1, 3)}</a></li>' for i in range(n))

    def paragraph() -> str:
        inner = _prose(r, 1, 120) if r.random() < 0.9 else _prose(r, 3, 30) + f' <a{m} href="/x">{_prose(r, 1, 3)}</a> ' + _prose(r, 3, 30)
        kind = r.choice(["p"] * 8 + ["blockquote", "div"])
        if r.random() < 0.15:
            inner = f"<{(b := r.choice(['b', 'em', 'span', 'strong']))}{m}>{inner}" + r.choice([f"</{b}>", "<br>"])
        return f"<{kind}{m}>{inner}" + ("" if kind == "p" and r.random() < 0.1 else f"</{kind}>")

    body = [f"<h1{m}>{_prose(r, 1, 12)}</h1>"] * (r.random() < 0.9)
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
        body.append(paragraph())
        if r.random() < 0.1:
            body.append(f"<h2{m}>{_prose(r, 1, 6)}</h2>")
        if r.random() < 0.06:
            body.append(f"<ul{m}>" + "".join(f"<li{m}>{_prose(r, 2, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        if r.random() < 0.05:
            body.append(f'<div class="{r.choice(["ad", "promo", "share", "newsletter"])}">{_prose(r, 2, 15)}</div>')
    good = r.choice(HINTS["good"].split())
    article = {0: f"<article{m}>{{}}</article>", 1: f"<main{m}>{{}}</main>", 2: f'<div class="{good}"{m}>{{}}</div>', 3: f'<div id="{good}"{m}>{{}}</div>', 4: f"<section{m}>{{}}</section>",
               5: f'<main{m}><article class="{good}"{m}>{{}}</article></main>', 6: f'<div class="wrap"{m}><div class="col-{good}"{m}>{{}}</div></div>'}[r.randint(0, 6)].format("".join(body))

    def pick(options: list[str], p: float) -> str:
        return r.choice(options) if r.random() < p else ""

    menu = pick([f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", f'<div class="menu"><ul>{links(r.randint(2, 9))}</ul></div>', f'<ul class="navbar">{links(r.randint(2, 9))}</ul>'], 0.9)
    top = pick([f"<header><div>{_prose(r, 1, 8)}</div>{menu}</header>", f'<div id="header">{_prose(r, 1, 8)}</div>{menu}', menu], 0.95)
    advert = pick([f'<div class="{c}">{_prose(r, 3, 25)}</div>' for c in ("ad", "ads", "advert", "sponsored", "promo", "banner")], 0.6)
    notice = pick([f'<div class="{c}">{_prose(r, 4, 30)}<button>ok</button></div>' for c in ("cookie", "consent", "notice", "newsletter popup")], 0.4)
    side = pick([f"<aside><h3>{_prose(r, 1, 3)}</h3><ul>{links(4)}</ul></aside>", f'<div class="sidebar"><p>{_prose(r, 5, 40)}</p></div>', f'<div class="related"><ul>{links(5)}</ul></div>'], 0.5)
    form = pick([f"<form><label>{_prose(r, 1, 4)}</label><input name=q><p>{_prose(r, 2, 12)}</p></form>"], 0.3)
    said = "".join(f'<div class="comment"><p>{_prose(r, 3, 50)}</p></div>' for _ in range(r.randint(1, 6)))
    comments = pick([f'<div class="comments">{said}</div>', f'<section id="comments"><h2>{_prose(r, 1, 2)}</h2>{said}</section>'], 0.4)
    bottom = pick([f"<footer>&copy; {_prose(r, 2, 25)}</footer>", f'<div class="footer"><p>&copy; {_prose(r, 2, 20)}</p><ul>{links(3)}</ul></div>'], 0.95)
    before, after = [advert, notice, side], [side if r.random() < 0.3 else "", form, comments]
    r.shuffle(before)
    mid = "".join(before) + article + "".join(after)
    if r.random() < 0.3:
        mid = f'<div class="{r.choice(["container", "wrapper", "row"])}"{m}>{mid}</div>'
    if r.random() < 0.15:  # one form around the whole page, as some servers write it
        mid = f'<form method="post" action="/"{m}><input type="hidden" name="state">{mid}</form>'
    return f"<!DOCTYPE html><html{m}><head><title>{_prose(r, 2, 8)}</title><script>var a='</p>';</script></head><body{m}>{top}{mid}{bottom}</body></html>"


@cache
def trained(pages: int = 400, seed: int = 7) -> Trees:
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = training_page(r)
        nodes = parse(page.replace(' data-main="1"', ""))
        tagged = _marked(page)
        assert len(nodes) == len(tagged) + 1
        xs.append(features(nodes))
        ys.append(np.array([True, *tagged]))
    return Trees().fit(np.vstack(xs), np.concatenate(ys).astype(float))


def _marked(page: str) -> list[bool]:
    """For each start tag, whether it is marked: the nodes of parse() in order."""
    return ["data-main" in rest for _, _, tag, ends, rest in tags(page) if tag and not ends]


def main_text(page: str, trees: Trees) -> str:
    nodes = parse(page)
    return text_of(nodes, kept_nodes(nodes, trees.margin(features(nodes))))


def _extract(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(h) for h in batch.column(2).to_pylist()]
            odds = trees.margin(np.vstack([features(n) for n in parsed])) if parsed else np.zeros(0)
            texts, at = [], 0
            for nodes in parsed:
                texts.append(text_of(nodes, kept_nodes(nodes, odds[at : at + len(nodes)])))
                at += len(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars. Null and empty pages have no text; null ids and repeated rows stay;
    an empty table gives none. Text outside of any tag counts as the root's and is kept."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extract(trained()), "page_id long, url string, text string, n_chars long")
