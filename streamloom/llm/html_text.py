"""Main text of web pages by belief propagation over the DOM.

Every block element is a binary variable: content or not.  Node potentials come from a logistic model of
the element's own features, edge potentials from how labels of parent and child go together; both are
learned from labelled pages.  The DOM is a tree, so one pass of sum-product messages from the leaves up
and one down gives the exact marginals.  Text is taken from the blocks whose marginal favours content.

Labelled pages come from ``labelled_pages``, which composes pages of many layouts whose labels are known
by construction; any other list of (html, label of each marked element) pairs will do.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Element kinds of the HTML standard that matter to the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
#: What the start of an element ends, and what that may not reach beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: Words in class, id and role that hint at an element's part.
HINTS = {
    "content": "article content main post entry story body text page paragraph prose maintext longform",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs toc tabs pager pagination skip",
    "header": "header masthead top logo branding topbar banner hero sitename",
    "footer": "footer bottom copyright legal colophon imprint foot",
    "side": "sidebar side aside widget rail related recommended popular trending more teaser widgets",
    "advert": "ad ads advert advertisement adbox sponsor sponsored promo promotion adsense banner-ad dfp outbrain commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner subscribe newsletter paywall message",
    "form": "form search login signup register subscribe input contact",
    "comment": "comment comments reply replies discussion disqus respond commentlist thread reader responses",
    "share": "share social sharing follow tags meta byline toolbar buttons",
}
_HINT = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
_TAGS = "article main section div p li ul ol nav header footer aside form table td h1 h2 h3 blockquote pre figure body".split()
_TAG = {t: i for i, t in enumerate(_TAGS)}
_AROUND = "article main section nav header footer aside form".split()
FEATURES = len(_TAGS) + 1 + len(HINTS) + 15 + len(_AROUND) + len(HINTS)
#: Where a tag, comment or declaration starts; any other "<" is text.
_OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
#: What follows within a tag: a quoted value (quotes count only after "="), or the tag's end.
_WITHIN = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')|>")
#: Of the raw elements, those that hold mere text up to their end tag or the page's end.
_UNENDED = frozenset("script style textarea title iframe".split())
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|data-part)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
_NAME = re.compile(r"[A-Za-z]+")
SEED = 11


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: int
    depth: int
    pieces: list[tuple[int, str]] = field(default_factory=list)  # (place on the page, text)
    linked: int = 0  # characters within links


def parse(page: str) -> list[Node]:
    """The block elements of a page in document order; inline markup is folded into its block.

    Unclosed elements end with what encloses them; a block start ends an open paragraph; end tags of
    nothing open are passed over.  A text cut off in a tag or comment ends there.  Time is linear in the
    page's length, whatever quotes or brackets stand open.
    """
    nodes = [Node("html", {}, -1, 0)]
    stack = [0]
    links = 0
    at, place, end = 0, 0, len(page)

    def text(a: int, b: int) -> None:
        nonlocal place
        if b > a:
            piece = html.unescape(page[a:b])
            node = nodes[stack[-1]]
            node.pieces.append((place, piece))
            place += 1
            if links:
                node.linked += len(piece)

    never: set[str] = set()
    opened: dict[str, int] = {}  # open elements by tag, so that stray end tags cost nothing

    def close(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag] -= 1
        del stack[k:]

    while at < end:
        m = _OPENS.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        if m[1]:
            stop = page.find("-->", m.end())
            at = stop + 3 if stop >= 0 else end
            continue
        if m[2]:
            stop = page.find(">", m.end())
            at = stop + 1 if stop >= 0 else end
            continue
        to = m.end()
        while (inner := _WITHIN.search(page, to)) and inner[0] != ">":
            to = inner.end()
        if inner is None:  # a tag that never ends is no text
            break
        at = inner.end()
        closing, tag, rest = m[3], m[4].lower(), page[m.end() : inner.start()]
        if not closing:
            if tag in RAW:
                if tag in never:
                    continue
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop is None and tag not in _UNENDED:
                    never.add(tag)  # no end tag from here on: only the start tag is passed over
                    continue
                at = stop.end() if stop else end
                continue
            if tag == "br" or tag == "hr" or tag == "img":
                nodes[stack[-1]].pieces.append((place, " "))
                place += 1
                continue
            if tag in VOID:
                continue
            if tag == "a":
                links += not links
                continue
            if tag not in BLOCK or tag in ("html", "head") or rest.rstrip().endswith("/"):
                continue
            if nodes[stack[-1]].tag == "p":
                close(len(stack) - 1)
            if tag in CLOSES and any(opened.get(x) for x in CLOSES[tag][0]):
                ends, stops = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag in stops:
                        break
                    if nodes[stack[k]].tag in ends:
                        close(k)
                        break
            elif tag[0] == "h" and tag[1:].isdigit() and re.fullmatch(r"h[1-6]", nodes[stack[-1]].tag) and len(stack) > 1:
                close(len(stack) - 1)
            links = 0
            attributes = {a[0].lower(): a[1] or a[2] or a[3] or "" for a in _ATTRIBUTE.findall(rest)}
            nodes.append(Node(tag, attributes, stack[-1], len(stack)))
            stack.append(len(nodes) - 1)
            opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            links = 0
        elif tag in BLOCK and tag not in ("html", "body", "head") and opened.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features for each node."""
    n = len(nodes)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    own = np.array([sum(len(p[1].strip()) for p in x.pieces) for x in nodes], dtype=np.float64)
    linked = np.array([x.linked for x in nodes], dtype=np.float64)
    commas = np.array([sum(p[1].count(",") + p[1].count(".") for p in x.pieces) for x in nodes], dtype=np.float64)
    total, total_linked = own.copy(), linked.copy()
    children = np.zeros(n)
    for i in range(n - 1, 0, -1):
        total[nodes[i].parent] += total[i]
        total_linked[nodes[i].parent] += total_linked[i]
        children[nodes[i].parent] += 1
    base = len(_TAGS) + 1
    for i, x in enumerate(nodes):
        out[i, _TAG.get(x.tag, len(_TAGS))] = 1
        for name in _NAME.findall(" ".join(x.attributes.get(a, "") for a in ("class", "id", "role")).lower()):
            if name in _HINT:
                out[i, base + _HINT[name]] = 1
    rest = base + len(HINTS)
    whole = max(1.0, total[0])
    out[:, rest] = 1
    out[:, rest + 1] = np.log1p(own) / 6
    out[:, rest + 2] = np.log1p(total) / 8
    out[:, rest + 3] = linked / np.maximum(own, 1)
    out[:, rest + 4] = total_linked / np.maximum(total, 1)
    out[:, rest + 5] = np.minimum(commas / np.maximum(own, 1) * 20, 2)
    out[:, rest + 6] = total / whole
    out[:, rest + 7] = np.log1p(children) / 3
    out[:, rest + 8] = [("hidden" in x.attributes) or x.attributes.get("aria-hidden") == "true" for x in nodes]
    out[:, rest + 9] = own < 25
    # its place among its siblings and their parent
    parent = np.array([max(0, x.parent) for x in nodes])
    plain = np.maximum(own - linked, 0)
    beside = np.zeros(n)
    np.add.at(beside, parent[1:], plain[1:])
    out[:, rest + 10] = np.log1p(plain) / 6
    out[:, rest + 11] = np.log1p(np.maximum(beside[parent] - plain, 0)) / 8
    out[:, rest + 12] = total_linked[parent] / np.maximum(total[parent], 1)
    out[:, rest + 13] = own > 120
    out[:, rest + 14] = total[parent] / whole
    # what the element stands in: sectioning elements and hints of itself and all around it
    around = rest + 15
    for i, x in enumerate(nodes):
        if i:
            out[i, around:] = out[x.parent, around:]
        if x.tag in _AROUND:
            out[i, around + _AROUND.index(x.tag)] = 1
        out[i, around + len(_AROUND) :] = np.maximum(out[i, around + len(_AROUND) :], out[i, base:rest])
    return out


@dataclass
class Model:
    """Node weights, and the log potential of (parent label, child label) for blocks that hold text or not."""

    weights: np.ndarray
    edge: np.ndarray

    def marginals(self, nodes: list[Node], scores: np.ndarray) -> np.ndarray:
        """P(content) of each node: sum-product up the tree, then down."""
        n = len(nodes)
        unary = np.zeros((n, 2))
        unary[:, 1] = scores
        up = unary.copy()  # log belief of a node from itself and its subtree
        sent = np.zeros((n, 2))  # log message to the parent
        edge = self.edge
        for i in range(n - 1, 0, -1):
            a = edge[0] + up[i]
            b = edge[1] + up[i]
            sent[i, 0] = np.logaddexp(a[0], a[1])
            sent[i, 1] = np.logaddexp(b[0], b[1])
            up[nodes[i].parent] += sent[i]
        belief = up.copy()
        for i in range(1, n):
            rest = belief[nodes[i].parent] - sent[i]  # what the parent knows without this child
            belief[i, 0] += np.logaddexp(rest[0] + edge[0, 0], rest[1] + edge[1, 0])
            belief[i, 1] += np.logaddexp(rest[0] + edge[0, 1], rest[1] + edge[1, 1])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))

    def text(self, page: str) -> str:
        """Text of the content blocks in page order, joined by two newlines."""
        nodes = parse(page)
        chance = self.marginals(nodes, features(nodes) @ self.weights)
        return "\n\n".join(blocks(nodes, chance > 0.5))


def blocks(nodes: list[Node], chosen) -> list[str]:
    """Texts of the chosen blocks in page order; a block that a child interrupts comes in parts."""
    pieces = sorted((place, i, piece) for i, x in enumerate(nodes) for place, piece in x.pieces)
    out: list[str] = []
    held: list[str] = []
    last = -1
    marks = [*pieces, (0, -2, "")]
    for _, i, piece in marks:
        if i != last and held:
            joined = " ".join("".join(held).split())
            if joined and chosen[last]:
                out.append(joined)
            held = []
        held.append(piece)
        last = i
    return out


def train(pages: list[tuple[list[Node], np.ndarray]], rounds: int = 400, decay: float = 1e-3) -> Model:
    """Fit node weights by logistic regression and edge potentials by smoothed label counts.

    ``pages``: parsed pages with a label of 0 or 1 for each node.
    """
    x = np.concatenate([features(n) for n, _ in pages]).astype(np.float64)
    y = np.concatenate([labels for _, labels in pages]).astype(np.float64)
    weights = np.zeros(FEATURES)
    for _ in range(rounds // 20):  # Newton steps: few features, so the normal equations are small
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + decay * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(FEATURES)
        weights -= np.linalg.solve(curve, gradient)
    counts = np.ones((2, 2))
    for nodes, labels in pages:
        for i in range(1, len(nodes)):
            counts[int(labels[nodes[i].parent]), int(labels[i])] += 1
    share = counts / counts.sum()
    edge = np.log(share / share.sum(axis=1, keepdims=True) / share.sum(axis=0, keepdims=True))
    return Model(weights, edge)


# ------------------------------------------------------------------ labelled pages


def labelled_pages(n: int = 900, seed: int = SEED) -> list[tuple[list[Node], np.ndarray]]:
    """Pages of many layouts with a label for each block: 1 within the article, 0 elsewhere.

    Elements of the article carry ``data-part="1"``, which only the labels read.
    """
    made = []
    rng = random.Random(seed)
    for _ in range(n):
        nodes = parse(_page(rng))
        labels = np.array([x.attributes.get("data-part") == "1" for x in nodes], dtype=np.int64)
        made.append((nodes, labels))
    return made


def _words(rng: random.Random, n: int) -> str:
    word = lambda: "".join(rng.choice("aeiou bcdfglmnprst".replace(" ", "")) for _ in range(rng.randint(2, 9)))
    out = [word() for _ in range(n)]
    for i in range(0, n, rng.randint(6, 14)):
        out[i] = out[i].capitalize()
        if i:
            out[i - 1] += rng.choice([".", ".", ",", "!"])
    return " ".join(out) + "."


def _page(rng: random.Random) -> str:
    def named(kind: str) -> str:
        if rng.random() < 0.15:
            return ""
        name = rng.choice(HINTS[kind].split())
        name = rng.choice([name, f"{name}-{rng.choice(['box', 'wrap', 'area', 'x1'])}", f"site-{name}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def links(n: int) -> str:
        items = [f'<a href="#">{_words(rng, rng.randint(1, 4))}</a>' for _ in range(n)]
        style = rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" | ", " "]).join(items)

    def prose(n: int) -> str:
        """Words with inline markup and links here and there."""
        out = _words(rng, n)
        kind = rng.random()
        if kind < 0.12:
            return f'{out} <a href="#">{_words(rng, rng.randint(1, 4))}</a> {_words(rng, rng.randint(1, 12))}'
        return f"<b>{out}</b>" if kind < 0.16 else f"{out}<br>{_words(rng, 5)}" if kind < 0.2 else out

    def paragraphs(n: int, mark: str = "", least: int = 2, most: int = 90) -> str:
        open_ended = rng.random() < 0.2
        return "".join(f"<p{mark}>{prose(rng.randint(least, most))}" + ("" if open_ended else "</p>") for _ in range(n))

    def part(kind: str) -> str:
        if kind == "menu":
            tag = rng.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{named(kind)}>{links(rng.randint(3, 9))}</{tag}>"
        if kind == "header":
            tag = rng.choice(["header", "div"])
            hint = named(kind) or ' class="header"' if tag == "div" else named(kind)
            return f"<{tag}{hint}>{rng.choice(['<h1>', '<div>', '<p>', ''])}{_words(rng, rng.randint(1, 6))}</{tag}>"
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            hint = named(kind) or ' class="footer"' if tag == "div" else named(kind)
            inner = rng.choice([f"&copy; {_words(rng, rng.randint(2, 14))}", paragraphs(rng.randint(1, 2), "", 2, 25), links(4)])
            return f"<{tag}{hint}>{inner}</{tag}>"
        if kind == "side":
            tag = rng.choice(["aside", "aside", "div", "section"])
            hint = named(kind) or ' class="sidebar"' if tag != "aside" else named(kind)
            return f"<{tag}{hint}><h3>{_words(rng, 2)}</h3>{rng.choice([links(5), paragraphs(rng.randint(1, 2), '', 4, 40)])}</{tag}>"
        if kind == "form":
            return f"<form{named(kind)}><p>{_words(rng, rng.randint(2, 12))}</p><label>{_words(rng, 2)}</label><input type=text><button>{_words(rng, 1)}</button></form>"
        if kind == "comment":
            tag = rng.choice(["div", "section", "ol"])
            item = rng.choice(["div", "li", "p", "div", "li", "p", "article"])
            hint = named(kind) or ' class="comments"'
            inner = "".join(f"<{item} class=\"{rng.choice(['comment', 'reply', 'comment-body'])}\">{rng.choice(['', '<p>'])}{_words(rng, rng.randint(4, 60))}</{item}>" for _ in range(rng.randint(1, 5)))
            return f"<{tag}{hint}>{rng.choice(['', f'<h3>{_words(rng, 2)}</h3>'])}{inner}</{tag}>"
        hint = named(kind) or f' class="{HINTS[kind].split()[0]}"'
        return f"<div{hint}>{rng.choice(['', '<p>'])}{_words(rng, rng.randint(3, 30))}</div>"

    mark = ' data-part="1"'
    body = [f"<h1{mark}>{_words(rng, rng.randint(2, 14))}</h1>"] if rng.random() < 0.7 else []
    least, most = rng.choice([(2, 12), (2, 40), (2, 90), (20, 90), (40, 120), (60, 250)])
    shell = rng.choice(["article", "article", "main", "div", "div", "section", "body", "body"])
    bare = shell == "body"  # the article's blocks stand among the page's other parts
    for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
        kind = rng.random()
        if kind < 0.74:
            body.append(paragraphs(1, mark, max(least, 15 if bare else 0), max(most, 30 if bare else 0)))
        elif kind < 0.82:
            body.append(f"<h2{mark}>{_words(rng, rng.randint(1, 8))}</h2>")
        elif kind < 0.88:
            body.append(f"<blockquote{mark}>{prose(rng.randint(5, 40))}</blockquote>")
        elif kind < 0.94:
            linked = rng.random() < 0.3
            items = [_words(rng, rng.randint(2, 25)) for _ in range(rng.randint(1, 5))]
            items = [f'<a href="#">{x}</a> {_words(rng, rng.randint(2, 12))}' if linked else x for x in items]
            body.append(f"<ul{mark}>" + "".join(f"<li{mark}>{x}</li>" for x in items) + "</ul>")
        else:
            body.append(f"<table{mark}><tr{mark}><td{mark}>{_words(rng, 3)}</td><td{mark}>{_words(rng, 4)}</td></tr></table>")
    if not any("<p" in x or "<block" in x for x in body):
        body.append(paragraphs(1, mark, max(least, 15 if bare else 0), max(most, 30 if bare else 0)))
    if rng.random() < 0.25:  # an advert or a share bar among the paragraphs
        body.insert(rng.randint(1, len(body)), part(rng.choice(["advert", "share", "notice", "side"])))
    if rng.random() < 0.2:
        body.append(f"<footer>{_words(rng, rng.randint(2, 14))}</footer>")
    inner = "".join(body)
    hinted = rng.random() < 0.5
    for _ in range(0 if bare else rng.choice([0, 0, 0, 1, 1, 2, 3])):
        inner = f"<div{named('content') if hinted else ''}{mark}>{inner}</div>"
    hint = named("content") if hinted else ""
    article = inner if bare else f"<{shell}{hint}{mark}>{inner}</{shell}>"
    before = [part(k) for k in ("notice", "header", "menu", "advert", "form") if rng.random() < 0.45]
    after = [part(k) for k in ("share", "comment", "side", "advert", "form", "menu", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    page = "".join([*before, article, *after])
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        page = f"<div{rng.choice(['', ' id=\"page\"', ' class=\"wrapper\"', ' id=\"wrap\"', ' class=\"container\"'])}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"


def extract(df: DataFrame, model: Model | None = None, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars of every whole page; a row for each row of ``df``, no shuffle.

    Character references are decoded; white space within a block becomes one space and its ends are
    trimmed; blocks are joined in page order by two newlines.  Null or empty pages and pages without
    content have the empty text; broken markup is read as far as it goes, in time linear in the page;
    repeated rows each get a row, an empty table none; columns named text or n_chars in ``df`` do not matter.
    The model is a few dozen numbers, trained on the driver unless given.
    """
    common.ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))
    source = df.select(*keep, df[page].alias("_page"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in common.slices(column):
                texts = [own.text(x) if x else "" for x in column.slice(a, b - a).to_pylist()]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)], *made], [*batch.schema.names[:-1], "text", "n_chars"])

    return source.mapInArrow(run, kept + "text string, n_chars long")
