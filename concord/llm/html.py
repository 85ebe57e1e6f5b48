"""Main-text extraction by a tree-structured graphical model over the DOM (operator 3).

Every block element of a page is a node that is content or not. A node has a potential from its own features
(tag, words of its class, id and role, text and link volume, depth), and every parent-child edge one that depends on the kinds of the two
elements. The sum-product algorithm sends messages from the leaves to the root and back, which gives each node's exact
marginal; a node's own text is kept where content has at least half of it. Weights are learned by gradient
ascent on the likelihood of labelled pages (``concord.llm.pages``), whose gradient needs the same marginals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg math iframe noembed noframes xmp object canvas audio video".split())
NEVER = RAW | frozenset("head title noscript select option optgroup datalist textarea button dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label output".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str = ""
    depth: int = 0
    chars: int = 0  # of its own text
    linked: int = 0  # of its own text, in links
    stops: int = 0  # sentence ends in its own text
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order, parents first, and the text runs as (node, text). Broken markup is taken as browsers do, roughly."""
    nodes, runs = [Node("html", -1)], []
    open_tags: list[tuple[str, int]] = [("html", 0)]  # of inline elements too; with the node that gets their text
    at, links, hidden = 0, 0, 0

    def text(part: str) -> None:
        if part and not hidden:
            part = unescape(part) if "&" in part else part
            n = open_tags[-1][1]
            runs.append((n, part))
            size = len(part.strip())
            nodes[n].chars += size
            nodes[n].stops += part.count(".") + part.count("!") + part.count("?")
            if links:
                nodes[n].linked += size

    def close(k: int) -> None:
        nonlocal links, hidden
        while len(open_tags) > k:
            tag, _ = open_tags.pop()
            links -= tag == "a"
            hidden -= tag in NEVER
            if tag not in INLINE:
                runs.append((-1, " "))

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, rest = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and open_tags[k][0] not in INLINE:
                    break  # the end of an inline element does not close blocks
            continue
        if tag in VOID or rest.endswith("/") and tag in RAW:
            if tag not in INLINE:
                runs.append((-1, " "))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P:
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] == "p":
                    close(k)
                    break
                if open_tags[k][0] not in INLINE:
                    break
        if tag in IMPLIED:
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] in IMPLIED[tag]:
                    close(k)
                elif open_tags[k][0] in WITHIN[tag]:
                    break
        if tag == "body":
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] == "head":
                    close(k)
        if tag == "html":
            continue
        links += tag == "a"
        hidden += tag in NEVER
        owner = open_tags[-1][1]
        if tag not in INLINE:
            runs.append((-1, " "))
            nodes.append(Node(tag, owner, rest, nodes[owner].depth + 1))
            nodes[owner].children.append(len(nodes) - 1)
            owner = len(nodes) - 1
        open_tags.append((tag, owner))
    text(page[at:])
    return nodes, runs


KINDS = {t: i for i, group in enumerate(("html body", "main article", "section div center", "p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption", "ul ol dl menu", "li dt dd", "table tbody thead tfoot tr td th", "header hgroup", "footer", "nav", "aside", "form fieldset legend")) for t in group.split()}
OTHER = len(set(KINDS.values()))


def kind(tag: str) -> int:
    return KINDS.get(tag, OTHER)


@lru_cache(maxsize=20_000)
def attribute_features(raw: str) -> tuple[str, ...]:
    """Words of class, id, role and label attributes, and whether the element is hidden."""
    found = []
    for name, value in ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-component"):
            for w in WORD.findall(value):
                w = w.lower()
                found.append(f"c {w}")
                if len(w) > 4:
                    found.append(f"c4 {w[:4]}")
        elif name == "hidden" or (name == "style" and "none" in value) or (name == "aria-hidden" and value == "true"):
            found.append("hidden")
    return tuple(dict.fromkeys(found))


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of each node's features."""
    size, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        linked[nodes[i].parent] += linked[i]
    out = []
    for i, n in enumerate(nodes):
        f = ["bias", f"t {n.tag}", f"d {min(n.depth, 4)}"]
        f += attribute_features(n.attributes) if n.attributes else ()
        f.append(f"own {min(9, n.chars.bit_length())}")
        if n.chars:
            f.append(f"link {4 * n.linked // max(1, n.chars)}")
            f.append(f"stops {min(3, n.stops)}")
        if n.children and size[i]:
            f.append(f"below {kind(n.tag)} {4 * linked[i] // max(1, size[i])}")
            f.append(f"share {4 * size[i] // max(1, size[0])}")
        out.append(f)
    return out


@dataclass
class Model:
    unary: dict[str, float]
    pair: np.ndarray  # kinds of parent x of child x label of parent x of child


def edge_kind(nodes: list[Node], i: int) -> tuple[int, int]:
    return kind(nodes[nodes[i].parent].tag), kind(nodes[i].tag)


def marginals(nodes: list[Node], score: list[float], pair: list) -> tuple[list[float], list[list[float]]]:
    """Sum-product on the tree: P(content) of each node, and the four joint probabilities of each edge.

    ``score`` is a node's log potential of content against not; ``pair[parent kind][child kind]`` has the four log
    potentials of (not, not), (not, content), (content, not) and (content, content) of parent and child.
    """
    n = len(nodes)
    potential = {}
    up0, up1 = [0.0] * n, list(score)  # log of the product of what comes from below
    to0, to1, table = [0.0] * n, [0.0] * n, [None] * n
    for i in range(n - 1, 0, -1):
        kinds = edge_kind(nodes, i)
        p = potential.get(kinds)
        if p is None:
            p = potential[kinds] = [exp(x) for x in pair[kinds[0]][kinds[1]]]
        table[i] = p
        top = max(up0[i], up1[i])
        a, b = exp(up0[i] - top), exp(up1[i] - top)
        to0[i], to1[i] = log(p[0] * a + p[1] * b) + top, log(p[2] * a + p[3] * b) + top
        parent = nodes[i].parent
        up0[parent] += to0[i]
        up1[parent] += to1[i]
    all0, all1 = [0.0] * n, [0.0] * n  # log beliefs
    all0[0], all1[0] = up0[0], up1[0]
    content, joint = [0.0] * n, [[]] * n
    content[0] = 1 / (1 + exp(max(-50.0, min(50.0, all0[0] - all1[0]))))
    for i in range(1, n):
        parent, p = nodes[i].parent, table[i]
        out0, out1 = all0[parent] - to0[i], all1[parent] - to1[i]  # the parent's belief without this child
        top, below = max(out0, out1), max(up0[i], up1[i])
        a, b, c, d = exp(out0 - top), exp(out1 - top), exp(up0[i] - below), exp(up1[i] - below)
        cells = [a * p[0] * c, a * p[1] * d, b * p[2] * c, b * p[3] * d]
        total = sum(cells)
        joint[i] = [x / total for x in cells]
        content[i] = joint[i][1] + joint[i][3]
        all0[i] = up0[i] + log(p[0] * a + p[2] * b)
        all1[i] = up1[i] + log(p[1] * a + p[3] * b)
    return content, joint


def train(pages: list[tuple[list[Node], list[int]]], rounds: int = 14, rate: float = 1.0, decay: float = 3e-4) -> Model:
    """Gradient ascent (one step for each page) on the likelihood of the labels of all nodes."""
    weights: dict[str, float] = {}
    pair = np.zeros((OTHER + 1, OTHER + 1, 4))
    pair[:, :, 0] = pair[:, :, 3] = 0.5
    named = [features(nodes) for nodes, _ in pages]
    for r in range(rounds):
        step = rate / (1 + r / 4)
        for (nodes, labels), names in zip(pages, named):
            content, joint = marginals(nodes, [sum(weights.get(x, 0.0) for x in f) for f in names], pair.tolist())
            for i, f in enumerate(names):
                g = labels[i] - content[i]
                if abs(g) > 1e-4:
                    for x in f:
                        w = weights.get(x, 0.0)
                        weights[x] = w + step * (0.3 * g - decay * w)
                if i:
                    k = edge_kind(nodes, i)
                    seen = np.zeros(4)
                    seen[2 * labels[nodes[i].parent] + labels[i]] = 1
                    pair[k] += step * 0.3 * (seen - joint[i] - decay * pair[k])
    return Model(weights, pair)


def extract(page: str, model: Model) -> str:
    """The main text of a page; empty if there is none."""
    nodes, runs = parse(page)
    weights, pair = model.unary, model.pair
    score = [max(-30.0, min(30.0, sum([weights.get(x, 0.0) for x in f]))) for f in features(nodes)]
    content, _ = marginals(nodes, score, pair)
    return " ".join("".join(t for i, t in runs if i < 0 or content[i] >= 0.5).split())


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null and empty html give an empty text with 0 characters; null ids and urls and repeated rows pass through; other columns
    are not read. One pass over the scan without a shuffle; a task holds one batch of pages.
    """
    if model is None:
        from concord.llm.pages import labelled_pages

        model = train(labelled_pages())
    model = Model(model.unary, model.pair.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(h, model) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
