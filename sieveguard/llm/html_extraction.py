"""Main text of web pages by a tree-structured graphical model over the page's elements.

A page becomes a tree of its block elements, with every run of text as a leaf. Each node is
content or not. Node potentials are the likelihoods of what is seen of a node (its tag, its class
and id words, amount of text, share of linked text) under either label; parent-child potentials
say how often a child of some kind keeps its parent's label. Sum-product messages pass from the
leaves to the root and back and give every leaf's exact marginal; leaves at 1/2 or more are the
main text. All potentials are counted on labelled pages.

Blocks are the runs of text between block elements: white space inside is one space, character
references are decoded, and blocks are joined by a line feed in page order. Comments, scripts,
styles and form controls are never text.

Null and empty pages, and pages without content, have an empty text. Broken markup is read as
far as it goes. Repeated pages are extracted alike; empty tables give empty results.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveguard.llm.common import clear_names, sized_batches, table
from sieveguard.llm.labelled_pages import LABELLED_PAGES
from sieveguard.llm.registry import query

# Tag names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title textarea noscript template svg select button iframe "
                    "object canvas audio video".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt "
                  "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main "
                  "menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
                  "caption".split())
# A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}}
# Tags of lists and tables, as usual in content as around it: only what they stand in, their
# names and their text tell.
NEUTRAL = frozenset("ul ol li dl dt dd table tbody thead tr td th".split())
SCOPES = frozenset("table ul ol dl body html article section div td th".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S)
ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden|data-y)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)
NAME_WORD = re.compile(r"[a-z]+")
SMOOTH = 0.1              # added to counts of names and tags
SMOOTH_SHAPE = 2.0        # added to counts of text amounts, which labelled pages show less well


@dataclass
class Tree:
    """Nodes in page order, parents before children; ``text`` is set at leaves."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[frozenset] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: frozenset, label: int | None,
            text: str = "", linked: float = 0.0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(label)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def attributes(raw: str) -> tuple[frozenset, int | None]:
    names, label = set(), None
    for m in ATTRIBUTE.finditer(raw):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "data-y":
            label = int(value)
        elif kind == "hidden":
            names.add("hidden")
        else:
            found = NAME_WORD.findall(value.lower())
            # A plural counts as its singular.
            names.update(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in found)
    return frozenset(names), label


def parse(page: str) -> Tree:
    """The block tree of a page."""
    tree = Tree()
    root = tree.add(-1, "#root", frozenset(), None)
    open_nodes, open_tags = [root], ["#root"]
    opened: Counter = Counter()
    run: list[str] = []
    links, in_link = 0, False
    nothing = (frozenset(), None)

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                at = open_nodes[-1]
                tree.add(at, "#text", frozenset(), tree.label[at], text,
                         min(1.0, links / len(text)))
            run.clear()
        links = 0

    def close(to: int) -> None:
        for tag in open_tags[to:]:
            opened[tag] -= 1
        del open_nodes[to:], open_tags[to:]

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            run.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK and opened[tag]:
                flush()
                close(len(open_tags) - 1 - open_tags[::-1].index(tag))
            elif tag in BLOCK:
                flush()
            continue
        if tag in SKIPPED:
            end = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            in_link = True
        elif tag == "br" or tag == "hr" or tag in ("img", "wbr"):
            run.append(" ")
        elif tag in BLOCK:
            flush()
            if opened["p"]:
                close(len(open_tags) - 1 - open_tags[::-1].index("p"))
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i] in ENDS.get(tag, ()):
                    close(i)
                    break
                if open_tags[i] in SCOPES:
                    break
            names, label = attributes(m[3]) if m[3] else nothing
            up = open_nodes[-1]
            node = tree.add(up, tag, names, tree.label[up] if label is None else label)
            if not m[3].endswith("/"):
                open_nodes.append(node)
                open_tags.append(tag)
                opened[tag] += 1
    flush()
    return tree


def amount(n: float, steps: tuple) -> int:
    return sum(n >= s for s in steps)


def shapes(tree: Tree) -> list[tuple]:
    """Of every node: amount of text below it, and share of that in links."""
    n = len(tree.parent)
    size = [float(len(t)) for t in tree.text]
    linked = [size[i] * tree.linked[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        linked[tree.parent[i]] += linked[i]
    return [(amount(s, (1, 25, 80, 300)), amount(k / s if s else 0.0, (0.05, 0.4, 0.8)))
            for s, k in zip(size, linked)]


@dataclass
class Model:
    """Log-odds of content for what is seen, and log potentials of parent and child labels."""

    tags: dict[str, float]
    names: dict[str, float]
    text: dict[tuple, float]
    prior: float
    pairs: dict[str, tuple]
    any_pair: tuple


def child_kind(tag: str) -> str:
    return tag if tag in ("#text", "p", "li", "h1", "h2", "h3", "td", "tr") else "other"


def train(pages: list[str]) -> Model:
    """Count potentials on pages whose elements carry ``data-y``; few pages, held by the driver."""
    tags, names, text = ({0: Counter(), 1: Counter()} for _ in range(3))
    pairs: dict[str, Counter] = {}
    totals: Counter = Counter()
    for page in pages:
        tree = parse(page)
        # An element without a label of its own takes that of the most text below it.
        votes = [[0, 0] for _ in tree.parent]
        for i in range(len(tree.parent) - 1, -1, -1):
            if tree.tag[i] == "#text" and tree.label[i] is not None:
                votes[i][tree.label[i]] += len(tree.text[i])
            if i:
                for y in (0, 1):
                    votes[tree.parent[i]][y] += votes[i][y]
        y = [int(v[1] > v[0]) if tree.label[i] is None else tree.label[i]
             for i, v in enumerate(votes)]
        for i, shape in enumerate(shapes(tree)):
            totals[y[i]] += 1
            if tree.tag[i] not in NEUTRAL:
                tags[y[i]][tree.tag[i]] += 1
            # Names speak for the element that bears them where the page's label changes.
            names[y[i]].update(tree.names[i])
            if tree.tag[i] == "#text":
                text[y[i]][shape] += 1
            if i:
                kind = child_kind(tree.tag[i])
                pairs.setdefault(kind, Counter())[y[tree.parent[i]], y[i]] += 1
    odds = totals[1] / totals[0]

    def ratios(counts: dict, smooth: float) -> dict:
        seen = counts[0].keys() | counts[1].keys()
        whole = [sum(counts[v].values()) + smooth * len(seen) for v in (0, 1)]
        return {k: math.log((counts[1][k] + smooth) / whole[1] * whole[0] / (counts[0][k] + smooth))
                for k in seen}

    # How often a name is borne by content, against how often any element is content.
    named = {k: math.log((names[1][k] + SMOOTH) / (names[0][k] + SMOOTH) / odds)
             for k in names[0].keys() | names[1].keys()}

    def logs(c: Counter) -> tuple:
        rows = [[c[a, b] + SMOOTH for b in (0, 1)] for a in (0, 1)]
        return tuple(tuple(math.log(v / sum(r)) for v in r) for r in rows)

    every = sum(pairs.values(), Counter())
    return Model(ratios(tags, SMOOTH), named, ratios(text, SMOOTH_SHAPE), math.log(odds),
                 {k: logs(c) for k, c in pairs.items()}, logs(every))


def add_logs(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def marginals(model: Model, tree: Tree) -> list[float]:
    """Probability of content of every node, by sum-product up and down the tree."""
    n = len(tree.parent)
    parent = tree.parent
    local = [0.0] * n     # log-odds of the node's own evidence
    for i, shape in enumerate(shapes(tree)):
        v = model.tags.get(tree.tag[i], 0.0)
        for name in tree.names[i]:
            v += model.names.get(name, 0.0)
        if tree.tag[i] == "#text":
            v += model.text.get(shape, 0.0)
        local[i] = v
    up = local[:]         # evidence below and at the node, as log-odds
    message = [0.0] * n   # from the node to its parent
    pair = [model.pairs.get(child_kind(t), model.any_pair) for t in tree.tag]
    for i in range(n - 1, 0, -1):
        p = pair[i]
        message[i] = (add_logs(p[1][0], p[1][1] + up[i]) - add_logs(p[0][0], p[0][1] + up[i]))
        up[parent[i]] += message[i]
    belief = up[:]
    belief[0] += model.prior
    for i in range(1, n):
        p, above = pair[i], belief[parent[i]] - message[i]
        down = (add_logs(p[0][1], p[1][1] + above) - add_logs(p[0][0], p[1][0] + above))
        belief[i] = up[i] + down
    return [1 / (1 + math.exp(-max(-700.0, min(700.0, b)))) for b in belief]


def main_blocks(model: Model, page: str | None) -> list[tuple[str, float]]:
    """(text, probability of content) of every block of a page, in page order."""
    if not page:
        return []
    tree = parse(page)
    chance = marginals(model, tree)
    return [(t, chance[i]) for i, t in enumerate(tree.text) if tree.tag[i] == "#text"]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` without ``html``, with ``text``, ``n_chars``, ``n_blocks`` and ``n_kept``."""
    clear_names(pages, ["text", "n_chars", "n_blocks", "n_kept"])
    shared = pages.sparkSession.sparkContext.broadcast(model or train(LABELLED_PAGES))
    rest = [c for c in pages.columns if c != "html"]
    slim = pages.select(*rest, "html")
    schema = slim.drop("html").withColumns({
        "text": F.lit(""), "n_chars": F.lit(0).cast("long"), "n_blocks": F.lit(0),
        "n_kept": F.lit(0)}).schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "html"):
            texts, blocks, kept = [], [], []
            for page in batch.column(batch.num_columns - 1).to_pylist():
                found = main_blocks(shared.value, page)
                good = [t for t, chance in found if chance >= 0.5]
                texts.append("\n".join(good))
                blocks.append(len(found))
                kept.append(len(good))
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(texts, pa.string()),
                                      pa.array([len(t) for t in texts], pa.int64()),
                                      pa.array(blocks, pa.int32()), pa.array(kept, pa.int32())],
                names=schema.names)

    return slim.mapInArrow(compute, schema)


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars", "n_blocks", "n_kept")
