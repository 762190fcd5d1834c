"""Main text of web pages by a tree-structured graphical model.

Each block of a page is a node with two states, content or not. A node has a potential from what
it looks like (tag, words of its class, id and role, length, links, punctuation); each edge has a
potential for the states of parent and child, by the kind of the child. Sum-product messages pass
upward from the leaves and downward from the root, once each, and give every node's exact
probability of being content. The weights are fitted on labelled pages by gradient ascent on the
likelihood, whose gradient is observed minus expected counts under the same messages.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import dom
from .labelled_pages import KNOWN, labelled_pages
from .shared import slices

# fixed values: kinds of elements
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address summary".split())
SECTIONS = frozenset("article main nav aside header footer form section".split())
PAGE = frozenset(("#page", "html", "body"))
_WORD = re.compile(r"[a-z]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names(node: dom.Node) -> set[str]:
    """The words of a node's class, id and role that sites give their parts; generated names say nothing."""
    found: set[str] = set()
    if node.attributes:
        for name in ("class", "id", "role"):
            if name in node.attributes.lower():
                found.update(_WORD.findall(_SPLIT_CASE.sub(" ", dom.attribute(node.attributes, name)).lower()))
    return found & KNOWN


def describe(node: dom.Node, said: set[str]) -> list[str]:
    """Names of the features of a node that has these names."""
    found = [f"tag={node.tag}"]
    found += [f"named={w}" for w in said] if said else [f"bare={node.tag}"]
    own = "".join([t for _, t in node.text])
    n = len(own.strip())
    if n:
        found.append(f"length={sum(n >= k for k in (25, 80, 250))}")
        if node.tag in PAGE:  # text of the page itself, in no element
            found.append(f"loose={sum(n >= k for k in (25, 80))}")
        found.append(f"links={sum(node.linked > k * n for k in (0.0, 0.3, 0.7))}")
        stops = own.count(". ") + own.count(", ") + (own.rstrip()[-1:] in ".!?")
        found.append(f"stops={sum(stops >= k for k in (1, 2, 5))}")
        if "©" in own:
            found.append("copyright")
    return found


def insides(nodes: list[dom.Node]) -> list[list[str]]:
    """For each node names for how much text its subtree holds, how much of that is links, and how much stands in the node and its paragraphs."""
    size, linked, near = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
        own = sum(len(t.strip()) for _, t in nodes[i].text)
        size[i] += own
        near[i] += max(0, own - nodes[i].linked)
        if nodes[i].parent >= 0 and nodes[i].tag in TEXTUAL:
            near[nodes[i].parent] += max(0, own - nodes[i].linked)
        linked[i] += nodes[i].linked
        if nodes[i].parent >= 0:
            size[nodes[i].parent] += size[i]
            linked[nodes[i].parent] += linked[i]
    whole = max(1, size[0]) if nodes else 1
    return [
        [
            f"inside={sum(n >= k for k in (1, 40, 150, 600))}",
            f"inlinks={sum(m > k * n for k in (0.0, 0.3, 0.7))}",
            f"share={sum(n > k * whole for k in (0.02, 0.1, 0.3, 0.6))}",
            f"near={'page' if node.tag in PAGE else ''}{sum(h >= k for k in (1, 80, 250))}",
        ]
        for node, n, m, h in zip(nodes, size, linked, near, strict=True)
    ]


#: Kinds of children that edges tell apart.
KINDS = 4


def kind(node: dom.Node, said: set[str]) -> int:
    return 0 if node.tag in TEXTUAL else 1 if node.tag in SECTIONS else 2 + bool(said)


@dataclass
class Forest:
    """Trees of many pages in one set of arrays; a parent comes before its children."""

    features: np.ndarray  # feature numbers of all nodes, end to end
    owner: np.ndarray  # the node that has each of them
    parent: np.ndarray
    kinds: np.ndarray
    levels: list[np.ndarray]  # nodes by depth


def forest(pages: list[list[dom.Node]], number: dict[str, int], learn: bool = False) -> Forest:
    """Lay pages out; with `learn`, names of features get numbers, else unknown names are left out."""
    features, owner, parent, kinds, depth, base = [], [], [], [], [], 0
    for nodes in pages:
        whole = insides(nodes)
        for i, node in enumerate(nodes):
            said = names(node)
            for name in describe(node, said) + whole[i]:
                k = number.setdefault(name, len(number)) if learn else number.get(name)
                if k is not None:
                    features.append(k)
                    owner.append(base + i)
            parent.append(base + node.parent if node.parent >= 0 else -1)
            kinds.append(kind(node, said))
            depth.append(depth[parent[-1]] + 1 if node.parent >= 0 else 0)
        base += len(nodes)
    depths = np.array(depth, np.int64)
    order = np.argsort(depths, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depths))[:-1]) if len(depths) else []
    return Forest(*(np.array(x, np.int64) for x in (features, owner, parent, kinds)), levels)


@dataclass
class Model:
    """Weights: of features for state 1 against 0, and of (kind of child, parent's state, child's state)."""

    number: dict[str, int]
    unary: np.ndarray
    edge: np.ndarray

    def beliefs(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all nodes [node, state] and of their edges to parents [node, parent's state, state]."""
        n = len(f.parent)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(f.owner, self.unary[f.features], n)
        edge = self.edge[f.kinds]
        inside, up = local.copy(), np.zeros((n, 2))
        for level in reversed(f.levels[1:]):  # upward: a child tells its parent what its subtree thinks
            up[level] = np.logaddexp.reduce(edge[level] + inside[level][:, None, :], axis=2)
            for s in (0, 1):
                np.add.at(inside[:, s], f.parent[level], up[level, s])
        outside, both = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in f.levels[1:]:  # downward: a parent answers without what it heard from this child
            above = f.parent[level]
            cavity = outside[above] + inside[above] - up[level]
            joint = cavity[:, :, None] + edge[level] + inside[level][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
            outside[level] = np.logaddexp.reduce(edge[level] + cavity[:, :, None], axis=1)
            outside[level] -= outside[level].max(axis=1, keepdims=True)
        total = inside + outside
        own = np.exp(total - total.max(axis=1, keepdims=True)) if n else total
        return own / own.sum(axis=1, keepdims=True), both


def fit(pages: list[tuple[list[dom.Node], list[int]]], rounds: int = 250, ridge: float = 0.5) -> Model:
    """Weights for labelled pages (nodes, and 1 for each that is content)."""
    number: dict[str, int] = {}
    f = forest([nodes for nodes, _ in pages], number, learn=True)
    y = np.array([v for _, labels in pages for v in labels])
    model = Model(number, np.zeros(len(number)), np.zeros((KINDS, 2, 2)))
    inner = np.flatnonzero(f.parent >= 0)
    seen_unary = np.bincount(f.features, y[f.owner], len(number))
    seen_edge = np.zeros((KINDS, 2, 2))
    np.add.at(seen_edge, (f.kinds[inner], y[f.parent[inner]], y[inner]), 1)
    scale, memory = 1 / np.sqrt(len(y)), [np.zeros(len(number)), np.zeros((KINDS, 2, 2))]
    for _ in range(rounds):  # steps of their own size for each weight, from the squares of past gradients
        own, both = model.beliefs(f)
        gradients = [
            seen_unary - np.bincount(f.features, own[f.owner, 1], len(number)) - ridge * model.unary,
            seen_edge - np.stack([both[inner][f.kinds[inner] == k].sum(axis=0) for k in range(KINDS)]) - ridge * model.edge,
        ]
        for weights, g, m in zip((model.unary, model.edge), gradients, memory, strict=True):
            m += np.square(g * scale)
            weights += 0.5 * g * scale / np.sqrt(m + 1e-8)
    return model


@functools.cache
def default_model(pages: int = 640, seed: int = 1) -> Model:
    """The model fitted on the package's own labelled pages."""
    return fit(labelled_pages(pages, seed))


def main_texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page: blocks more likely content than not, in page order."""
    pages = [dom.parse(s) for s in sources]
    own, _ = model.beliefs(forest(pages, model.number))
    out, base = [], 0
    for nodes in pages:
        kept = [piece for i, node in enumerate(nodes) if node.text and own[base + i, 1] > 0.5 for piece in node.text]
        kept.sort(key=lambda p: p[0])
        blocks, last = [], None
        for place, piece in kept:
            # pieces that follow each other in the page belong to one run; others are apart
            blocks.append(piece if last is None or place == last + 1 else " " + piece)
            last = place
        out.append(" ".join("".join(blocks).split()))
        base += len(nodes)
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points).

    One pass without a shuffle. White space inside a block, Unicode's included, becomes one space;
    blocks are joined in page order by one space. Elements that are hidden by attribute or style are not read. A null or empty page has an empty text; a page
    without tags is one block of its own and is judged like any other; broken markup is read as
    browsers would, without failing. Nulls in page_id and url stay; repeated rows each keep their
    row; an empty table gives no rows; other columns are not read.
    """
    model = model or default_model()

    def run(batches):
        for b in slices(batches, "html"):
            texts = main_texts([h or "" for h in b.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
