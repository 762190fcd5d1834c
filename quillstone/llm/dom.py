"""A forgiving reading of HTML into a tree of blocks.

Only elements that start a block become nodes; the text of inline elements goes to the block
around them. Scripts, styles and other elements without readable text are dropped whole, and so
are those that the page itself hides.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# fixed values: names of HTML elements
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style title textarea noscript template svg math iframe object canvas audio video noembed noframes xmp head".split())
#: Their content is plain text up to their own end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: An element that begins closes these, up to the nearest of the boundaries.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)"
    # names, each with its value if one follows; only a quote that begins a value keeps a > inside it
    r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+)*+)(?:>|\Z)",
    re.S,
)
_HIDING = re.compile(r"display\s*+:\s*+none", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")


@dataclass(slots=True)
class Node:
    """A block: its tag, attributes, parent's place in the list (-1 at the root) and own text.

    `text` holds (place in the page, piece) pairs; `linked` counts characters inside links.
    """

    tag: str
    attributes: str
    parent: int
    text: list
    linked: int = 0


def attribute(source: str, name: str) -> str:
    """The value of an attribute in the text of a tag, or nothing."""
    for m in _ATTRIBUTE.finditer(source):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return ""


def hidden(tag: str, attributes: str) -> bool:
    """Whether an element says that it is not shown. Pages that hide themselves until a script shows them are shown."""
    if tag in ("html", "body") or not ("hidden" in attributes.lower() or "display" in attributes.lower()):
        return False
    bare = _ATTRIBUTE.sub(" ", attributes).lower().replace("/", " ").split()
    return "hidden" in bare or any(m[1].lower() == "hidden" for m in _ATTRIBUTE.finditer(attributes)) or bool(_HIDING.search(attribute(attributes, "style")))


def parse(source: str) -> list[Node]:
    """The blocks of a page in page order; the first is the page itself."""
    nodes = [Node("#page", "", -1, [])]
    # open elements: (tag, node that takes text inside it, whether its text is dropped)
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
    opened: dict[str, int] = {}  # how often a tag is open
    dropped = links = 0
    at, end, order = 0, len(source), 0

    def close_top() -> None:
        nonlocal dropped, links
        tag, _, silent = stack.pop()
        opened[tag] -= 1
        dropped -= silent
        links -= tag == "a"

    def text(piece: str) -> None:
        nonlocal order
        if piece and not dropped:
            node = nodes[stack[-1][1]]
            piece = html.unescape(piece) if "&" in piece else piece
            node.text.append((order, piece))
            if links:
                node.linked += len(piece)
            order += 1

    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text(" ")
            elif opened.get(tag):
                while stack[-1][0] != tag:
                    close_top()
                close_top()
                if tag not in INLINE:
                    text(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = over.end() if over else end
            continue
        if tag == "body" and opened.get("head"):
            while stack[-1][0] != "head":
                close_top()
            close_top()
        if tag not in INLINE and tag not in DROPPED:
            if opened.get("p") and tag not in ("#page", "html", "body"):
                while stack[-1][0] != "p":
                    close_top()
                close_top()
            if tag in CLOSES:
                closes, bounds = CLOSES[tag]
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in closes or stack[k][0] in bounds or k == 0), 0)
                if stack[depth][0] in closes:
                    while len(stack) > depth:
                        close_top()
        if m[3].endswith("/") and tag in DROPPED:
            continue
        node = stack[-1][1]
        if tag not in INLINE and tag not in DROPPED:
            text(" ")
            nodes.append(Node(tag, m[3], node, []))
            node = len(nodes) - 1
        silent = tag in DROPPED or hidden(tag, m[3])
        stack.append((tag, node, silent))
        opened[tag] = opened.get(tag, 0) + 1
        dropped += silent
        links += tag == "a"
    return nodes
