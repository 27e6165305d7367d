"""A small HTML tree: enough structure to align pages and read blocks of text."""

from __future__ import annotations

import html
import re

#: Elements without content, whose content is raw text, that are blocks, and that an open ``p`` ends at (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "caption", "legend", "option", "optgroup", "tbody", "tfoot", "thead", "tr"}
#: What an opening tag closes, up to the element that holds such children.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


class Node:
    """An element, or a run of text (tag ``#text``). ``shape`` stands for the tags below it, ``size`` counts them."""

    __slots__ = ("tag", "marks", "children", "text", "parent", "shape", "size", "number")

    def __init__(self, tag: str, parent: Node | None, marks: dict[str, str] | None = None, text: str = ""):
        self.tag, self.parent, self.marks, self.text = tag, parent, marks or {}, text
        self.children: list[Node] = []
        self.shape = 0
        self.size = 1
        self.number = -1


def parse(source: str) -> Node:
    """The tree of a page; markup that is never closed, or closed twice, is read as browsers mostly do."""
    root = here = Node("#root", None)
    opened: dict[str, int] = {}  # open elements by tag, so that no search goes up in vain

    def leave(upto: Node) -> Node:
        node = here
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        return node

    at, end = 0, len(source)
    match = _TOKEN.match
    while at < end:
        found = match(source, at)
        if found is None:  # a "<" that opens nothing
            here.children.append(Node("#text", here, text=source[at]))
            at += 1
            continue
        at = found.end()
        name = found.group(2)
        if name is None:
            raw = found.group()
            if raw.startswith("<!") or raw.startswith("<?"):
                if raw.startswith("<![CDATA["):
                    here.children.append(Node("#text", here, text=raw[9:].removesuffix("]]>")))
                continue
            text = html.unescape(raw) if "&" in raw else raw
            if here.children and here.children[-1].tag == "#text":
                here.children[-1].text += text
            else:
                here.children.append(Node("#text", here, text=text))
            continue
        name = name.lower()
        if found.group(1):
            if opened.get(name):
                target = here
                while target.tag != name:
                    target = target.parent
                here = leave(target.parent)
            elif name == "br":
                here.children.append(Node("br", here))
            continue
        attributes = found.group(3)
        marks = None
        if attributes and not attributes.isspace():
            marks = {k.lower(): (v or "").strip("\"'").lower() for k, v in _NAMED.findall(attributes)}
        if name in ENDS_P:
            here = leave(_close(here, opened, {"p"}, {"table", "td", "th", "button", "article", "section", "div", "blockquote", "li", "form", "body"}))
        if name in CLOSES:
            here = leave(_close(here, opened, *CLOSES[name]))
        node = Node(name, here, marks)
        here.children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = stop.end() if stop else end
        elif name not in VOID and not (attributes and attributes.endswith("/")):
            here = node
            opened[name] = opened.get(name, 0) + 1
    return root


def _close(here: Node, opened: dict[str, int], tags: set[str], walls: set[str]) -> Node:
    if not any(opened.get(t) for t in tags):
        return here
    node = here
    while node is not None and node.tag not in walls:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return here


def describe(root: Node) -> list[Node]:
    """Number the nodes in page order and work out shapes and sizes."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(order)
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.tag, node.marks.get("class"), node.marks.get("id"), *(c.shape for c in node.children)))
    return order


def plain(text: str) -> str:
    """Text with every run of white space as one space, trimmed."""
    return " ".join(text.split())
