"""A small tolerant HTML reader: block elements as a tree, with the text runs they hold in page order.

Text that stands beside block elements, or directly in the page or its body, has a node of its own (``#text``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"']++)*+|[^>]*+)>""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*+)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "xmp"}
UNSEEN = {"head", "template", "svg", "select", "button", "map", "datalist", "annotation", "annotation-xml"}
HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
FALLBACK = {"audio", "canvas", "noscript", "object", "video"}  # nodes of their own, also inside a paragraph, which goes on after them
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot",
    "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none", "semantics",
}
# An element of the key's kind ends open ones of its set, unless a stop lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
HOLDS = {"table", "td", "th", "body", "html"}  # a paragraph outside these stays open
BARE = "#text"
FRAME = {"#page", "html", "body"}


@dataclass
class Node:
    tag: str
    parent: int
    attributes: str = ""
    runs: list[int] = field(default_factory=list)

    def tokens(self) -> list[str]:
        """Lower-case words of class, id and role."""
        if not self.attributes:
            return []
        found = []
        for name, value in _ATTRIBUTE.findall(self.attributes):
            if name.lower() in ("class", "id", "role"):
                found += [t.lower() for t in _TOKEN.findall(unescape(value))]
        return found

    def value(self, name: str) -> str | None:
        return next((v.strip("\"'") for n, v in _ATTRIBUTE.findall(self.attributes) if n.lower() == name), None)


@dataclass
class Page:
    """Nodes in document order (parents first), and text runs in page order with their node and linked characters."""

    nodes: list[Node]
    texts: list[str]
    owners: list[int]
    linked: list[int]


def read(html: str) -> Page:
    """Blocks of a page. White space in a run is one space; unseen elements, scripts and comments hold no text.

    Where open elements of each tag stand in the stack is kept, so that no tag walks the stack.
    """
    page = Page([Node("#page", -1)], [], [], [])
    nodes, stack = page.nodes, [0]
    places: dict[str, list[int]] = {}  # of each tag, the places of its open elements
    last_end = html.rfind(">")
    pieces: list[str] = []
    in_links: list[str] = []
    links = holder = 0
    hidden: list[str] = []  # open elements from the outermost unseen one on
    hides: Counter[str] = Counter()

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                nodes.append(Node(BARE, holder, runs=[len(page.texts)]))
                page.texts.append(text)
                page.owners.append(len(nodes) - 1)
                page.linked.append(min(len(text), len(" ".join("".join(in_links).split()))))
            pieces.clear()
            in_links.clear()

    def open_node(tag: str, attributes: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        nodes.append(Node(tag, stack[-1], attributes))
        stack.append(len(nodes) - 1)

    def cut(at: int) -> None:
        while len(stack) > at:
            places[nodes[stack.pop()].tag].pop()

    def close(tags: set[str], stops: set[str]) -> None:
        stop = max((places[t][-1] for t in stops if places.get(t)), default=0)
        above = [places[t][k] for t in tags if places.get(t) and (k := bisect_right(places[t], stop)) < len(places[t])]
        if above:
            cut(min(above))

    def end(tag: str) -> None:
        if places.get(tag):
            cut(places[tag][-1])

    at = 0
    while True:
        # Behind the last ">" only a comment or a declaration can still begin.
        found = _TAG.search(html, at) if at <= last_end or html.find("<!", at) >= 0 or html.find("<?", at) >= 0 else None
        text = html[at : found.start() if found else len(html)]
        if hidden == ["head"] and text.strip():
            hidden.clear()
            hides.clear()
        if text and not hidden:
            if holder != stack[-1] and (not pieces or text.strip()):
                flush()
                holder = stack[-1]
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                in_links.append(text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if hidden:
                if hides[tag]:
                    gone = ""
                    while gone != tag:
                        gone = hidden.pop()
                        hides[gone] -= 1
                    continue
                if not places.get(tag):
                    continue
                hidden.clear()  # the block around it ends
                hides.clear()
            if tag == "a":
                links = max(0, links - 1)
            elif tag in FALLBACK:
                end(tag)
            elif tag not in INLINE and tag not in VOID:
                flush()
                links = 0
                end(tag)
            continue
        if hidden == ["head"] and tag not in HEAD:
            hidden.clear()
            hides.clear()
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            at = over.end() if over else len(html)
            continue
        if hidden or tag in UNSEEN:
            if tag not in INLINE and tag not in VOID and not found[3].endswith("/") and (hidden != ["head"] or tag in UNSEEN | FALLBACK):
                hidden.append(tag)
                hides[tag] += 1
            continue
        if tag in INLINE:
            links += tag == "a"
        elif tag in VOID:
            if tag in ("br", "hr"):
                pieces.append(" ")
                if tag == "hr":
                    flush()
        elif tag in FALLBACK:
            if not found[3].endswith("/"):
                open_node(tag, found[3])
        else:
            flush()
            links = 0
            close({"p"}, HOLDS)
            if tag in ENDS:
                close(*ENDS[tag])
            open_node(tag, found[3])
    flush()
    return _settled(page)


def _settled(page: Page) -> Page:
    """The page with text nodes only where text stands beside blocks or in the frame; other text belongs to its block."""
    mixed = {node.parent for node in page.nodes if node.tag != BARE and node.tag not in FALLBACK}
    place, kept = {}, []
    for i, node in enumerate(page.nodes):
        if node.tag == BARE and page.nodes[node.parent].tag not in FRAME and node.parent not in mixed:
            place[i] = place[node.parent]
            kept[place[i]].runs += node.runs
            continue
        place[i] = len(kept)
        kept.append(Node(node.tag, place[node.parent] if i else -1, node.attributes, node.runs))
    return Page(kept, page.texts, [place[k] for k in page.owners], page.linked)
