"""A forgiving parse of HTML into a tree of blocks and runs of text."""

from __future__ import annotations

import html
import re

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("script style textarea title noscript iframe noembed noframes template head svg math object select option optgroup button label legend canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd map mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = frozenset("ul ol dl table select menu".split())

_NEXT = re.compile(r"[>\"']")
_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")


class Node:
    """An element that is a block, or a run of text (tag ``#text``); ``at`` is its place in page order."""

    __slots__ = ("tag", "parent", "children", "names", "depth", "text", "links", "tags", "at")

    def __init__(self, tag: str, parent: Node | None, at: int, names: frozenset[str] = frozenset()):
        self.tag, self.parent, self.names, self.at = tag, parent, names, at
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text, self.links, self.tags = "", 0, 0
        if parent:
            parent.children.append(self)


def _names(attributes: str) -> frozenset[str]:
    """The words of an element's class, id and role."""
    if not attributes or attributes.isspace():
        return frozenset()
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "aria-label", "itemprop"):
            found.update(_NAME.findall(_HUMP.sub(r"\1 \2", m[2] or m[3] or m[4] or "").lower()))
    return frozenset(found)


class _Tags:
    """Where the tags of a page end. Every place is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, {quote: page.rfind(quote) for quote in "\"'"}

    def end(self, at: int) -> int:
        """The place after the tag's ``>``; a quote after ``=`` that is closed again hides what it holds."""
        page = self.page
        while (m := _NEXT.search(page, at)) is not None:
            at, quote = m.end(), m[0]
            if quote == ">":
                return at
            before = at - 2
            while before >= 0 and page[before].isspace():
                before -= 1
            if page[before] == "=" and at <= self.last[quote]:
                at = page.index(quote, at) + 1
        return len(page)


class _Open:
    """The open elements, each with the block it lies in, and where those of each tag are."""

    def __init__(self, root: Node):
        self.tags, self.blocks, self.walls = ["#root"], [root], [0]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, block: Node) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.walls.append(self.walls[-1] if tag in INLINE else len(self.tags))
        self.tags.append(tag)
        self.blocks.append(block)

    def pop(self) -> str:
        self.walls.pop()
        self.blocks.pop()
        tag = self.tags.pop()
        self.places[tag].pop()
        return tag

    def last(self, tag: str) -> int:
        """The place of the innermost element of the tag, 0 if none is open."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def last_of(self, tags) -> int:
        return max(map(self.last, tags))


def parse(page: str) -> Node:
    """The tree of blocks; text inside scripts, styles, heads and controls is left out. Time grows with the page's length."""
    return parse_nodes(page)[0]


def parse_nodes(page: str) -> list[Node]:
    """The nodes of the tree in page order, the root first."""
    nodes = [Node("#root", None, 0)]
    held, ends = _Open(nodes[0]), _Tags(page)
    parts: list[str] = []
    links = tags = dropped = 0  # characters in links and tags of the run; open elements whose text is left out

    def flush() -> None:
        nonlocal links, tags
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            run = Node("#text", held.blocks[-1], len(nodes))
            run.text, run.links, run.tags = text, links, tags
            nodes.append(run)
        parts.clear()
        links = tags = 0

    def close(at: int) -> None:
        nonlocal dropped
        if held.walls[-1] >= at:
            flush()
        while len(held.tags) > at:
            dropped -= held.pop() in DROPPED

    def say(raw: str) -> None:
        nonlocal links
        if raw and not dropped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if held.last("a"):
                links += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        while start >= 0 and not (start + 1 < end and (page[start + 1] in "!?/" or page[start + 1].isascii() and page[start + 1].isalpha())):
            start = page.find("<", start + 1)
        if start < 0:
            say(page[at:])
            break
        say(page[at:start])
        if page.startswith("<!--", start):
            m = _COMMENT_END.search(page, start + 2)
            at = m.end() if m else end
            continue
        closing = page[start + 1] == "/"
        name = _TAG.match(page, start + 1 + closing)
        if name is None:  # a declaration, or what is no tag
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else end
            continue
        at, tag = ends.end(name.end()), name[0].lower()
        if closing:
            i = held.last(tag)
            if i and (tag not in INLINE or i > held.walls[-1]):
                close(i)
            continue
        if tag in CLOSES_P:
            i = held.last("p")
            if i and i > held.last_of(("td", "th", "button", "table", "caption")):
                close(i)
        if tag in CLOSED_BY:
            while (i := held.last_of(CLOSED_BY[tag])) > held.last_of(HOLDS):
                close(i)
                if tag not in ("tr", "td", "th"):
                    break
        if tag == "body" and held.last("head"):
            close(held.places["head"][0])
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = page.find(">", stop.end()) + 1 or end if stop else end
            continue
        if tag in INLINE:
            held.push(tag, held.blocks[-1])
            tags += 1
        else:
            flush()
            block = held.blocks[-1]
            if tag not in DROPPED:
                block = Node(tag, block, len(nodes), _names(page[name.end() : at - 1]))
                nodes.append(block)
            held.push(tag, block)
            dropped += tag in DROPPED
    close(1)
    flush()
    return nodes
