"""A page as a tree of blocks, and the tree's folded form, in which repeated parts are one node.

Inline markup is transparent: the tree has block elements and their runs of text. End tags that HTML lets authors leave
out are implied, and what is never shown (scripts, styles, markup declarations, form controls, hidden elements) is left out.
"""

from __future__ import annotations

import re
from html import unescape

#: Fixed values. Elements whose text is none: skipped up to their end tag.
SKIPPED = frozenset("script style noscript template iframe svg math object audio video canvas select textarea button datalist map title xmp".split())
#: Fixed values. Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold running text; neighbours among them are one flow.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address figcaption caption summary #text".split())
#: Repeated records of lists and tables; all records of one kind under one parent are one node of the folded tree.
RECORDS = frozenset("li dt dd article option".split())
#: Elements that are no part of a main text.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Words in a class or id that say so too.
OUTSIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer footnav
    form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagenav pager pagination popup promo promoted promotion recommendations
    recommended related replies reply respond search share sharing sidebar sidenav signin signup social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets""".split()
)
#: Elements without an end tag that one must find: what they hold is no markup.
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
#: Roles that say so too.
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Elements that end at the start of one of the others, within the nearest of the bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"datalist"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^>\"']++)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?![\w-])\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_TOKENS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_DIGITS = re.compile(r"\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TITLE = re.compile(r"<title\b[^>]*+>(.*?)(?:</title|\Z)", re.S | re.I)


#: Blocks within blocks that the tree holds; those within are not told apart, but all their text is kept.
MOST_DEEP = 150


class Node:
    """A block: its tag, whether it is outside of any main text, whether it is told to be one, its kind and its children."""

    __slots__ = ("tag", "outside", "header", "inside", "kind", "kids", "text", "linked", "order")

    def __init__(self, tag: str, outside: bool = False, inside: int = 0, kind: str = "", header: bool = False):
        self.tag, self.outside, self.header, self.inside, self.kind = tag, outside, header, inside, kind
        self.kids: list[Node] = []
        self.text, self.linked, self.order = "", 0, 0


def spaced(raw: str) -> str:
    """Character references decoded, white space as one space each, trimmed."""
    return " ".join((unescape(raw) if "&" in raw else raw).split())


def _lowered(page: str) -> str:
    """The page in lower case, at the same places: a character whose lower case is longer stays as it is."""
    lower = page.lower()
    return lower if len(lower) == len(page) else "".join(c.lower() if len(c.lower()) == 1 else c for c in page)


def title_of(page: str) -> str:
    found = _TITLE.search(page)
    return spaced(found[1]) if found else ""


def _element(tag: str, attributes: str) -> Node | None:
    """The node of a start tag; None if it is never shown."""
    outside, header, inside, kind = tag in OUTSIDE, tag == "header", 2 if tag == "article" else 1 if tag == "main" else 0, ""
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
                return None
            if name in ("class", "id"):
                words = [w.lower() for w in _TOKENS.findall(value)]
                outside, header = outside or any(w in OUTSIDE_WORDS for w in words), header or "header" in words
                if name == "class":
                    kind = " ".join(sorted(_DIGITS.sub("#", value).split()))
            elif name == "role":
                outside, inside = outside or value.lower() in OUTSIDE_ROLES, max(inside, int(value.lower() == "main"), 2 * (value.lower() == "article"))
            elif name == "itemprop" and value.lower() == "articlebody":
                inside = 2
    return Node(tag, outside, inside, kind, header)


def tree_of(page: str | None) -> Node:
    """The page's tree of blocks under a root called body. Below MOST_DEEP blocks, inner ones only end a run of text."""
    page = page or ""
    root = Node("body")
    stack, runs, link, at, end = [root], [], -1, 0, len(page)  # link: depth of the block in which a link began, or -1
    lower, n_leaves = None, 0

    def flush() -> None:
        nonlocal runs, n_leaves
        if runs:
            text = spaced("".join(x for x, _ in runs))
            if text:
                leaf = Node("#text")
                leaf.text, leaf.linked = text, min(len(text), sum(len(spaced(x)) for x, a in runs if a))
                leaf.order, n_leaves = n_leaves, n_leaves + 1
                stack[-1].kids.append(leaf)
            runs = []

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            runs.append((page[at:stop], link >= 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = -1
            elif tag in BLOCKS and tag != "body":
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if depth:
                    flush()
                    del stack[depth:]
                    link = link if link < depth else -1
            continue
        if tag in SKIPPED:
            lower = lower or _lowered(page)
            close = lower.find(f"</{tag}", at)
            if close >= 0:
                at = page.find(">", close) + 1 or end
            elif tag in RAW:
                at = end
            continue
        if tag == "a":
            link = len(stack) - 1
            continue
        if tag == "br":
            runs.append((" ", False))
        if tag == "hr":
            flush()
        if tag not in BLOCKS or tag == "body":
            continue
        flush()
        if stack[-1].tag == "p" or stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit() and tag[0] == "h" and tag[1:].isdigit():
            stack.pop()
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
        if len(stack) > MOST_DEEP:
            continue
        node = _element(tag, m[3])
        link = link if link < len(stack) else -1
        if node is None:  # kept on the stack, so that its end tag is found, but nowhere in the tree
            stack.append(Node(tag))
            continue
        stack[-1].kids.append(node)
        stack.append(node)
    flush()
    return root
