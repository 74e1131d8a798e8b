"""HTML to leaf blocks: maximal runs of text between block-level boundaries, each
with the path of elements around it. Tolerant of unclosed and stray tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# HTML element classes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Whose content is no text of the page: code, form fields, the head's title, drawings, embedded pages.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "option"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "object", "canvas", "audio", "video", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "mfrac", "msqrt", "mroot"}
#: An opening tag closes an open element of these names first, within the given scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Block elements that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

#: Attributes by the rules of HTML: a value is quoted only if a quote begins it, and a quote
#: elsewhere is a character like any other. A tag ends at the first > outside quoted values.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:{_VALUE})?+|=)*+)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(rf"""([^\s/>=][^\s/>=]*+)({_VALUE})?+""")
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass
class Element:
    tag: str
    marks: frozenset = frozenset()


@dataclass
class Block:
    text: str
    path: tuple  # of Element, outermost first, without inline elements
    link_chars: int = 0
    inline: set = field(default_factory=set)


def _marks(attrs: str) -> frozenset:
    found: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip().removeprefix("=").strip().strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            found.add("!hidden")
        elif name in ("class", "id", "role"):
            found.update(_WORDS.findall(value))
    return frozenset(found)


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order, references decoded, white space made one space."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    links: list[str] = []
    inline: set[str] = set()
    anchors = 0
    broke = False
    path: tuple | None = None

    def flush() -> None:
        nonlocal parts, links, inline, path
        if parts:
            text = " ".join("".join(map(unescape, parts)).split())
            if text:
                out.append(Block(text, path or (), sum(len(x) for x in links), inline))
        parts, links, inline, path = [], [], set(), None

    def pop_to(k: int) -> None:
        nonlocal anchors
        for e in stack[k:]:
            anchors -= e.tag == "a"
        del stack[k:]

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        m = _TAG.match(html, lt) if lt >= 0 else None
        while lt >= 0 and m is None:
            lt = html.find("<", lt + 1)
            m = _TAG.match(html, lt) if lt >= 0 else None
        text = html[at:lt] if lt >= 0 else html[at:]
        if text:
            broke = broke and text.isspace()
            if path is None and not text.isspace():
                path = tuple(e for e in stack if e.tag not in INLINE)
                inline = {e.tag for e in stack if e.tag in INLINE}
            parts.append(text)
            if anchors:
                links.append(text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                at = close.end() if close else (end if tag in ("script", "style", "textarea") else at)
            parts.append(" ") if parts else None
            continue
        if tag == "br":  # a second one right behind ends the block
            if broke:
                flush()
            else:
                parts.append(" ")
            broke = True
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == "p":
                        pop_to(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            if tag in CLOSES:
                names, scope = CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in scope:
                        break
                    if stack[k].tag in names:
                        pop_to(k)
                        break
        if tag not in VOID and not (m[3].rstrip().endswith("/") and tag not in ENDS_P):
            stack.append(Element(tag, _marks(m[3]) if m[3] else frozenset()))
            anchors += tag == "a"
    flush()
    return out
