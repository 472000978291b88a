"""A page as a tree of blocks: elements that stand by themselves, and runs of text between their borders."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|[^>]*>?))", re.DOTALL)
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without content, those that stand in a line, those whose content is no markup or no text
# of the page, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = RAW | frozenset("head noscript template svg math object audio video canvas select datalist".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
CONTROLS = frozenset("input button select textarea option label".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table td th body html div section article main aside nav header footer form select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of what names an element: of class, id, role, itemprop and label."""
    return _tokens(attributes) if len(attributes) <= 1000 else _tokens.__wrapped__(attributes)  # long ones are not kept


@lru_cache(4096)
def _tokens(attributes: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p.lower() for m in NAMED.finditer(attributes) for p in PIECE.findall(m[1] or m[2] or m[3] or "")))


@dataclass
class Page:
    """Nodes in page order, parents first. Runs have the tag "" and a text; ``links`` are the characters inside of links."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: str = "", text: str = "", links: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.links.append(links)
        self.controls.append(0)
        return len(self.parent) - 1


class Reader:
    """Reads the markup once from left to right; whatever is open at the end is closed there."""

    def __init__(self) -> None:
        self.page = Page()
        self.open: list[tuple[str, int]] = [("", self.page.add(-1, "#root"))]  # tag and node; a part of a line has its block's node
        self.count: Counter[str] = Counter()  # of what is open, by tag
        self.run: list[str] = []
        self.links = self.silent = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.page.add(self.open[-1][1], "", text=text, links=min(self.links, len(text)))
            self.run, self.links = [], 0

    def words(self, piece: str) -> None:
        if piece and not self.silent:
            piece = html.unescape(piece) if "&" in piece else piece
            self.run.append(piece)
            if self.count["a"]:
                self.links += len(piece.strip())

    def pop(self, to: int) -> None:
        """Close what is open from place ``to`` on."""
        if any(t not in INLINE for t, _ in self.open[to:]):
            self.flush()
        for t, _ in self.open[to:]:
            self.silent -= t in SILENT
            self.count[t] -= 1
        del self.open[to:]

    def ended(self, tags: set[str], scope: frozenset[str]) -> None:
        """Close the outermost of ``tags`` that is open within the scope."""
        at = None
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i][0]
            if t in tags:
                at = i
                if len(tags) == 1:
                    break  # no two of them are open in a scope
            elif t in scope:
                break
        if at is not None:
            self.pop(at)

    def start(self, tag: str, attributes: str) -> None:
        if tag not in HEAD and self.open[-1][0] == "head":
            self.pop(len(self.open) - 1)
        if tag in CONTROLS:
            self.page.controls[self.open[-1][1]] += 1
        if tag in INLINE:
            if tag == "br":
                self.run.append("\n")
            if tag == "a":
                self.ended({"a"}, SCOPE)
            if tag not in VOID:
                self.open.append((tag, self.open[-1][1]))
                self.count[tag] += 1
            return
        self.flush()
        if tag in ENDS:
            self.ended(ENDS[tag], SCOPE - {"td", "th"} if tag in ("tr", "td", "th", "tbody", "tfoot") else SCOPE)
        else:
            self.ended({"p"}, SCOPE)
        node = self.page.add(self.open[-1][1], tag, attributes)
        if tag not in VOID:
            self.open.append((tag, node))
            self.count[tag] += 1
            self.silent += tag in SILENT

    def end(self, tag: str) -> None:
        if tag in ("body", "html", "br") or not self.count[tag]:
            return None
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i][0]
            if t == tag:
                return self.pop(i)
            if tag in INLINE and t not in INLINE:
                return None  # nothing of that kind is open in this block
        return None

    def read(self, markup: str) -> Page:
        at = 0
        while m := TAG.search(markup, at):
            self.words(markup[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                over = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(markup, at)
                at = over.end() if over else len(markup)
                self.end(tag)
        self.words(markup[at:])
        self.flush()
        return self.page


def parse(markup: str | None) -> Page:
    return Reader().read(markup or "")
