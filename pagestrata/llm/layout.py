"""Markup to visible text blocks: a small tree builder with implied end tags and visibility rules.

Every block element, table row and list item becomes one block; list items keep their bullet or number, the
cells of a table are aligned in columns, preformatted text keeps its spacing. Elements that are not rendered
(scripts, styles, templates, hidden or aria-hidden elements, display:none) give nothing. Each block knows the role that its
elements give it: outside (navigation, banner, footer, sidebar, dialog), heading, list, table or none. Text without any
markup passes through: each of its lines is a block without a role already.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

# Element classes of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title iframe object svg math canvas audio video select textarea datalist".split())
# A start tag on the left ends an open element on the right, up to the named boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_CLOSERS = BLOCK - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "html", "body", "legend", "summary", "figcaption"} | {"li", "dt", "dd"}
# Elements and roles beside a page's main content; banners and footers only where no sectioning element holds them.
OUTSIDE = frozenset("nav aside menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())
SECTIONED = frozenset("article main section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DOCUMENT = re.compile(r"^\s*<[a-z!]|<(?:!doctype|html|body)\b", re.I)
CLOSING = re.compile(r"</(?:p|div|li|td|tr|h[1-6]|ul|ol|table|section|article|nav|header|footer|main)\s*>", re.I)
# So many closing tags make a text that does not begin with one a piece of markup.
LEAST_CLOSING = 5


class Block(NamedTuple):
    text: str
    role: str = ""




class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, str]] = []
        self.unseen = 0
        self.counters: list[int | None] = []
        self.blocks: list[Block] = []
        self.current: list[str] = []
        self.prefix = ""
        self.tables: list[list[list[str]]] = []

    def _role(self) -> str:
        tags = [t for t, _, _ in self.open]
        for k, (tag, _, role) in enumerate(self.open):
            if tag in OUTSIDE or role in OUTSIDE_ROLES or (tag in ("header", "footer") and SECTIONED.isdisjoint(tags[:k])):
                return "outside"
        inner = [r for t in tags if (r := "heading" if t in HEADINGS else "list" if t in ("li", "dt", "dd") else "table" if t == "table" else "")]
        return inner[-1] if inner else ""

    def flush(self) -> None:
        if self._in_cell():
            return
        pre = any(t == "pre" for t, _, _ in self.open)
        text = "".join(self.current)
        for piece in text.split("\n") if pre else [re.sub(r"\s+", " ", text).strip()]:
            if piece.strip():
                self.blocks.append(Block(self.prefix + piece, self._role()))
                self.prefix = ""
        self.current = []

    def _in_cell(self) -> bool:
        return any(t in ("td", "th") for t, _, _ in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            closed, boundary = CLOSES[tag]
            self._close_within(closed, boundary)
        if tag in P_CLOSERS:
            self._close_within({"p"}, {"table", "td", "th", "button"})
        a = dict(attrs)
        style = re.sub(r"\s", "", (a.get("style") or "").lower())
        hidden = tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or (tag == "dialog" and "open" not in a)
        if tag == "br" or (tag in BLOCK and self._in_cell()):
            if not self.unseen:
                self.current.append(" ")
                self.flush()
            if tag == "br":
                return
        elif tag in BLOCK and tag not in ("td", "th") and not self.unseen:
            self.flush()
        if tag == "table" and not self._in_cell():
            self.tables.append([])
        if tag == "tr" and self.tables and not self._in_cell():
            self.tables[-1].append([])
        if tag in ("ul", "ol", "menu"):
            self.counters.append(0 if tag == "ol" else None)
        if tag == "li" and not self.unseen:
            if self.counters and self.counters[-1] is not None:
                self.counters[-1] += 1
                self.prefix = f"{self.counters[-1]}. "
            else:
                self.prefix = "- "
            if self._in_cell():
                self.current.append(self.prefix)
                self.prefix = ""
        if tag in VOID:
            return
        if tag in ("td", "th") and not self._in_cell():
            # Text between cells belongs to none of them.
            self.current = []
        self.open.append((tag, hidden, (a.get("role") or "").lower()))
        self.unseen += hidden

    def _close_within(self, names: set[str], boundary: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                while len(self.open) > k:
                    self._pop()
            elif self.open[k][0] in boundary:
                return

    def _pop(self) -> None:
        tag, hidden, _ = self.open[-1]
        cell = tag in ("td", "th")
        if tag in BLOCK and not cell and not self.unseen:
            self.flush()
        self.open.pop()
        if cell and not self._in_cell():
            if self.tables and self.tables[-1] and not self.unseen:
                self.tables[-1][-1].append(re.sub(r"\s+", " ", "".join(self.current)).strip())
            self.current = []
        self.unseen -= hidden
        if tag == "table" and self.tables and not self._in_cell():
            self._align(self.tables.pop())
        if tag in ("ul", "ol", "menu") and self.counters:
            self.counters.pop()
        if tag == "li":
            self.prefix = ""

    def _align(self, rows: list[list[str]]) -> None:
        """One block a row, every column as wide as its widest cell."""
        widths = [max(len(r[k]) for r in rows if len(r) > k) for k in range(max(map(len, rows), default=0))]
        role = self._role() or "table"
        for row in rows:
            text = "  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip()
            if text.strip():
                self.blocks.append(Block(text, role))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                last = self.open[-1][0]
                self._pop()
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.current.append(data)


def render(markup: str) -> list[Block]:
    """Visible blocks of an HTML document, in order."""
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    while builder.open:
        builder._pop()
    builder.flush()
    return builder.blocks


def is_markup(body: str) -> bool:
    """A text that begins with a tag or holds a document's, and closes some element; or that closes many block elements."""
    if "</" not in body:
        return False
    return DOCUMENT.search(body) is not None or sum(1 for _ in CLOSING.finditer(body)) >= LEAST_CLOSING


def blocks(body: str) -> list[Block]:
    """Blocks of a page body: rendered markup, or the lines of a text without markup (as many as splitting at newlines gives)."""
    return render(body) if is_markup(body) else [Block(x) for x in body.split("\n")]
