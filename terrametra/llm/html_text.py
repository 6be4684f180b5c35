"""Visible text of HTML pages, laid out: block spacing, lists and aligned table cells.

A tolerant scanner yields tags and text; the tree builder supplies implied tags, closes what is left open and drops what
is not visible; the renderer keeps one flow of lines per table cell and lays the cells out when the table ends. All of
it works on a stack, so deep nesting is no recursion, and one page needs memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrametra.llm.words import slices

# Element classes and implied end tags of the HTML standard.
HEAD = frozenset("base link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style title template noscript iframe object embed noembed noframes audio video canvas svg math datalist area base "
    "link meta param source track".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table ul xmp".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul xmp".split())
CLOSES_P = (BLOCK - frozenset("body html".split())) | {"hr"}
SCOPE = frozenset("applet caption html table td th marquee object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": (("caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}

# A cell line longer than this does not widen its column, so a table's layout stays in proportion to its text.
COLUMN = 80
COLUMNS = 1000
ROWS = 65_534  # the HTML standard's largest row span
# A quote opens a value only right after "="; any other quote is a plain character, and so is one that is never closed.
_NAME_VALUE = r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(\"[^\"]*+\"|'[^']*+'|[^ \t\n\r\f>]*+))?"
_ATTR = re.compile(_NAME_VALUE)
_ATTRS = "((?:[ \t\n\r\f/]++|" + re.sub(r"(?<!\\)\((?!\?)", "(?:", _NAME_VALUE) + ")*+)"
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRS + r"(?:>|\Z)", re.S)
_HIDES = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_BLANKS = " \t\n\r\f"
_SPLIT = re.compile(r"[ \t\n\r\f]+")


def tokens(page: str):
    """``("text", s)``, ``("start", name, attributes)`` and ``("end", name)`` in order; comments and doctypes are gone."""
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            yield ("text", page[at:])
            return
        if found.start() > at:
            yield ("text", page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            yield ("end", name)
            continue
        yield ("start", name, found[3])
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if name in ("textarea", "xmp"):
                yield ("text", page[at : close.start() if close else len(page)])
            yield ("end", name)
            at = close.end() if close else len(page)
        elif name == "plaintext":
            yield ("text", page[at:])
            return


def hidden(name: str, attributes: str) -> bool:
    if name in UNSEEN:
        return True
    if not attributes.strip(" /"):
        return False
    found = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(attributes)}
    if "hidden" in found or _HIDES.search(found.get("style", "")):
        return True
    return name == "input" or (name == "dialog" and "open" not in found)


class Flow:
    """Lines of text: collapsed white space, pending blank lines, and an indent for what is nested."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        inner = _SPLIT.sub(" ", s).strip(" ")
        if not inner:
            self.space = self.space or bool(s)
            return
        if self.words and (self.space or s[0] in _BLANKS):
            self.words.append(" ")
        self.words.append(inner)
        self.space = s[-1] in _BLANKS

    def line(self, force: bool = False) -> None:
        self.space = False
        if not self.words and not force and not self.marker:
            return
        if not self.words and self.marker and not force:
            return
        self._put("".join(self.words))
        self.words = []

    def _put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = "".join(self.indent)
        if self.marker:
            lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((lead + s).rstrip())

    def block(self, blank: int) -> None:
        self.line()
        self.gap = max(self.gap, blank)

    def preformatted(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.words.append(first)
        for part in rest:
            self.line(force=True)
            self.words.append(part)

    def done(self) -> list[str]:
        self.line()
        return self.lines


class Table:
    """Rows of cells; a cell that spans rows keeps its columns free in the rows below, up to the end of its row group.

    Columns beyond the thousandth are not kept free, so a row costs no more than that and its own cells.
    """

    def __init__(self):
        self.rows: list[list[list[str]]] = []
        self.held: dict[int, int] = {}  # column: first row where it is free again

    def row(self) -> None:
        self.rows.append([])

    def group(self) -> None:
        self.held.clear()

    def cell(self, lines: list[str], columns: int, rows: int = 1) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        while self.held.get(len(row), 0) >= len(self.rows):
            row.append([])
        if rows > 1:
            for column in range(len(row), min(len(row) + columns, COLUMNS)):
                self.held[column] = len(self.rows) + rows - 1
        row += [lines] + [[]] * (columns - 1)

    def layout(self) -> list[str]:
        """Rows with cells padded to their column; the last cell of a row is not padded."""
        widths = [0] * max((len(r) for r in self.rows), default=0)
        for row in self.rows:
            for i, cell in enumerate(row):
                widths[i] = max([widths[i], *(len(x) for x in cell if len(x) <= COLUMN)])
        out = []
        for row in self.rows:
            for n in range(max((len(c) for c in row), default=0)):
                parts = [c[n] if n < len(c) else "" for c in row]
                while parts and not parts[-1]:
                    parts.pop()
                out.append("  ".join([p.ljust(w) for p, w in zip(parts[:-1], widths)] + parts[-1:]))
        return out


class Renderer:
    """Tree builder and renderer in one pass over the tokens."""

    def __init__(self):
        self.open: list[tuple[str, bool]] = []
        self.counts = [Counter()]  # open elements by name, per table cell and other scopes
        self.unseen = 0
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.lists: list[list] = []
        self.pre = 0
        self.spans: list[tuple[int, int]] = []

    def within(self, names) -> bool:
        return any(self.counts[-1][n] for n in names)

    def pop(self) -> None:
        name, was_hidden = self.open.pop()
        if name in SCOPE:
            self.counts.pop()
        self.counts[-1][name] -= 1
        if not self.unseen:
            self.leave(name)
        self.unseen -= was_hidden

    def pop_to(self, names) -> None:
        while self.open:
            name = self.open[-1][0]
            self.pop()
            if name in names:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and any(c[name] for c in self.counts[:2]):
            return
        if self.open and self.open[-1][0] == "head" and name not in HEAD:
            self.pop()
        if name in CLOSES_P and self.counts[-1]["p"]:
            self.pop_to(("p",))
        if name in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        if name in IMPLIED:
            self.imply(name)
        if name in ("td", "th") and self.tables and self.open[-1][0] != "tr":
            self.enter_element("tr", "")
        self.enter_element(name, attributes)
        if name in VOID:
            self.pop()

    def imply(self, name: str) -> None:
        """Close the elements that a start tag ends, up to the nearest container of their kind."""
        closed, containers = IMPLIED[name]
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            if not self.tables:
                return
            while self.open and self.open[-1][0] not in containers and (self.open[-1][0] in closed or self._above(closed, containers)):
                self.pop()
            return
        depth = len(self.open) - 1
        if not self.within(closed):
            return
        while depth >= 0 and self.open[depth][0] not in closed and self.open[depth][0] not in containers and self.open[depth][0] not in SCOPE:
            depth -= 1
        if depth >= 0 and self.open[depth][0] in closed:
            while len(self.open) > depth:
                self.pop()

    def _above(self, closed, containers) -> bool:
        for name, _ in reversed(self.open):
            if name in closed:
                return True
            if name in containers:
                return False
        return False

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", "")
        if name in VOID or name in ("html", "body"):
            return None
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "table"):
            if any(c[name] for c in self.counts) and (name == "table" or self.tables) and self._above((name,), ("table",) if name != "table" else ()):
                self.pop_to((name,))
        elif name in HEADINGS:
            if self.within(HEADINGS):
                self.pop_to(HEADINGS)
        elif self.counts[-1][name]:
            self.pop_to((name,))
        elif name == "p":
            self.start("p", "")
            self.pop()
        return None

    def enter_element(self, name: str, attributes: str) -> None:
        gone = hidden(name, attributes)
        self.open.append((name, gone))
        self.counts[-1][name] += 1
        if name in SCOPE:
            self.counts.append(Counter())
        self.unseen += gone
        if not self.unseen:
            self.enter(name, attributes)

    def enter(self, name: str, attributes: str) -> None:
        flow = self.flows[-1]
        if name == "br":
            flow.line(force=True)
        elif name == "hr":
            flow.block(1)
        elif name == "tr" and self.tables:
            self.tables[-1].row()
        elif name in ("tbody", "thead", "tfoot") and self.tables:
            self.tables[-1].group()
        elif name in ("td", "th") and self.tables:
            columns, rows = (re.search(rf"{side}span\s*=\s*[\"']?\s*(\d+)", attributes, re.I) for side in ("col", "row"))
            down = int(rows[1][:6]) or ROWS if rows else 1  # zero: to the end of the group
            self.spans.append((min(max(int(columns[1][:6]) if columns else 1, 1), COLUMNS), min(down, ROWS)))
            self.flows.append(Flow())
        elif name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and self.lists
            flow.block(0 if nested else int(name in SPACED))
            if name in ("ul", "ol", "menu", "dir"):
                first = re.search(r"start\s*=\s*[\"']?\s*(-?\d+)", attributes, re.I) if name == "ol" else None
                self.lists.append([name == "ol", int(first[1][:9]) if first else 1])
            elif name == "li":
                kind = self.lists[-1] if self.lists else [False, 1]
                flow.marker = f"{kind[1]}. " if kind[0] else "- "
                kind[1] += 1
                flow.indent.append(" " * len(flow.marker))
            elif name in ("blockquote", "dd"):
                flow.indent.append("  ")
            elif name in ("pre", "xmp"):
                self.pre += 1
            elif name == "table":
                self.tables.append(Table())

    def leave(self, name: str) -> None:
        flow = self.flows[-1]
        if name in ("td", "th") and self.tables and len(self.flows) > 1:
            self.flows.pop()
            self.tables[-1].cell(flow.done(), *self.spans.pop())
        elif name == "table":
            flow.line()
            for line in self.tables.pop().layout():
                flow._put(line)
            flow.block(1)
        elif name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and len(self.lists) > 1
            flow.block(0 if nested else int(name in SPACED))
            if name in ("ul", "ol", "menu", "dir"):
                self.lists.pop()
            elif name == "li":
                flow.indent.pop()
                flow.marker = ""
            elif name in ("blockquote", "dd"):
                flow.indent.pop()
            elif name in ("pre", "xmp"):
                self.pre -= 1
        elif name == "option":
            flow.line()

    def text(self, s: str) -> None:
        if self.open and self.open[-1][0] == "head" and s.strip(_BLANKS):
            self.pop()
        if self.unseen:
            return
        s = unescape(s) if "&" in s else s
        if self.pre:
            self.flows[-1].preformatted(s.replace("\r\n", "\n"))
        else:
            self.flows[-1].text(s)

    def finish(self) -> str:
        while self.open:
            self.pop()
        return "\n".join(self.flows[0].done())


def visible_text(page: str | None) -> str:
    """The visible text of one page; empty for null, empty and invisible pages."""
    out = Renderer()
    for kind, *rest in tokens(page or ""):
        getattr(out, kind)(*rest)
    return out.finish()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``<id_col>, text`` per row: the laid-out visible text of the whole page, empty for null.

    A cell over several rows or columns stands in its first one; the others stay free, so later cells keep their column.
    Ids may be null or repeated; other columns are not read. Rows never meet, so equal and very many pages do no harm.
    """
    kind = pages.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            text = [visible_text(p.as_py()) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["id", "text"])

    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
