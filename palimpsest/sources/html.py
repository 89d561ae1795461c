"""Web pages as content units, with the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Tags by what they do here.
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "form", "button", "select"}
CHROME = {"nav", "header", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ROLES = {"p": "paragraph", "li": "list_item", "td": "table_cell", "th": "table_cell", "blockquote": "quote", "pre": "preformatted", "dt": "paragraph", "dd": "paragraph", "caption": "caption", "figcaption": "caption"} | {f"h{k}": "heading" for k in range(1, 7)}

# Signs of pages that a script fills in the browser, and the ids of the elements it fills.
SHELLS, SHELL_IDS = ["__NEXT_DATA__", "data-reactroot", "ng-app", "ng-version", "data-vue", "__NUXT__"], ["root", "app", "__next", "__nuxt", "application"]


def render_note(html: Column, n_words: Column, least: int = 25) -> Column:
    """needs_javascript for a page of less than so many words that has the signs of an empty shell, else empty_page for one of no word, else null."""
    empty = html.rlike(rf"""(?is)<([a-z][a-z0-9-]*)\s[^>]*\bid\s*=\s*["']?(?:{"|".join(SHELL_IDS)})["'\s>](?:[^>]*>)?\s*</\1\s*>""")
    shell = reduce(or_, (html.contains(s) for s in SHELLS)) | empty
    return F.when(n_words >= least, None).when(F.coalesce(shell, F.lit(False)), "needs_javascript").when(n_words == 0, "empty_page")


# Start tags that end an open element, and what keeps them from ending one further out; end tags don't reach beyond a cell or table.
BLOCKS = {"address", "article", "aside", "blockquote", "details", "dl", "div", "fieldset", "figure", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
ENDS |= {x: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")} | {x: ({"p"}, {"button"}) for x in BLOCKS - {"p"}} | {"p": ({"p"}, {"button"})}
CELLS, TABLE_PARTS, HEAD_PARTS = {"td", "th", "table", "caption"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "html", "body"}, {"head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}
HEADINGS = {f"h{k}" for k in range(1, 7)}


class Units(HTMLParser):
    """(role, level, section_path, text, href, place) in reading order.

    An element that has a role is a unit with all that is in it; only the cells of a table within a cell stand for themselves. With `loose`, text outside of such elements is a unit
    of role text. What is hidden, or no content, is skipped up to its end, which a start tag may stand for. place: for a table cell the table's number on the page, its row and its
    column, from 0; heads has the places of header cells.
    """

    def __init__(self, base: str | None = None, loose: bool = False):
        super().__init__(convert_charrefs=True)
        self.base, self.loose = base or "", loose
        self.found: list[list | None] = []  # a unit's place is taken where it begins
        self.links: list[tuple] = []
        self.open: list[tuple[str, bool, int | None]] = []  # tag, whether skipped, unit that it began
        self.units_open: list[tuple[int, str, int | None, list[str], tuple | None]] = []
        self.text: list[str] = []
        self.headings: list[tuple[int, str]] = []
        self.href, self.link = None, []
        self.tables: list[list[int]] = []  # number, row and next column of each open table
        self.n_tables, self.heads = 0, set()

    def unread(self, tag: str) -> bool:
        return tag in DROPPED or tag in CHROME or tag in ("head", "title")

    def skipped(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in HEAD_PARTS and any(x[0] == "head" for x in self.open) and tag != "html":
            self.end_to("head", set())
        while tag in ENDS and self.end_any(*ENDS[tag]):
            pass
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or any(x in (a.get("style") or "").replace(" ", "").lower() for x in ("display:none", "visibility:hidden"))
        skip = self.skipped() or hidden or self.unread(tag)
        if tag in VOID:
            if not self.skipped():
                self.space()
            return
        own = None
        if not skip:
            if tag == "table":
                self.tables.append([self.n_tables, -1, 0])
                self.n_tables += 1
            elif tag == "tr" and self.tables:
                self.tables[-1][1:] = [self.tables[-1][1] + 1, 0]
            place = None
            if tag in ("td", "th") and self.tables:
                place = tuple(self.tables[-1])
                self.tables[-1][2] += 1
                if tag == "th":
                    self.heads.add(place)
            within = self.units_open and not (tag in ("td", "th") and self.units_open[-1][4] and place and place[0] != self.units_open[-1][4][0])
            if tag in ROLES and not within:
                self.flush()
                own = len(self.found)
                self.found.append(None)
                self.units_open.append((own, ROLES[tag], int(tag[1]) if tag in HEADINGS else None, [], place))
            elif tag in BLOCKS or tag in TABLE_PARTS or tag in ROLES:
                self.space()
                if not self.units_open:
                    self.flush()
            if tag == "a" and a.get("href"):
                to = urljoined(self.base, a["href"])
                self.href, self.link = (to if to.startswith(("http://", "https://")) else None), []
        self.open.append((tag, skip, own))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends nothing in HTML

    def handle_endtag(self, tag):
        self.end_to(tag, set() if tag in TABLE_PARTS else CELLS)

    def end_any(self, tags: set[str], borders: set[str]) -> bool:
        """Ends the innermost open element of one of the tags, unless a border, cell or table is nearer."""
        for x, _, _ in reversed(self.open):
            if x in tags:
                self.end_to(x, set())
                return True
            if x in borders or (x in CELLS and not tags & TABLE_PARTS):
                return False
        return False

    def end_to(self, tag: str, borders: set[str]) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag or self.open[k][0] in borders), None)
        if at is not None and self.open[at][0] == tag:
            while len(self.open) > at:
                self.pop()

    def pop(self) -> None:
        tag, skip, own = self.open.pop()
        if skip:
            return
        if own is not None:
            _, role, level, parts, place = self.units_open.pop()
            self.unit(own, role, level, parts, place)
        elif tag in BLOCKS or tag in TABLE_PARTS:
            self.space()
            if not self.units_open:
                self.flush()
        if tag == "table" and self.tables:
            self.tables.pop()
        if tag == "a" and self.href:
            self.links.append((" ".join("".join(self.link).split()), self.href))
            self.href = None

    def unit(self, at: int, role: str, level: int | None, parts: list[str], place: tuple | None) -> None:
        text = " ".join("".join(parts).split())
        if not text:
            return
        if role == "heading":
            self.headings = [h for h in self.headings if h[0] < level]
        self.found[at] = (role, level, [h[1] for h in self.headings], text, None, place)
        if role == "heading":
            self.headings.append((level, text))

    def flush(self) -> None:
        """The text so far that is in no unit."""
        if self.loose and "".join(self.text).strip():
            self.found.append(None)
            self.unit(len(self.found) - 1, "text", None, self.text, None)
        self.text = []

    def space(self) -> None:
        (self.units_open[-1][3] if self.units_open else self.text).append(" ")

    def handle_data(self, data):
        if not self.skipped():
            (self.units_open[-1][3] if self.units_open else self.text).append(data)
            if self.href:
                self.link.append(data)

    def close(self):
        super().close()
        while self.open:
            self.pop()
        self.flush()


def urljoined(base: str, href: str) -> str:
    """The address that a link names on a page; empty where there is none."""
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


def _read(html: str, most: int | None = None, base: str | None = None, loose: bool = False) -> tuple[list[tuple], set]:
    p = Units(base, loose)
    p.feed(html)
    p.close()
    found = [u for u in p.found if u] + [("link", None, [], text, href, None) for text, href in p.links if text]
    if most is not None and len(found) > most:
        found = found[:most] + [("warning", None, [], f"{most} of {len(found)} units", None, None)]
    return found, p.heads


def parse(html: str, most: int | None = None, base: str | None = None, loose: bool = False) -> list[tuple]:
    """All units of a page, links last. With `most`, that many and, if there were more, a unit of role warning that says how many. Links that don't lead to a web address, be it
    with the page's own as base, are left out."""
    return _read(html, most, base, loose)[0]


SCHEMA = pa.schema([("page_id", pa.int64()), ("idx", pa.int32()), ("role", pa.string()), ("level", pa.int32()), ("section_path", pa.list_(pa.string())), ("text", pa.string()), ("href", pa.string()), ("place", pa.struct([("tbl", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("head", pa.bool_())]))])


def units(pages: DataFrame, most: int | None = None, loose: bool = False) -> DataFrame:
    """Of (page_id, html, and url where there is one): a row for each unit, links last and without tracking parameters. most, loose: as for parse(). place.head: of header cells."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, heads = _read(h or "", most, base, loose)
                rows += [(i, k, *u[:5], u[5] and dict(zip(("tbl", "row", "col", "head"), (*u[5], u[5] in heads), strict=True))) for k, u in enumerate(found)]
            yield pa.RecordBatch.from_pydict({n: [r[c] for r in rows] for c, n in enumerate(SCHEMA.names)}, schema=SCHEMA)

    found = pages.select("page_id", "html", url.alias("url")).mapInArrow(run, "page_id long, idx int, role string, level int, section_path array<string>, text string, href string, place struct<tbl:int,row:int,col:int,head:boolean>")
    return found.withColumn("href", urls.strip_tracking(F.col("href")))


class Elements(Units):
    """The elements and texts of a page as numbered nodes: [node, last, depth, tag, role, class, id, signs, starts, inside].

    last: the last node within an element. Of a text: its signs that aren't white space, and the words that begin in it. inside: whether an element's first word began before it.
    What is hidden or never read is no node; navigation and the like is."""

    def __init__(self):
        super().__init__()
        self.nodes: list[list] = []
        self.path: list[int | None] = []
        self.waiting: list[int] = []  # elements that have no sign yet
        self.in_word = False

    def unread(self, tag: str) -> bool:
        return tag in DROPPED or tag in ("head", "title")

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag in VOID:
            return
        own = None
        if not self.skipped():
            a = dict(attrs)
            own = len(self.nodes)
            self.nodes.append([own, own, sum(x is not None for x in self.path), tag, (a.get("role") or "").lower(), a.get("class") or "", a.get("id") or "", 0, 0, False])
            self.waiting.append(own)
        self.path.append(own)

    def pop(self) -> None:
        super().pop()
        own = self.path.pop()
        if own is not None:
            self.nodes[own][1] = len(self.nodes) - 1
            self.waiting = [k for k in self.waiting if k != own]

    def handle_data(self, data):
        if self.skipped() or not data:
            return
        words = data.split()
        goes_on = bool(words) and not data[0].isspace() and self.in_word
        if words:
            for k in self.waiting:
                self.nodes[k][9] = goes_on
            self.waiting = []
        own = len(self.nodes)
        self.nodes.append([own, own, sum(x is not None for x in self.path), "#text", "", "", "", sum(map(len, words)), len(words) - goes_on, False])
        self.in_word = not data[-1].isspace()


NODES = pa.schema([("page_id", pa.int64()), ("node", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("role", pa.string()), ("class", pa.string()), ("id", pa.string()), ("signs", pa.int64()), ("starts", pa.int64()), ("inside", pa.bool_())])


def elements(pages: DataFrame) -> DataFrame:
    """Of (page_id, html): a row for each node of Elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = Elements()
                p.feed(h or "")
                p.close()
                rows += [(i, *n) for n in p.nodes]
            yield pa.RecordBatch.from_pydict({n: [r[c] for r in rows] for c, n in enumerate(NODES.names)}, schema=NODES)

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, node int, last int, depth int, tag string, role string, class string, id string, signs long, starts long, inside boolean")
