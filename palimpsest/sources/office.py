"""Files in bytes to rows: probing PDF, Word and workbook files, and reading the last two.

A refused file gives one row with `error` and nothing else: nothing is cut short. Files are read one at a time in a task; the limits
bound the memory of each.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats

# Limits of files.
ENTRIES, PART_BYTES, ALL_BYTES, FILE_BYTES, CELLS, SHEETS, UNITS, PDF_BYTES = 5_000, 64 << 20, 160 << 20, 20 << 20, 150_000, 60, 20_000, 50 << 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TRACKED = {f"{W}{t}" for t in "ins del moveFrom moveTo cellIns cellDel".split()}
P = "{http://schemas.openxmlformats.org/officeDocument/2006/extended-properties}"
OBJECTS = {f"{W}{t}" for t in "drawing pict object".split()}
UNREAD = {f"{W}{t}" for t in "instrText delText footnoteReference endnoteReference pict drawing".split()}


class Refused(Exception):
    """With the code of the refusal."""


def pdf_problem(content: Column) -> Column:
    """Why bytes are no readable PDF, or null: empty, too_large, not_pdf, encrypted, truncated. Checked in that order."""
    head, tail = F.hex(F.substring(content, 1, 1024)), F.hex(F.substring(content, F.greatest(F.lit(1), F.octet_length(content) - 2047), F.lit(2048)))
    word = lambda s: s.encode().hex().upper()
    n = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(n == 0, "empty").when(n > PDF_BYTES, "too_large").when(~head.contains(word("%PDF-")), "not_pdf").when(tail.contains(word("/Encrypt")), "encrypted").when(~tail.contains(word("%%EOF")), "truncated")


class Package:
    """The parts of a container that passed every check."""

    def __init__(self, data: bytes):
        if not data:
            raise Refused("empty")
        if len(data) > FILE_BYTES:
            raise Refused("too_large")
        if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
            raise Refused("legacy_or_encrypted")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
            raise Refused("not_a_package") from None
        members = self.zip.infolist()
        names = [m.filename for m in members]
        if len(members) > ENTRIES or sum(m.file_size for m in members) > ALL_BYTES:
            raise Refused("too_large")
        if any(n.startswith(("/", "\\")) or "\\" in n or ":" in n or ".." in n.split("/") or "\0" in n for n in names):
            raise Refused("unsafe_name")
        if len({n.lower() for n in names}) < len(names):
            raise Refused("duplicate_name")
        if any(m.flag_bits & 1 for m in members):
            raise Refused("encrypted")
        if any(posixpath.basename(n).lower().startswith("vbaproject") for n in names):
            raise Refused("macros")
        self.names = set(names)

    def xml(self, name: str, needed: bool = False) -> ET.Element | None:
        if name not in self.names:
            if needed:
                raise Refused("missing_part")
            return None
        try:
            with self.zip.open(name) as part:
                data = part.read(PART_BYTES + 1)
        except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, ValueError, RuntimeError):
            raise Refused("corrupt") from None
        if len(data) > PART_BYTES:
            raise Refused("too_large")
        if re.search(rb"<!\s*(DOCTYPE|ENTITY)", data.replace(b"\0", b""), re.I):
            raise Refused("external_entity")
        try:
            return ET.fromstring(data)
        except ET.ParseError:
            raise Refused("corrupt") from None

    def targets(self, part: str) -> dict[str, str]:
        """Targets of a part's relationships within the package; others by their address."""
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
                if target.startswith(".."):
                    raise Refused("unsafe_name")
            out[r.get("Id", "")] = target
        return out


def _text(node: ET.Element) -> str:
    out = []

    def walk(n: ET.Element) -> None:
        if n.tag in UNREAD:
            return
        if n.tag == f"{W}r" and (n.find(f"{W}rPr/{W}vanish")) is not None:
            return
        if n.tag == f"{W}t":
            out.append(n.text or "")
        elif n.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            out.append(" ")
        for child in n:
            if n.tag != f"{W}pPr":
                walk(child)
        if n.tag == f"{W}p":
            out.append(" ")

    walk(node)
    return " ".join("".join(out).split())


def document_units(data: bytes) -> list[tuple]:
    """(role, level, section, text, table, row, column) of a Word file in order: heading, paragraph, list_item, cell."""
    package = Package(data)
    body = package.xml("word/document.xml", needed=True).find(f"{W}body")
    if body is None:
        raise Refused("corrupt")
    if any(n.tag in TRACKED for n in body.iter()):
        raise Refused("tracked_changes")
    styles, root = {}, package.xml("word/styles.xml")
    for s in root.iter(f"{W}style") if root is not None else ():
        one = lambda p: (x.get(f"{W}val") if (x := s.find(p)) is not None else None)  # noqa: E731, B023
        styles[s.get(f"{W}styleId")] = ((one(f"{W}name") or "").lower(), one(f"{W}basedOn"), one(f"{W}pPr/{W}outlineLvl"))

    def level(p: ET.Element) -> int:
        own = p.find(f"{W}pPr/{W}outlineLvl")
        if own is not None and (own.get(f"{W}val") or "").isdigit():
            return int(own.get(f"{W}val")) + 1 if int(own.get(f"{W}val")) < 9 else 0
        style = p.find(f"{W}pPr/{W}pStyle")
        at = style.get(f"{W}val") if style is not None else None
        for _ in range(20):
            if at not in styles:
                return 0
            name, up, outline = styles[at]
            if name == "title":
                return 1
            if m := re.fullmatch(r"heading ([1-9])", name):
                return int(m[1])
            if outline and outline.isdigit() and int(outline) < 9:
                return int(outline) + 1
            at = up
        return 0

    out, stack, tables = [], [], 0
    for node in body:
        if node.tag == f"{W}p":
            text = _text(node)
            if not text:
                continue
            if n := level(node):
                stack = [h for h in stack if h[0] < n] + [(n, text)]
                out.append(("heading", n, [h for _, h in stack[:-1]], text, None, None, None))
            else:
                role = "list_item" if node.find(f"{W}pPr/{W}numPr") is not None else "paragraph"
                out.append((role, None, [h for _, h in stack], text, None, None, None))
        elif node.tag == f"{W}tbl":
            for r, row in enumerate(node.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    out.append(("cell", None, [h for _, h in stack], _text(cell), tables, r, c))
            tables += 1
    if len(out) > UNITS:
        raise Refused("too_large")
    return out


def page_events(data: bytes) -> list[tuple]:
    """(unit, kind, words, row, cell) of a Word file in reading order, as operators.paging takes them: a unit for each paragraph of the body and each cell of its tables.

    words: how many begin in the text; a text that only goes on with a word is content without words (`object`). Hidden runs are not read. Rows are numbered through the file."""
    package = Package(data)
    body = package.xml("word/document.xml", needed=True).find(f"{W}body")
    if body is None:
        raise Refused("corrupt")
    out: list[tuple] = []
    on = lambda x: x is not None and x.get(f"{W}val") not in ("0", "false", "off")

    def read(node: ET.Element, at: tuple, gap: bool) -> bool:
        """Events of a node; gap: whether a word that comes next is a new one."""
        unit, row, cell = at
        if node.tag in OBJECTS:
            out.append((unit, "object", 0, row, cell))
        elif node.tag == f"{W}t":
            text = node.text or ""
            words = len(text.split()) - (not gap and not text[:1].isspace() and bool(text.strip()))
            if text.strip():
                out.append((unit, "text" if words else "object", words, row, cell))
            return text[-1].isspace() if text else gap
        elif node.tag == f"{W}lastRenderedPageBreak" or (node.tag == f"{W}br" and node.get(f"{W}type") == "page"):
            out.append((unit, "hard" if node.tag == f"{W}br" else "rendered", 0, row, cell))
            return gap or node.tag == f"{W}br"
        elif node.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            return True
        elif node.tag not in UNREAD and node.tag != f"{W}pPr" and not (node.tag == f"{W}r" and on(node.find(f"{W}rPr/{W}vanish"))):
            for child in node:
                gap = read(child, at, gap)
            return gap or node.tag == f"{W}p"
        return gap

    rows = 0
    for k, node in enumerate(body):
        if node.tag == f"{W}p":
            if on(node.find(f"{W}pPr/{W}pageBreakBefore")):
                out.append((f"{k}", "before", 0, None, None))
            read(node, (f"{k}", None, None), True)
        elif node.tag == f"{W}tbl":
            for r, row in enumerate(node.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    read(cell, (f"{k}/{r}/{c}", rows, c), True)
                rows += 1
    if len({e[0] for e in out}) > UNITS:
        raise Refused("too_large")
    return out


def document_statistics(data: bytes) -> list[tuple]:
    """(stored_pages, stored_words) that the program which saved a Word file left in it; null where there are none."""
    root = Package(data).xml("docProps/app.xml")
    found = ((root.findtext(f"{P}{name}") if root is not None else None) or "" for name in ("Pages", "Words"))
    return [tuple(int(x) if len(x) < 10 and x.isdecimal() else None for x in (x.strip() for x in found))]


def workbook_cells(data: bytes) -> list[tuple]:
    """(sheet, sheet_place, ref, kind, value, display, formula) of a workbook: number, date, text, boolean or error; empty cells have no row."""
    package = Package(data)
    book = package.xml("xl/workbook.xml", needed=True)
    if book.tag != f"{S}workbook":
        raise Refused("strict_format")
    flag = book.find(f"{S}workbookPr")
    base_1904 = flag is not None and flag.get("date1904") in ("1", "true")
    targets = package.targets("xl/workbook.xml")
    root = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for r in si for t in ([r] if r.tag == f"{S}t" else r.findall(f"{S}t") if r.tag == f"{S}r" else [])) for si in (root.findall(f"{S}si") if root is not None else ())]
    root, codes = package.xml("xl/styles.xml"), []
    if root is not None:
        own = {f.get("numFmtId"): f.get("formatCode") for f in root.iter(f"{S}numFmt")}
        codes = [own.get(x.get("numFmtId")) or formats.BUILT_IN.get(int(x.get("numFmtId") or 0), "General") for x in root.findall(f"{S}cellXfs/{S}xf")]
    sheets = book.findall(f"{S}sheets/{S}sheet")
    if len(sheets) > SHEETS:
        raise Refused("too_large")
    out = []
    for place, sheet in enumerate(sheets):
        for c in package.xml(targets.get(sheet.get(f"{R}id"), ""), needed=True).iter(f"{S}c"):
            v, f, kind = c.find(f"{S}v"), c.find(f"{S}f"), c.get("t", "n")
            raw = "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else v.text if v is not None else None
            formula = f.text if f is not None else None
            if raw in (None, "") and not formula:
                continue
            raw = raw or ""
            style = int(c.get("s") or 0)
            code = codes[style] if style < len(codes) else "General"
            try:
                if kind == "n" and raw:
                    number = float(raw)
                    of = "date" if formats.kind_of_format(code) in ("date", "time", "datetime") else "number"
                    row = (of, raw, formats.shown(number, code, base_1904) or raw)
                elif kind == "s":
                    row = ("text", shared[int(raw)], shared[int(raw)])
                elif kind == "b":
                    row = ("boolean", "TRUE" if raw == "1" else "FALSE", "TRUE" if raw == "1" else "FALSE")
                else:
                    row = ("error" if kind == "e" else "text", raw, raw)
            except (ValueError, IndexError):
                raise Refused("corrupt") from None
            out.append((sheet.get("name"), place, c.get("r"), *row, formula))
            if len(out) > CELLS:
                raise Refused("too_large")
    return out


def _read(files: DataFrame, reader, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    names = [n for n, _ in fields]
    schema = pa.schema([("path", pa.string()), ("place", pa.int32()), *fields, ("error", pa.string())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(path, k, *r, None) for k, r in enumerate(reader(data.as_py() or b""))]
                except Refused as why:
                    rows = [(path, None, *[None] * len(names), str(why))]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return files.select("path", "content").mapInArrow(run, f"path string, place int, {ddl}, error string")


def read_documents(files: DataFrame) -> DataFrame:
    """Units of Word files; files: path, content, as from the binaryFile source."""
    i, s = pa.int32(), pa.string()
    return _read(files, document_units, [("role", s), ("level", i), ("section", pa.list_(s)), ("text", s), ("tbl", i), ("row", i), ("col", i)], "role string, level int, section array<string>, text string, tbl int, row int, col int")


def read_page_events(files: DataFrame) -> DataFrame:
    """Page breaks of Word files as operators.paging takes them (path as scope, place as pos), or the reason of refusal; files: path, content."""
    i, s = pa.int32(), pa.string()
    found = _read(files, page_events, [("unit", s), ("kind", s), ("words", i), ("row", i), ("cell", i)], "unit string, kind string, words int, row int, cell int")
    return found.withColumnsRenamed({"path": "scope", "place": "pos"})


def read_statistics(files: DataFrame) -> DataFrame:
    """(scope, stored_pages, stored_words, error) of Word files; files: path, content."""
    i = pa.int32()
    return _read(files, document_statistics, [("stored_pages", i), ("stored_words", i)], "stored_pages int, stored_words int").drop("place").withColumnRenamed("path", "scope")


def read_workbooks(files: DataFrame) -> DataFrame:
    """Cells of workbooks; files: path, content."""
    i, s = pa.int32(), pa.string()
    return _read(files, workbook_cells, [("sheet", s), ("sheet_place", i), ("ref", s), ("kind", s), ("value", s), ("display", s), ("formula", s)], "sheet string, sheet_place int, ref string, kind string, value string, display string, formula string")


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of plain rows: numbers and texts; every member has the same time, so equal rows give equal bytes."""
    esc = lambda t: str(t).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")

    def letters(n: int) -> str:
        return (letters((n - 1) // 26) if n > 26 else "") + chr((n - 1) % 26 + 65)

    def cell(r: int, c: int, x) -> str:
        ref = f"{letters(c)}{r}"
        return "" if x is None else f'<c r="{ref}"><v>{x!r}</v></c>' if isinstance(x, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{esc(x)}</t></is></c>'

    parts = {"xl/workbook.xml": f'<workbook xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    for k, rows in enumerate(sheets.values(), 1):
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{S[1:-1]}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(cell(r, c, x) for c, x in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return held.getvalue()
