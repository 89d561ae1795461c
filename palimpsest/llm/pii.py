"""PII (operator 4): offset-preserving deobfuscation.

Personal data are found twice: in the text as it stands (base spans), and in what transducers make of it: homoglyphs become
ASCII, spelled digits digits, disguised at and dot signs real ones. Every character of the normalised text knows the source characters
it came from, so what is found there is reported in source offsets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from each, so later ones need no try.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
# Names of the digits.
SPELLED = [
    "zero one two three four five six seven eight nine".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
]
DIGIT_OF = {name: str(k) for names in SPELLED for k, name in enumerate(names)} | {"oh": "0", "zwo": "2"}
NAME = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
LEAST_SPELLED = 4  # digits in a row; fewer are ordinary words


def _wide() -> dict[str, str]:
    """Compatibility forms of single ASCII characters: full-width, mathematical, circled; digits of all scripts."""
    out = dict(LOOKALIKES)
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.decimal(c))
        elif len(k := unicodedata.normalize("NFKC", c)) == 1 and "!" <= k <= "~":
            out.setdefault(c, k)
    return out


GLYPHS = _wide() | dict.fromkeys(INVISIBLE, "")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
SPELLED_RUN = re.compile(rf"(?<!\w)(?:{NAME})(?:[ ,.-]{{1,2}}(?:{NAME})){{{LEAST_SPELLED - 1},}}(?!\w)", re.IGNORECASE)
SPELLED_ONE = re.compile(NAME, re.IGNORECASE)
WORD = re.compile(r"\w+")
PART = re.compile(rf"{NAME}|[0-9]+", re.IGNORECASE)
MIXED_RUN = re.compile(rf"(?<!\w)(?:{NAME}|[0-9]{{1,19}})(?:[ ,.-]{{1,2}}(?:{NAME}|[0-9]{{1,19}}))+(?!\w)", re.IGNORECASE)
AT_SHUT, DOT_SHUT = (rf"\s{{0,3}}[\[({{<]\s{{0,3}}{w}\s{{0,3}}[\])}}>]\s{{0,3}}" for w in ("(?:at|@)", r"(?:dot|\.)"))
DOT = re.compile(rf"{DOT_SHUT}|(?<=[A-Za-z0-9])\s{{1,3}}dot\s{{1,3}}(?=[A-Za-z0-9])", re.IGNORECASE)
AT = re.compile(AT_SHUT, re.IGNORECASE)
BARE_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,9})", re.IGNORECASE)
#: A name, a plain "at" and a domain with a last label of letters, where nothing else is in disguise.
NAMED_AT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\s{1,3}at\s{1,3}(?!www\.)(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-]|\.[A-Za-z0-9]))", re.IGNORECASE)
#: Words that stand before "at" in plain prose: a place on the web follows them, no address.
NO_NAMES = frozenset("a all am an and any anyone are arrive arrived available be been being both but buy by call came check click come do done down each find for found get go good had has have he held her here him his hosted how i is it its join just keep laugh learn listed live located look looked looking made me meet met more most my news no not now of off on one online only or order ordered our out over page pages part people published read register registered sale see seen she shop sign sit site so sold some start started stay still stop store than that the their them then there these they this those to tried up us visit was watch we website were when where which while who with work worked works you your".split())
PLUS = re.compile(rf"(?<!\w)plus[ ,-]{{1,2}}(?=(?:{NAME}|[0-9]{{1,19}})(?!\w))", re.IGNORECASE)


def disguised(text: str) -> bool:
    """Whether any transducer could change the text, true wherever one does; cheap for the many texts where none can."""
    if not text.isascii() and not GLYPHS.keys().isdisjoint(NON_ASCII.findall(text)):
        return True
    lower = text.lower()
    if "at" in lower and "." in text and any(True for _ in named_at(text)) or "plus" in lower and PLUS.search(text):
        return True
    bracket = any(b in text for b in "[({<")
    if (bracket or "dot" in lower) and DOT.search(text) or bracket and AT.search(text):
        return True
    return not DIGIT_OF.keys().isdisjoint(WORD.findall(lower)) and any(_mixed(m) for m in MIXED_RUN.finditer(text))


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index in KINDS, start, end), in that order."""
    out, least = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            a = m.start()
            while a > least and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                least = m.end()
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Mapped:
    """A text and, for each character, the source characters from `first` to `last` (exclusive) that it stands for."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = False

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> None:
        """edits: (start, end, what stands there instead), in order, apart."""
        text, first, last, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            at = b
        if at or text:
            self.changed = True
            self.text = "".join(text) + self.text[at:]
            self.first, self.last = first + self.first[at:], last + self.last[at:]


def _digits(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """A run of spelled digits: each name its digit, the separators nothing."""
    at = m.start()
    for d in SPELLED_ONE.finditer(m.string, m.start(), m.end()):
        yield at, d.end(), DIGIT_OF[d[0].lower()]
        at = d.end()


def _mixed(m: re.Match) -> list[tuple[int, int, str]]:
    """A run of names and figures of LEAST_SPELLED digits or more: each name its digit, the separators beside names nothing. Where
    that gives an address, full stops stay."""
    parts = [(*d.span(), DIGIT_OF.get(d[0].lower())) for d in PART.finditer(m.string, m.start(), m.end())]
    if all(new is None for _, _, new in parts) or sum(1 if new else b - a for a, b, new in parts) < LEAST_SPELLED:
        return []

    def edits(stops: bool) -> Iterator[tuple[int, int, str]]:
        at, spelled = m.start(), False
        for a, b, new in parts:
            if at < a and stops and "." in m.string[at:a]:
                yield at, a, "."
            elif at < a and (spelled or new):
                yield at, a, ""
            if new:
                yield a, b, new
            at, spelled = b, new is not None

    with_stops, run = list(edits(True)), Mapped(m.string[m.start() : m.end()])
    run.rewrite((a - m.start(), b - m.start(), new) for a, b, new in with_stops)
    return with_stops if any(k == 1 for k, _, _ in base_spans(run.text)) else list(edits(False))


def named_at(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of plain "at" between a name and a domain."""
    return ((m.end(1), m.end(), "@") for m in NAMED_AT.finditer(text) if m[1].lower().strip(".") not in NO_NAMES)


def stopped(text: str) -> Mapped:
    """The transducers with dots and at signs before the digits, whose runs then may hold figures and full stops."""
    x = Mapped(text)
    x.rewrite((*m.span(), GLYPHS[m[0]]) for m in NON_ASCII.finditer(text) if m[0] in GLYPHS)
    x.rewrite((*m.span(), ".") for m in DOT.finditer(x.text))
    x.rewrite((*m.span(), "@") for m in AT.finditer(x.text))
    x.rewrite(named_at(x.text))
    x.rewrite((*m.span(), "+") for m in PLUS.finditer(x.text))
    x.rewrite(e for m in MIXED_RUN.finditer(x.text) for e in _mixed(m))
    return x


def normalised(text: str) -> Mapped:
    """The transducers in a row: glyphs, spelled plus signs and digits, dots, at signs."""
    x = Mapped(text)
    x.rewrite((*m.span(), GLYPHS[m[0]]) for m in NON_ASCII.finditer(text) if m[0] in GLYPHS)
    x.rewrite((*m.span(), "+") for m in PLUS.finditer(x.text))
    x.rewrite(e for m in SPELLED_RUN.finditer(x.text) for e in _digits(m))
    had_dot = x.text
    x.rewrite((*m.span(), ".") for m in DOT.finditer(x.text))
    if x.text != had_dot:  # a plain word "at" counts only where a dot was in disguise
        x.rewrite((*m.span(), "@") for m in BARE_AT.finditer(x.text))
    x.rewrite(named_at(x.text))
    x.rewrite((*m.span(), "@") for m in AT.finditer(x.text))
    return x


def all_spans(text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Base spans and those of the normalised text that differ from all of them; these may hold a base span or a part of one."""
    base = base_spans(text) if base is None else base
    if not disguised(text):
        return base
    x, y = normalised(text), stopped(text)
    found = {(k, x.first[a], x.last[b - 1]) for k, a, b in base_spans(x.text)} if x.changed else set()
    for k, a, b in base_spans(y.text) if y.changed else ():
        span = k, y.first[a], y.last[b - 1]
        digits = sum(c.isdigit() for c in y.text[a:b])  # a lone name beside a whole number ("... 1373 Un") is a word
        if not any(k == n and p < span[2] and span[1] < q and digits < 2 + sum(c.isdigit() for c in text[p:q]) for n, p, q in base):
            found.add(span)
    return sorted(base + [*found.difference(base)])


def masked(text: str) -> str:
    """The text with [EMAIL], [IP], [CARD] or [PHONE] for each stretch of spans, named by the first of its kinds."""
    out, at, reach = [], 0, -1
    for a, b, k in sorted((a, b, k) for k, a, b in all_spans(text)):
        if a >= reach:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = reach = max(reach, b)
    return "".join(out) + text[at:]


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); reads doc_id, text (null: empty).

    The counts and base_sha256 are of base spans; spans holds these and n_added more, in code points of the source, by
    kind and start.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def rows(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in schema.names} | {"doc_id": batch.column(0)}
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            every = all_spans(text, base)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(_line(base).encode()).hexdigest())
            out["spans"].append(_line(every))
            out["n_added"].append(len(every) - len(base))
        return out

    return common.map_batches(common.texts(docs), rows, schema, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    return find_pii(common.documents(spark, sf_dir))
