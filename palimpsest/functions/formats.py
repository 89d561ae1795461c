"""Number formats of workbooks: what a format shows, and a value shown by it. Distinct formats are few, so each is read once a worker."""

from __future__ import annotations

import datetime
import functools
import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number formats that files name by number only, as the public file format standard lists them.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00",
    5: '"$"#,##0_);\\("$"#,##0\\)', 6: '"$"#,##0_);[Red]\\("$"#,##0\\)', 7: '"$"#,##0.00_);\\("$"#,##0.00\\)', 8: '"$"#,##0.00_);[Red]\\("$"#,##0.00\\)',
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    41: '_(* #,##0_);_(* \\(#,##0\\);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_);_("$"* \\(#,##0.00\\);_("$"* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
PART = re.compile(r'"(?P<quoted>[^"]*)"|\\(?P<escaped>.)|[_*](?P<pad>.)|\[(?P<bracket>[^\]]*)\]|(?P<meridiem>AM/PM|A/P)|(?P<general>General)|(?P<date>y+|m+|d+|h+|s+)|(?P<digits>[0#?][0#?,.]*(?:E[+-]0+)?|\.[0#?]+)|(?P<section>;)|(?P<other>.)', re.I | re.S)


@functools.cache
def sections(code: str) -> tuple[tuple[tuple[str, str], ...], ...]:
    """Sections of a format as (kind, text) parts."""
    out: list[list[tuple[str, str]]] = [[]]
    for m in PART.finditer(code):
        kind = m.lastgroup or "other"
        if kind == "section":
            out.append([])
        elif kind == "bracket" and re.fullmatch(r"(?i)h+|m+|s+", m[kind]):
            out[-1].append(("elapsed", m[kind].lower()))
        elif kind == "bracket":
            sign = re.match(r"\$([^-\]]*)", m[kind])
            out[-1].append(("quoted", sign[1] if sign else ""))
        else:
            out[-1].append((kind, m[kind]))
    return tuple(tuple(s) for s in out)


def kind_of_format(code: str | None) -> str:
    """general, number, percent, date, time, datetime or text, by the first section."""
    parts = sections(code or "General")[0]
    kinds = {k for k, _ in parts}
    letters = "".join(t.lower() for k, t in parts if k == "date")
    clock = bool(set(letters) & set("hs")) or "elapsed" in kinds or "meridiem" in kinds
    day = bool(set(letters) & set("yd")) or ("m" in letters and not clock)
    if day or clock:
        return "datetime" if day and clock else "date" if day else "time"
    if ("other", "%") in parts:
        return "percent"
    if ("other", "@") in parts:
        return "text"
    return "number" if "digits" in kinds else "general"


def general(x: float) -> str:
    """Up to 11 significant digits, without trailing zeros."""
    s = f"{x:.10E}" if x and not 1e-9 <= abs(x) < 1e11 else f"{x:.11g}"
    if "E" in s:
        mantissa, power = s.split("E")
        return f"{mantissa.rstrip('0').rstrip('.')}E{power}"
    return s if "e" not in s else f"{Decimal(s):f}"


def moment(serial: float, base_1904: bool = False) -> datetime.datetime | None:
    """The day and time of a serial number; day 60 of the 1900 system, which never was, counts as 28 February, as in the day before 1 March."""
    if not 0 <= serial <= 2_958_466:
        return None
    start = datetime.datetime(1904, 1, 1) if base_1904 else datetime.datetime(1899, 12, 31 if serial < 60 else 30)
    try:
        return start + datetime.timedelta(seconds=round(serial * 86400))
    except OverflowError:
        return None


def _digits(x: Decimal, pattern: str) -> str:
    body, _, power = pattern.upper().partition("E")
    scaled = body.rstrip(",")
    stripped, _, fraction = scaled.partition(".")
    x /= Decimal(1000) ** (len(body) - len(scaled))
    least = stripped.count("0")
    exponent = ""
    if power:
        e = x.adjusted() if x else 0
        x, exponent = x.scaleb(-e), f"E{'-' if e < 0 else '+' if '+' in power else ''}{abs(e):0{power.count('0')}d}"
    x = x.quantize(Decimal(1).scaleb(-len(fraction)), ROUND_HALF_UP)
    left, _, right = f"{x:f}".partition(".")
    left = left.lstrip("0").rjust(least, "0")
    if "," in stripped:
        left = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", left)
    while right and fraction[len(right) - 1] in "#" and right[-1] == "0":
        right = right[:-1]
    return left + ("." + right if right else "") + exponent


def _dated(parts: tuple[tuple[str, str], ...], serial: float, base_1904: bool) -> str | None:
    t = moment(serial, base_1904)
    if t is None:
        return None
    half = any(k == "meridiem" for k, _ in parts)
    clock = [(n, x.lower()) for n, (k, x) in enumerate(parts) if k in ("date", "elapsed")]
    place = {n: p for p, (n, _) in enumerate(clock)}
    out = []
    for n, (k, x) in enumerate(parts):
        low, size = x.lower(), len(x)
        if k == "elapsed":
            total = round(serial * 86400)
            out.append(f"{total // {'h': 3600, 'm': 60, 's': 1}[low[0]]:0{size}d}")
        elif k == "date":
            p = place[n]
            minutes = low[0] == "m" and size < 3 and ((p and clock[p - 1][1][0] == "h") or (p + 1 < len(clock) and clock[p + 1][1][0] == "s"))
            if low[0] == "y":
                out.append(f"{t.year:04d}" if size > 2 else f"{t.year % 100:02d}")
            elif low[0] in "md" and size >= 3 and not minutes:
                out.append(t.strftime(("%b" if size == 3 else "%B") if low[0] == "m" else ("%a" if size == 3 else "%A")))
            else:
                value = t.minute if minutes else {"m": t.month, "d": t.day, "h": (t.hour % 12 or 12) if half else t.hour, "s": t.second}[low[0]]
                out.append(f"{value:0{min(size, 2)}d}")
        elif k == "meridiem":
            out.append("AM" if t.hour < 12 else "PM")
        elif k != "pad":
            out.append(x)
    return "".join(out)


def shown(value: float | None, code: str | None, base_1904: bool = False) -> str | None:
    """A number as its format shows it: sections for positive, negative, zero; null where a date has no day."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return None
    every = sections(code or "General")
    own = kind_of_format(code)
    if own in ("date", "time", "datetime"):
        return _dated(every[0], value, base_1904)
    pick = 1 if value < 0 and len(every) > 1 else 2 if value == 0 and len(every) > 2 else 0
    parts = every[pick]
    kinds = [k for k, _ in parts]
    if own == "text" or "general" in kinds:
        return "".join(general(value) if k == "general" or (k, x) == ("other", "@") else x for k, x in parts if k != "pad")
    x = abs(Decimal(repr(float(value)))) * (100 if ("other", "%") in parts else 1)
    sign, done, out = "-" if value < 0 and pick != 1 else "", False, []
    for k, text in parts:
        if k == "digits" and not done:
            out.append(_digits(x, text))
            done = True
        elif k not in ("digits", "pad"):
            out.append(text)
    got = "".join(out)
    return sign + got if sign and re.search(r"[1-9]", got) else got


@F.pandas_udf(T.StringType())
def format_kind(code: pd.Series) -> pd.Series:
    return code.map(lambda c: kind_of_format(None if c is None or c != c else c))


@F.pandas_udf(T.StringType())
def rendered(value: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([shown(None if v is None or v != v else float(v), None if c is None or c != c else c) for v, c in zip(value, code, strict=True)], dtype=object)
