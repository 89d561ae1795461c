"""Workbooks: references, serial dates, formulas moved with their cell."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, COLUMNS = 1_048_576, 16_384


def column_number(letters: Column) -> Column:
    return F.aggregate(F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64), F.lit(0), lambda s, d: s * 26 + d)


def column_letters(number: Column) -> Column:
    """A, ..., Z, AA, ...: all letters of any whole number of an int, also past ZZZ, where no sheet has columns."""
    one = lambda n: F.when(n > 0, F.char((n - 1) % 26 + 65)).otherwise("")
    places = [number]
    for _ in range(6):
        places.insert(0, F.floor((places[0] - 1) / 26).cast("int"))
    return F.concat(*map(one, places))


def serial_date(serial: Column, base_1904: bool = False) -> Column:
    """A day of the 1900 system (with its 29 February 1900) or of the 1904 one."""
    day = F.floor(serial).cast("int")
    if base_1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), day)
    return F.when(day.between(1, 2_958_465), F.date_add(F.lit("1899-12-30").cast("date"), F.when(day < 60, day + 1).otherwise(day)))


REFERENCE = re.compile(r'"[^"]*"|\'[^\']*\'!?|\[[^\]]*\]|(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,7})(?![A-Za-z0-9_(.])')


def moved_formula(formula: str, down: int, right: int) -> str:
    """The formula as it reads when its cell moves: relative references follow, strings and quoted names stay."""

    def one(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        col = 0
        for c in m[2].upper():
            col = col * 26 + ord(c) - 64
        row = int(m[4])
        col, row = col + (0 if m[1] else right), row + (0 if m[3] else down)
        if not (1 <= col <= COLUMNS and 1 <= row <= ROWS):
            return "#REF!"
        letters = ""
        while col:
            col, r = divmod(col - 1, 26)
            letters = chr(65 + r) + letters
        return f"{m[1]}{letters}{m[3]}{row}"

    return REFERENCE.sub(one, formula)


@F.pandas_udf(T.StringType())
def moved(formula: pd.Series, down: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if f is None else moved_formula(f, int(d), int(r)) for f, d, r in zip(formula, down, right, strict=True)])
