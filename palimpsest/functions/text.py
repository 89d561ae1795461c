"""Text normalisation as column expressions, with Arrow twins where Unicode tables are needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signs written in several ways, and the way they are compared.
QUOTES, PLAIN_QUOTES = "‘’‚‛“”„‟«»", "''''\"\"\"\"\"\""
DASHES = "‐‑‒–—―−"
NO_WIDTH = "​‌‍⁠﻿"
NOT_PLAIN = r"[^ -~\u00BC-\u167F\u3001-\uFEFE]"  # all of these signs and white space but for the space, and some more


def normalize(c: Column) -> Column:
    """Signs unified, white space collapsed and trimmed; exact where NFKC changes nothing, see nfkc()."""
    c = F.translate(c, QUOTES + DASHES + NO_WIDTH, PLAIN_QUOTES + "-" * len(DASHES))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def as_normalized(c: Column) -> Column:
    """normalize() of a column that is cheap to read, such as a lambda's: most texts have nothing to unify and are only looked through."""
    odd = c.rlike(NOT_PLAIN) | c.contains("  ") | c.startswith(" ") | c.endswith(" ")
    return F.when(odd, normalize(c)).otherwise(c)


def key(c: Column, ignore_case: bool = True, ignore_punctuation: bool = False) -> Column:
    c = normalize(c)
    c = F.lower(c) if ignore_case else c
    return F.trim(F.regexp_replace(drop_punctuation(c), r"\s+", " ")) if ignore_punctuation else c


def drop_punctuation(c: Column) -> Column:
    """Punctuation goes, but not between two digits."""
    return F.regexp_replace(c, r"(?<!\p{Nd})\p{P}|\p{P}(?!\p{Nd})", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda x: x != "")


def excerpt(c: Column, most: int = 240) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def quoted(c: Column, most: int = 240) -> Column:
    """Cut at the last space, nothing appended."""
    head = F.substring(c, 1, most)
    at = F.regexp_extract(head, r"^(.*) ", 1)
    return F.when(F.length(c) <= most, c).when(at != "", at).otherwise(head)


def shorten(c: Column, most: int = 90) -> Column:
    """Cut at the last space if that keeps over 0.6 of the length."""
    head = F.substring(c, 1, most - 1)
    at = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.when(F.length(at) > 0.6 * most, at).otherwise(head), F.lit("…")))


def rejoined(lines: Column) -> Column:
    """An array of lines as one text; a word hyphenated at a line's end is joined if the next line starts in small letters."""
    return F.trim(F.replace(F.regexp_replace(F.array_join(lines, "\n"), r"(?U)(\w)[-‐‑]\n(?=[a-zà-ÿ])", "$1"), F.lit("\n"), F.lit(" ")))


def cited(words: Column, most: int = 240, tokens: int = 60) -> Column:
    """struct(text, n_tokens): the leading words that fit into so many characters and tokens, so that what is quoted is what is cited."""
    first = F.struct(F.lit("").alias("text"), F.lit(0).alias("n_tokens"), F.lit(True).alias("more"))

    def add(acc: Column, word: Column) -> Column:
        longer = F.when(acc["n_tokens"] == 0, word).otherwise(F.concat(acc["text"], F.lit(" "), word))
        fits = acc["more"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(acc["text"]).alias("text"), (acc["n_tokens"] + fits.cast("int")).alias("n_tokens"), fits.alias("more"))

    return F.aggregate(F.slice(words, 1, tokens), first, add, lambda acc: F.struct(acc["text"].alias("text"), acc["n_tokens"].alias("n_tokens")))


def attribute_tokens(c: Column) -> Column:
    """Words of a class or id, in small letters: split at signs and at capitals, and each group between spaces joined without signs."""
    apart = F.split(F.lower(F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z0-9]+")
    joined = F.transform(F.split(F.lower(c), r"\s+"), lambda g: F.regexp_replace(g, "[^a-z0-9]+", ""))
    return F.filter(F.array_union(apart, joined), lambda t: t != "")


def first_token(c: Column, names: list[str]) -> Column:
    """The least of the given names that is a token of a class or id, or null."""
    return F.array_min(F.array_intersect(attribute_tokens(c), F.array(*map(F.lit, names))))


def template(c: Column) -> Column:
    return F.regexp_replace(key(c), "[0-9]+", "#")


def is_page_number(c: Column) -> Column:
    return key(c).rlike(r"^(?:[0-9]+|page [0-9]+(?: (?:of|/) [0-9]+)?|- ?[0-9]+ ?-|[0-9]+ ?/ ?[0-9]+)$")


def csv_cell(c: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a quote before them; commas, quotes and line ends are quoted."""
    c = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(c.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def exact_key(c: Column) -> Column:
    """The key with compatibility forms and full case folding."""
    return casefold(normalize(nfkc(c)))
