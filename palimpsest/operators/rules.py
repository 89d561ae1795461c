"""Versioned tables of phrases over texts: one automaton for all phrases, matches with their places, precedence as data.

A rule table has rows (label, phrase, version, precedence); it is small data that its owner edits, so it goes to the driver, MOST rows at most, and from there, as a list, to the tasks. Each
worker builds the automaton once for a table. A text is then read once, whatever the number of phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 100_000
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")  # signs that a phrase may not stand within; as in \\b of most SQL engines, letters of ASCII only
FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("precedence", T.IntegerType()), T.StructField("version", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("phrase", T.StringType())]))

_built: dict[str, ahocorasick.Automaton] = {}


def listed(rules: DataFrame) -> list[tuple[str, str, str, int]]:
    """(label, phrase, version, precedence) of a rule table, phrases in small letters; rows without a label or phrase are left out, repeated ones count once."""
    rows = rules.select("label", F.lower("phrase").alias("phrase"), F.coalesce(F.col("version").cast("string"), F.lit("")).alias("version"), F.coalesce(F.col("precedence").cast("int"), F.lit(0)).alias("precedence"))
    rows = rows.where("label is not null and phrase <> ''").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a rule table has {MOST} phrases at most")
    return sorted(tuple(r) for r in rows)


def _automaton(rules: list[tuple[str, str, str, int]]) -> ahocorasick.Automaton:
    name = hashlib.sha1(repr(rules).encode()).hexdigest()
    if name not in _built:
        _built.clear()
        by: dict[str, list] = {}
        for label, phrase, version, precedence in rules:
            by.setdefault(phrase, []).append((label, precedence, version))
        made = ahocorasick.Automaton()
        for phrase, own in by.items():
            made.add_word(phrase, (len(phrase), own))
        made.make_automaton()
        _built[name] = made
    return _built[name]


def lowered(text: str) -> str:
    """In small letters, sign by sign, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def first_matches(text: str, made: ahocorasick.Automaton) -> list[dict]:
    """Each label's first match that doesn't stand within a word, of those that begin there the longest."""
    low, found = lowered(text), {}
    for end, (size, own) in made.iter(low):
        a, b = end - size + 1, end + 1
        if (a and low[a - 1] in WORD and low[a] in WORD) or (b < len(low) and low[b] in WORD and low[end] in WORD):
            continue
        for label, precedence, version in own:
            if label not in found or (a, -b) < (found[label][0], -found[label][1]):
                found[label] = a, b, precedence, version
    return [{"label": k, "precedence": p, "version": v, "start": a, "stop": b, "phrase": text[a:b]} for k, (a, b, p, v) in sorted(found.items(), key=lambda x: (x[1][2], x[0]))]


def matches(text: Column, rules: list[tuple[str, str, str, int]]) -> Column:
    """array<struct<label, precedence, version, start, stop, phrase>>: each label once, in order of precedence; empty for a null text or without rules."""

    @F.pandas_udf(FOUND)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = _automaton(rules) if rules else None
        for some in parts:
            yield pd.Series([first_matches(t, made) if t and made else [] for t in some])

    return find(text)


def signals(df: DataFrame, rules: list[tuple[str, str, str, int]], text: str, heading: str | None = None) -> DataFrame:
    """df with a row for each label that its heading or its text has a phrase of: label, source, phrase, start, stop, version, precedence. What the heading says comes before what the text
    says of the same label."""
    of = lambda c, source: F.transform(matches(F.col(c), rules), lambda m: F.struct(m["precedence"].alias("precedence"), m["label"].alias("label"), F.lit(source).alias("source"), m["phrase"].alias("phrase"), m["start"].alias("start"), m["stop"].alias("stop"), m["version"].alias("version")))
    names = df.columns
    if heading is None:
        return df.withColumn("_m", F.explode(of(text, "text"))).select(*names, "_m.label", "_m.source", "_m.phrase", "_m.start", "_m.stop", "_m.version", "_m.precedence")
    both = df.withColumns({"_h": of(heading, "heading"), "_t": of(text, "text")})
    rest = F.filter("_t", lambda t: ~F.exists("_h", lambda h: h["label"] == t["label"]))
    return both.withColumn("_m", F.explode(F.array_sort(F.concat("_h", rest)))).select(*names, "_m.label", "_m.source", "_m.phrase", "_m.start", "_m.stop", "_m.version", "_m.precedence")


def category(text: Column, rules: list[tuple[str, str, str, int]]) -> Column:
    """struct(label, precedence, version, start, stop, phrase) of the label of the least precedence that the text has a phrase of, ties by label; null without any."""
    return F.get(matches(text, rules), F.lit(0))


def table(spark, rows: list[tuple[str, str]], version: str) -> DataFrame:
    """A rule table of (label, phrase) in order of precedence of the labels."""
    order = {label: k for k, label in enumerate(dict.fromkeys(label for label, _ in rows))}
    return spark.createDataFrame([(label, phrase, version, order[label]) for label, phrase in rows], "label string, phrase string, version string, precedence int")
