"""Phrases of rule tables in texts, against one regular expression for each label."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import classify, rules

R = random.Random(9)
ROWS = [("money", "fee"), ("money", "late fee"), ("money", "fees"), ("exit", "cancel"), ("exit", "right to cancel"), ("data", "third-party"), ("data", "c++"), ("odd", "straße"), ("exit", "fee")]


@pytest.fixture(scope="module")
def table(spark):
    return rules.listed(rules.table(spark, ROWS, "7"))


def expected(text):
    out = []
    for k, label in enumerate(dict.fromkeys(x for x, _ in ROWS)):
        own = sorted((p for x, p in ROWS if x == label), key=len, reverse=True)
        edge = lambda p: (r"(?<![A-Za-z0-9_])" if re.match("[a-z0-9_]", p) else "") + re.escape(p) + (r"(?![A-Za-z0-9_])" if re.search("[a-z0-9_]$", p) else "")
        found = [m for p in own for m in [re.search(edge(p), text, re.IGNORECASE)] if m]
        if found:
            m = min(found, key=lambda m: (m.start(), -m.end()))
            out.append((label, k, "7", m.start(), m.end(), m.group()))
    return out


def test_matches(spark, table):
    words = ["Fee", "late", "fees", "coffee", "cancel", "right", "to", "third-party", "C++", "Straße", "x_fee", "İ", ",", "fee_2"]
    texts = [" ".join(R.choice(words) for _ in range(R.randint(0, 9))) for _ in range(200)] + ["", None, "right to cancel", "late fee", "fee", "FEES"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: [tuple(m) for m in r.m] for r in df.select("k", rules.matches(F.col("t"), table).alias("m")).collect()}
    assert got == {k: expected(t or "") for k, t in enumerate(texts)}
    for k, own in got.items():
        assert all(texts[k][a:b] == p for *_, a, b, p in own)


def test_heading_before_text(spark, table):
    df = spark.createDataFrame([(4, "third-party C++", "cancel it"), (1, "a fee to cancel", "Late Fee"), (2, "nothing", None), (3, None, "Cancel")], "k int, t string, h string")
    got = [(r.k, r.label, r.source, r.phrase, r.version) for r in rules.signals(df, table, "t", "h").orderBy("k", "precedence").collect()]
    assert got == [(1, "money", "heading", "Late Fee", "7"), (1, "exit", "heading", "Fee", "7"), (3, "exit", "heading", "Cancel", "7"), (4, "exit", "heading", "cancel", "7"), (4, "data", "text", "third-party", "7")]
    assert rules.signals(df, table, "t").where("k = 1").count() == 2 and rules.signals(df, [], "t", "h").count() == 0


def test_precedence_is_data(spark, table):
    df = spark.createDataFrame([("cancel the fee",)], "t string")
    one = lambda rows: df.select(rules.category(F.col("t"), rows).alias("c")).first().c
    assert one(table).label == "money"
    assert one([(label, p, "8", -k) for label, p, _, k in table])[:3] == ("exit", -1, "8") and one([]) is None


def test_tables_are_bounded_and_cleaned(spark, monkeypatch):
    df = spark.createDataFrame([("a", "X", None, None), ("a", "x", None, None), (None, "y", "1", 1), ("b", None, "1", 1), ("b", "", "1", 1)], "label string, phrase string, version string, precedence int")
    assert rules.listed(df) == [("a", "x", "", 0)]
    monkeypatch.setattr(rules, "MOST", 1)
    with pytest.raises(ValueError):
        rules.listed(spark.createDataFrame([("a", "x", "", 0), ("b", "y", "", 0)], df.schema))


def test_topics_say_why(spark):
    df = spark.createDataFrame([(1, "We may share data with third parties.", "Privacy")], "k int, t string, h string")
    got = [(r.topic, r.source, r.phrase, r.rules_version) for r in classify.topics(df, "t", "h").orderBy("topic").collect()]
    assert got == [("data_sharing", "text", "share data", classify.VERSION), ("privacy", "heading", "Privacy", classify.VERSION)]
