"""Evidence on pages, and addresses with their networks, against walks and the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from palimpsest.functions import addresses, urls
from palimpsest.operators import evidence

R = random.Random(6)


def test_page_issues(spark):
    documents = spark.createDataFrame([(1, "old", "f"), (1, "new", "g")], "scope int, side string, fingerprint string")
    pages = spark.createDataFrame([(1, "old", 1, 100.0, 200.0), (1, "new", 1, 100.0, 200.0)], "scope int, side string, page int, width double, height double")
    words = spark.createDataFrame([(1, "old", 1, f"p1-{k}", w) for k, w in enumerate(["The", "fee", "is", "$5"])], "scope int, side string, page int, word string, text string")
    box = (0.0, 0.0, 100.0, 200.0)
    claims = [
        ("fine", "old", "f", 1, ["p1-1", "p1-2"], box, "The  fee is $5"),
        ("part", "old", "f", 1, ["p1-0", "p1-1", "p1-2"], None, "fee is"),
        ("edge", "old", "f", 1, [], (-1.0, -1.0, 101.0, 201.0), None),
        ("out", "old", "f", 1, None, (0.0, 0.0, 100.0, 201.5), ""),
        ("left", "old", "f", 1, None, (-1.5, 0.0, 1.0, 1.0), ""),
        ("lost", "old", "f", 1, ["p1-1", "p9-1", None, "p1-9"], None, "fee"),
        ("order", "old", "f", 1, ["p1-3", "p1-1"], None, "fee is $5"),
        ("other", "new", "x", 1, None, None, None),
        ("page", "old", "f", 7, ["p1-1"], (-50.0, 0.0, 1.0, 1.0), "no"),
        ("nothing", "gone", None, 1, None, None, None),
    ]
    df = spark.createDataFrame([(1, c, 0, *rest) for c, *rest in claims], "scope int, change_id string, nth int, side string, fingerprint string, page int, words array<string>, box struct<x0:double,y0:double,x1:double,y1:double>, excerpt string")
    got = sorted((r.change_id, r.issue, r.word or "") for r in evidence.page_issues(df, documents, pages, words).collect())
    assert got == sorted([("out", "box_outside", ""), ("left", "box_outside", ""), ("lost", "no_word", "p9-1"), ("lost", "no_word", "p1-9"), ("order", "not_quoted", ""), ("other", "other_document", ""), ("page", "no_page", ""), ("nothing", "no_page", "")])
    assert evidence.page_issues(df.where("scope = 2"), documents, pages, words).count() == 0


def shown(n, version):
    a = ipaddress.ip_address(n) if version == 4 else ipaddress.IPv6Address(n)
    return R.choice([str(a), a.exploded.upper(), f"[{a}]" if version == 6 else str(a)])


def number(text):
    if "%" in text:
        return None
    try:
        a = ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return None
    return int(a) if a.version == 6 else int(a) + (0xFFFF << 32)


def test_addresses(spark):
    texts = [shown(R.getrandbits(R.choice([8, 40, 64, 100, 128])), 6) for _ in range(150)] + [shown(R.getrandbits(32), 4) for _ in range(50)]
    texts += ["::", "::1", "1::", "1::8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::10.0.0.1", "1:2:3:4:5:6:1.2.3.4"]
    texts += ["", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", ":1:2:3:4:5:6:7", "12345::", "g::", "1.2.3", "1.2.3.256", "fe80::1%eth0", "1:2:3:4:5:6:7::8:9", "example.com", ":::"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    got = {r.k: None if r.a is None else (r.a.high % (1 << 64)) << 64 | r.a.low % (1 << 64) for r in df.select("k", addresses.address(F.col("t")).alias("a")).collect()}
    assert got == {k: number(t) if t is not None else None for k, t in enumerate([*texts, None])}


def test_longest_prefix(spark):
    nets = ["::/0", "2001:db8::/32", "2001:db8:8000::/33", "2001:db8::1/128", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32", "1.2.3.4"]
    texts = [str(ipaddress.IPv6Address((0x20010DB8 << 96) + R.getrandbits(96))) for _ in range(40)] + [str(ipaddress.ip_address((10 << 24) + R.getrandbits(24))) for _ in range(40)] + ["10.1.2.3", "10.1.9.9", "2001:db8::1", "1.2.3.4", "::5", "2001:db8::1"]
    table = addresses.networks(spark.createDataFrame([(n,) for n in [*nets, "nonsense", "10.0.0.0/99"]], "network string"))
    own = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("a", addresses.address(F.col("t"))).select("k", "a.high", "a.low")
    wide = [(n, ipaddress.ip_network(n)) for n in nets]
    size = lambda n: n.prefixlen + (96 if n.version == 4 else 0)
    first = lambda n: int(n.network_address) + (0xFFFF << 32 if n.version == 4 else 0)
    want = {k: max((x for x in wide if number(t) >> (128 - size(x[1])) == first(x[1]) >> (128 - size(x[1]))), key=lambda x: size(x[1]), default=(None,))[0] for k, t in enumerate(texts)}
    found = addresses.longest_prefix(own, table)
    assert {r.k: r.network for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [r.network for r in addresses.longest_prefix(own.where("k = 0"), table.where("bits > 200")).collect()] == [None]


def test_closed_hosts_of_both_families(spark):
    cases = {"http://[::1]/": "address", "http://[::ffff:10.0.0.1]/x": "address", "http://[fe80::1]:80/": "address", "http://[2606:4700::1]/": None, "http://10.0.0.1/": "address", "https://93.184.216.34/": None, "https://example.com/": None, "http://[64:ff9b::8.8.8.8]/": "address"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.p for r in df.select("u", urls.problem(F.col("u")).alias("p")).collect()} == cases
