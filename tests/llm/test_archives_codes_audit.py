"""WARC archives, vector codes and the source audit on small tables with every awkward row, against brute force."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import divergence, vector_codes, warc

R = random.Random(8)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# --- archives

PAGES = [(k, f"http://a.example/{k}", f"<p>{k % 7} {'x' * (k * 37 % 900)}</p>") for k in range(60)]
PAGES += [(100 + k, "http://copy.example/", "<p>the same</p>") for k in range(40)]
PAGES += [(200, None, None), (201, "http://e.example/", ""), (202, "http://é.example/a b\r\nX: y", "ünï 日本\r\n\r\nWARC/1.1\r\n"), (203, "", "\x1f\x8b\x08"), (204, "u", "long " * 400_000), (None, "no id", "x"), (-5, "neg", "<p>the same</p>")]
PAGES += [(139, "http://again.example/", "<p>the same</p>"), (7, "http://a.example/7", PAGES[7][2])]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumns({"digest": F.lit(1), "first": F.lit("x"), "refers_to": F.lit("y"), "archive": F.lit(0)}).repartition(5).cache()


def expected_pages():
    own = [(i, (h or "").encode()) for i, _, h in PAGES if i is not None]
    first = {}
    for i, b in own:
        first[b] = max(first.get(b, i), i)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    return sorted(((i, len(b), digest(b), "response" if first[b] == i else "revisit", None if first[b] == i else first[b], None) for i, b in own), key=str)


@pytest.mark.parametrize("size", [1 << 30, 2000])
def test_pages_round_trip(spark, pages, tmp_path, size):
    folder = f"file://{tmp_path}/w"
    done = warc.write_archives(pages, folder, archive_bytes=size).collect()
    assert sum(r.records for r in done) == len(expected_pages()) and sorted(os.listdir(tmp_path / "w")) == sorted(r.archive for r in done)
    assert all(os.path.getsize(tmp_path / "w" / r.archive) == r.bytes for r in done) and (len(done) > 10) == (size == 2000)
    got = warc.read_archives(spark, folder, [r.archive for r in done])
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error") == expected_pages()
    whole = gzip.decompress((tmp_path / "w" / done[0].archive).read_bytes())  # any gzip reader sees the records in a row
    assert whole.count(b"WARC/1.1\r\nWARC-Type:") == done[0].records + 1


def test_short_payloads_are_never_revisits(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    done = warc.write_archives(pages, folder, least=15).collect()
    got = warc.read_archives(spark, folder, [r.archive for r in done]).collect()
    assert {r.record_type for r in got if r.payload_bytes < 15} == {"response"} and any(r.record_type == "revisit" for r in got)


def test_no_pages(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    assert warc.write_archives(pages.where("page_id = -99"), folder).count() == 0
    assert warc.read_archives(spark, folder, []).count() == 0


def archive(*records):
    return b"".join(records)


def test_members_of_any_cut():
    """The place where the source's blocks end makes no difference."""
    raw = archive(*(warc.page_record(k, "u", b"p" * k, None) for k in (0, 1, 30_000)), warc.page_record(9, None, b"p", 1))

    class Slow(io.BytesIO):
        def read(self, n):
            return super().read(R.randint(1, 40))

    want = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for _, r, e in warc.read_archive(io.BytesIO(raw)) if not e]
    assert want == [(0, 0, "response", None), (1, 1, "response", None), (30_000, 30_000, "response", None), (9, 1, "revisit", 1)]
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for _, r, e in warc.read_archive(Slow(raw)) if not e] == want


@pytest.mark.parametrize(
    "change, fault",
    [
        (lambda m: m.replace(b"payload two", b"payload 2.."), "block digest differs"),
        (lambda m: m.replace(b"WARC/1.1", b"WARC/9.9"), "no record"),
        (lambda m: re.sub(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", b"\r\nContent-Length: 999\r\n\r\nHTTP", m), "content shorter than stated"),
        (lambda m: re.sub(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", b"\r\nContent-Length: 20\r\n\r\nHTTP", m), "no end of the record"),
        (lambda m: re.sub(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", b"\r\nContent-Length: x\r\n\r\nHTTP", m), "no content length"),
        (lambda m: m.replace(b"<urn:x-page:2>", b"<urn:other:2>"), "record of no page"),
        (lambda m: re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", m.replace(b"payload two", b"payload 2..")), "payload digest differs"),
        (lambda m: re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", m.replace(b"-Length: 11", b"-Length: 12")), "payload shorter or longer than stated"),
    ],
)
def test_damaged_records_are_named_and_passed(change, fault):
    middle = gzip.compress(change(gzip.decompress(warc.page_record(2, "u", b"payload two", None))))
    raw = archive(warc.page_record(1, "u", b"one", None), middle, warc.page_record(3, "u", b"three", None))
    got = [(r and r["page_id"], e) for _, r, e in warc.read_archive(io.BytesIO(raw))]
    assert got == [(1, None), (None, fault), (3, None)]


def test_damaged_members_are_named_and_passed():
    one, three = warc.page_record(1, "u", b"one", None), warc.page_record(3, "u", b"three", None)
    two = bytearray(warc.page_record(2, "u", bytes(R.randbytes(60_000)), None))
    two[30_000:30_010] = b"\xff" * 10
    got = [(r and r["page_id"], e) for _, r, e in warc.read_archive(io.BytesIO(archive(one, bytes(two), three)))]
    assert got[0] == (1, None) and got[-1] == (3, None) and {e for _, e in got[1:-1]} == {"damaged member"}
    assert [(r and r["page_id"], e) for _, r, e in warc.read_archive(io.BytesIO(archive(one, b"rubbish", three)))] == [(1, None), (None, "no member"), (3, None)]
    assert [(r and r["page_id"], e) for _, r, e in warc.read_archive(io.BytesIO(archive(one, three)[:-9]))] == [(1, None), (None, "cut short")]
    assert [e for _, _, e in warc.read_archive(io.BytesIO(b"plain text"))] == ["no member"] and not [*warc.read_archive(io.BytesIO(b""))]


def test_a_long_record_is_not_held_whole():
    import tracemalloc

    raw = warc.page_record(1, "u", b"a" * (64 << 20), None)
    tracemalloc.start()
    assert [r["payload_bytes"] for _, r, _ in warc.read_archive(io.BytesIO(raw))] == [64 << 20]
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


# --- vector codes

DIMS = 32


def vectors():
    g = np.random.default_rng(3)
    out = [(int(k), g.standard_normal(DIMS).round(3).tolist(), int(k) % 3 or None) for k in g.permutation(90)]
    out += [(200 + k, out[4][1], 9) for k in range(20)]  # a group of copies
    out += [(300, None, 1), (301, [None] + [0.5] * (DIMS - 1), 1), (302, [float("nan")] + [0.5] * (DIMS - 1), 1), (303, [float("inf")] * DIMS, 1), (304, [0.0] * DIMS, 1), (305, [], 1), (None, [1.0] * DIMS, 1), (306, [1.0] * (DIMS + 1), 1)]
    out += [(-3, [-0.001] * DIMS, None), (400, [1e30] * DIMS, 5), (401, [-1e300] * DIMS, 5), (5, [9.0] * DIMS, 2), (5, [-9.0] * DIMS, 2)]
    return out


def coded(data, parts, entries, rounds, dims=DIMS):
    fine = [(i, v, g) for i, v, g in data if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(Fraction(x) * 256) for x in v], g) for i, v, g in fine]
    w = dims // parts
    first = {}
    for i, v, _ in whole:
        first[i] = min(first.get(i, v), v)
    books = [[first[i][p * w : p * w + w] for i in sorted(first)[:entries]] for p in range(parts)]

    def near(v, p):
        far = [(sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], c, strict=True)), k) for k, c in enumerate(books[p])]
        return min(far)

    for _ in range(rounds):
        new = [[*b] for b in books]
        for p in range(parts):
            got = {}
            for _, v, _ in whole:
                got.setdefault(near(v, p)[1], []).append(v[p * w : p * w + w])
            for k, vs in got.items():
                new[p][k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
        books = new
    done = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), g) for i, v, g in whole]
    by = Counter()
    for _, _, e, g in done:
        by[g] += e
    fit = lambda e: e if e < 1 << 63 else None
    have = {g: sum(x[2] for x in done if x[3] == g and fit(x[2]) is not None) for g in by}
    name = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, c, fit(e), fit(have[g]) if any(fit(x[2]) is not None for x in done if x[3] == g) else None, name) for i, c, e, g in done), key=str)


@pytest.mark.parametrize("huge", [False, True])
def test_vector_codes(spark, huge, monkeypatch):
    data = [r for r in vectors() if huge or r[0] not in (400, 401)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "error": F.lit("x"), "of": F.lit(0), "dims": F.lit(7)}).repartition(5)
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 11)
    codes, books = vector_codes.compressed(df, parts=8, entries=6, rounds=2)
    got = vector_codes.with_label_errors(codes)
    assert rows(got, "vec_id", "code", "error", "label_error", "codebooks_sha256") == coded(data, 8, 6, 2)
    if not huge:
        back = {r.vec_id: r.embedding for r in vector_codes.decoded(codes.dropDuplicates(["vec_id"]), books).collect()}
        error = {r.vec_id: r.error for r in codes.dropDuplicates(["vec_id"]).collect()}
        for i, v, _ in data:
            if i in back and i != 5:
                assert sum((math.floor(256 * a) - round(256 * b)) ** 2 for a, b in zip(v, back[i], strict=True)) == error[i]


def test_vector_lengths_have_codebooks_of_their_own(spark):
    data = [(k, [float(k * j % 5) for j in range(8 if k % 3 else 4)], "a") for k in range(50)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string")
    codes, books = vector_codes.compressed(df, parts=4, entries=3, rounds=1)
    assert sorted(books) == [4, 8]
    for dims in books:
        want = [(i, c, e) for i, c, e, _, _ in coded(data, 4, 3, 1, dims)]
        assert rows(codes.where(f"dims = {dims}"), "vec_id", "code", "error") == want


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.compressed(df)
    assert vector_codes.with_label_errors(codes).count() == 0 and books == {}
    with pytest.raises(ValueError):
        vector_codes.compressed(df, entries=300)


# --- source audit

NAMES = ["Alpha", "beta", "ÇEDILLA", "straße", "日本", "don't", "a1b2", "GAMMA_delta", "İx"]
DOCS = []
for k in range(160):
    source = "hot" if k % 3 == 0 else f"s{k % 5}"
    DOCS.append((k, " ".join(R.choice(NAMES[: 5 + k % 4]) for _ in range(R.randint(0, 25))), "en" if k % 4 else "de", source))
DOCS += [(900, None, None, None), (901, "", "en", "empty"), (902, "123 !!", "fr", "one"), (903, "alpha " * 40_000, "en", "s1"), (None, "beta beta", "en", "s2"), (905, "x", "fr", None), (906, "Z" * 70_000, "de", "s1")]
DOCS += [DOCS[5]] * 3


def audited(docs, least, top):
    text = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    counts, seen = {}, {}
    for _, t, g, s in docs:
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text(t)))
        counts.setdefault((g or "", s or ""), Counter()).update(own)
        seen.setdefault(g or "", Counter()).update(own.keys())
    out = []
    for g in seen:
        kept = [t for t, n in seen[g].items() if n >= least]
        every = {s: c for (h, s), c in counts.items() if h == g}
        p = lambda c: {t: 1 + (1_000_000_000 * (c[t] + 5)) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q = p(sum(every.values(), Counter()))
        own = {s: p(c) for s, c in every.items()}
        for s in every:
            pairs = sorted(((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in every if o != s))
            out += [(g, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            found = sorted((q[t] - own[s][t], t.encode(), t) for t in kept if every[s][t] > 0 and own[s][t] > q[t])
            out += [(g, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(found[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2, "span": 1, "groups": 1}, {"chunk": 1, "span": 3, "groups": 2}])
def test_audit(spark, sizes):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "chunk": F.lit(0), "item": F.lit("y")}).repartition(6)
    for least, top in ((5, 2), (1, 50)):
        got = divergence.audit(df, least_docs=least, top=top, **sizes)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert rows(got, *got.columns) == audited(DOCS, least, top)


def test_audit_without_terms_or_rows(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    got = rows(divergence.audit(df, least_docs=10_000), "lang", "source", "part", "item", "value", "rank")
    assert got == audited(DOCS, 10_000, 50) and {r[4] for r in got} == {0}
    assert divergence.audit(df.where("doc_id = -9")).count() == 0


def test_shares_are_exact_at_size():
    counts, totals = np.array([0, 7, 10**14, 9 * 10**14]), np.array([10**15 + 7] * 4)
    assert divergence.shares(counts, totals).tolist() == [1 + (10**9 * (int(c) + 5)) // int(t) for c, t in zip(counts, totals, strict=True)]


def test_terms_of_slices():
    texts = pa.array(["Ab cD", "", "éÉ!x", "tail", "Tail end"])[1:4]
    words, doc = divergence.terms(texts)
    assert (words.to_pylist(), doc.tolist()) == (["éÉ", "x", "tail"], [1, 1, 2])


def test_columns_of_the_sql_share(spark):
    df = spark.createDataFrame([(c, t) for c in (0, 3, 10**13) for t in (11, 10**14 + 3) if c + 5 <= t], "c long, t long").select("*", divergence.share(F.col("c"), F.col("t")).alias("p"))
    assert all(r.p == 1 + (10**9 * (r.c + 5)) // r.t for r in df.collect())


def test_zlib_is_one_member_a_record():
    raw = warc.page_record(1, "u", b"x", None)
    inflate = zlib.decompressobj(31)
    inflate.decompress(raw)
    assert inflate.eof and not inflate.unused_data
