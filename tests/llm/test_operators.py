"""The training-data operators and the pipeline on small tables with every awkward row, against brute force."""

import hashlib
import io
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bit_planes, bpe_stream, common, embedding_dedup, kneser_ney, line_dedup, media_ts, packing, pii, repeat_filter, simhash, substring_dedup, tokens

R = random.Random(4)
WORDS = ["".join(R.choice("etaoinshrdlu") for _ in range(R.randint(2, 7))) for _ in range(80)]
PASSAGE = " ".join(R.choice(WORDS) for _ in range(60))


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)) + "."


ROWS = [(k, prose(R.randint(5, 60)) + ("\n Common LINE\t\n" if k % 2 else "\n") + prose(8), "en" if k % 3 else "de") for k in range(40)]
ROWS += [(100, None, None), (101, "", "en"), (102, "   \n\n", None), (103, "ünïcode ﬁ 日本   x", "fr"), (104, prose(4000), "en"), (105, ROWS[3][1], "en"), (106, ROWS[3][1], "de"), (107, PASSAGE + " " + prose(9), "en"), (108, prose(9) + " " + PASSAGE, "en"), (109, "a" * 500, "en"), (110, "Thn " * 120, "en"), (None, "no id", "en")]
ROWS += [(111, "x <|endoftext|> y", "en")]
TEXTS = sorted((i, t or "") for i, t, _ in ROWS if i is not None)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"key": F.lit(1), "digest": F.lit("x"), "fp": F.lit(2), "rank": F.lit(0), "bytes": F.lit(0)}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -5")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("few, sent, n", [(0, 0, 10), (500_000, 64 << 20, 10), (500_000, 0, 1)])
def test_lines(docs, none, first, few, sent, n, monkeypatch):
    monkeypatch.setattr(repeat_filter, "SENT", sent)
    monkeypatch.setattr(repeat_filter, "RANGE_KEYS", 50)
    key = lambda x: line_dedup.line_key(x.encode())
    seen = {}
    for i, t in TEXTS:
        for k in {key(x) for x in t.split("\n")} - {b""}:
            seen.setdefault(k, set()).add(i)
    want, done = [], set()
    for i, t in TEXTS:
        kept = []
        for x in t.split("\n"):
            k = key(x)
            if len(seen.get(k, ())) < n or first and k not in done:
                kept.append(x)
            done.add(k)
        want.append((i, len(t.split("\n")), "\n".join(kept)))
    assert rows(line_dedup.dedup_lines(docs, min_docs=n, keep_first=first, broadcast_rows=few), "doc_id", "n_lines", "kept_text") == want
    assert line_dedup.dedup_lines(none, broadcast_rows=few).count() == 0
    clash = line_dedup.dedup_rows(docs.withColumns({"n_lines": F.lit("x"), "drop0": F.lit("y")}), min_docs=n, broadcast_rows=few)
    assert clash.columns.count("n_lines") == 1 and {r.drop0 for r in clash.collect()} == {"y"}


def test_suspected_repeats_are_listed(spark, monkeypatch):
    """What goes to the tasks that read lines grows with the repeated ones, not with all: here 500 of 40,500, and hardly more are listed."""
    monkeypatch.setattr(repeat_filter, "RANGE_KEYS", 1 << 12)
    texts = [(i, "\n".join([f"own {i} {k}" for k in range(80)] + [f"shared {i // 2}"] * (1 + i % 2))) for i in range(1000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    hashed = lambda b: np.array([xxhash.xxh3_64_intdigest(x) for t in b.column(1).to_pylist() for x in {*t.split("\n")}], np.uint64)
    twice = repeat_filter.twice_seen(df, hashed, 81_000, listed=True)
    held = np.frombuffer(twice.held.value, np.uint32)
    test, shared = twice.tester(), np.array([xxhash.xxh3_64_intdigest(f"shared {i}") for i in range(500)], np.uint64)
    assert test(shared).all() and set((shared >> np.uint64(32)).tolist()) <= set(held.tolist()) and len(held) < 500 + 81_000 * 0.01
    assert len(held) * 4 < twice.ranges * twice.bits // 8 / 10 and (held[1:] > held[:-1]).all()
    assert not test(np.zeros(0, np.uint64)).size
    monkeypatch.setattr(repeat_filter, "SENT", 8)
    assert repeat_filter.twice_seen(df, hashed, 81_000, listed=True).held is None


def test_media(docs, none):
    got = {r.doc_id: r for r in media_ts.from_media(media_ts.to_media(docs)).collect()}
    for i, t in TEXTS:
        b = t.encode()
        p = b.ljust(max(1, -(-len(b) // 576)) * 576, b"\xff")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert "continuity_errors=0" in got[i].feature and got[i].random_access[0] == 0
    assert media_ts.from_media(media_ts.to_media(none)).count() == 0
    spark = docs.sparkSession
    bad = {r.doc_id: r for r in media_ts.from_media(spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"x" * 188)), (3, 0, bytearray(media_ts.mux(b"a" * 900)[: 188 * 3])), (4, 0, bytearray(media_ts.TABLES)), (5, 5, bytearray(media_ts.mux(b"b" * 900)))], "doc_id long, n_bytes long, media binary")).collect()}
    assert [bad[k].error for k in range(1, 6)] == ["not whole transport packets", "lost sync", "damaged elementary packet", None, None] and bad[2].media_bytes == 188 and bad[4].payload_bytes == 0 and bad[5].payload_bytes == 900
    payload = random.Random(2).randbytes(20000)
    media = bytearray(media_ts.mux(payload))
    twice = bytes(media[: 188 * 6] + media[188 * 5 :])
    assert media_ts.demux(twice)["payload"] == payload and media_ts.demux(twice)["continuity_errors"] == 0
    network = media_ts._table_packet(0, media_ts._section(0, 1, b"\0\0\xe0\x10\0\x01" + (0xE000 | media_ts.PMT_PID).to_bytes(2, "big")))
    assert media_ts.demux(network + bytes(media[188:]))["payload"] == payload
    media[188 * 5 + 3] ^= 1
    assert media_ts.demux(bytes(media))["continuity_errors"] == 2


def test_packing(docs, none):
    t = tokens.library(tokens.vocabulary("byte_bpe_50k.json"))
    ids = {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in TEXTS}
    got = packing.pack_documents(docs).toPandas()
    for i, own in ids.items():
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(own) and (mine.start == mine.length.cumsum() - mine.length).all()
        assert [zlib.crc32(array("I", own[a : a + n]).tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    assert packing.pack_documents(none).count() == 0
    assert packing.shortest_pack_first({700: 1, 500: 1, 300: 1}, 1024) == [((700,), 1), ((500, 300), 1)]
    patterns = packing.shortest_pack_first({1000: 3, 24: 2, 10: 5, 1024: 1}, 1024)
    assert sorted(x for p, n in patterns for x in p * n) == [10] * 5 + [24] * 2 + [1000] * 3 + [1024] and all(sum(p) <= 1024 for p, _ in patterns)


def test_pii(docs, none):
    text = "x a@b.co, +44 20 7946 0958 bob (at) ex dot org 4111 1111 1111 1111, 10.0.0.1, 10.0.0.999"
    spans = pii.all_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in spans] == [("email", "a@b.co"), ("email", "bob (at) ex dot org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+44 20 7946 0958")]
    assert len(pii.base_spans(text)) == 4 and pii.all_spans("look at www.ex.org on the dot") == []
    assert "EMAIL" in pii.masked("jоhn@exаmple.com") and pii.masked("") == ""
    assert pii.all_spans("٤١١١ one one 1") == [] and pii.base_spans("1" * 100000) == []
    assert pii.find_pii(docs).count() == len(TEXTS) and pii.find_pii(none).count() == 0


def test_pii_spelled_with_figures():
    for text in ("one nine two dot one six eight dot zero dot one", "one nine two.one six eight.zero.one", "192 dot one six eight.0.one"):
        assert pii.all_spans("at " + text + " now") == [(1, 3, 3 + len(text))], text
    card = "4111 one one 1 one 1111 one 11 one"
    assert pii.all_spans("in May " + card) == [(2, 7, 7 + len(card))]
    assert len(pii.all_spans("+1 (848) 555-1373 Un an")) == 1
    assert pii.all_spans("one dot two") == [] and not pii.disguised("one of 2 in 2024")


def plain_spans(text):
    """The contract's patterns, as they stand."""
    luhn = lambda d: sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return [(k, *m.span()) for k, (pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0])]


def test_pii_base_spans():
    r = random.Random(8)
    signs = ["a", "B", "@", ".", "-", "+", " ", "(", ")", "%", "1", "4", "2", "55", "10.0.0.1", "4111 1111 1111 1111", "x@y.z", "..", "é", "\n"]
    found = 0
    for _ in range(20_000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text
        assert set(pii.base_spans(text)) <= set(pii.all_spans(text)), text
        assert pii.disguised(text) or not (pii.normalised(text).changed or pii.stopped(text).changed), text
        found += len(plain_spans(text))
    assert found > 5000


def test_pii_bare_at_and_plus():
    for text, span in (("ask bob at example.com, or", (0, 4, 22)), ("plus four four two zero seven nine four six zero nine five eight", (3, 0, 64)), ("John.smіth@example.com", (0, 0, 22))):
        assert span in pii.all_spans(text), text
    assert pii.masked("John.smіth@example.com") == "[EMAIL]"
    for text in ("look at example.com", "meet me at www.example.com", "three plus four", "sold at 3.50", "at home.The"):
        assert pii.all_spans(text) == [], text


def test_pii_parts():
    """A base span that is a part of the address hides none of it."""
    text = "j\u043ehn@example.com or john@mail.example dot com"
    assert [text[a:b] for _, a, b in pii.all_spans(text)] == ["j\u043ehn@example.com", "hn@example.com", "john@mail.example", "john@mail.example dot com"]
    assert pii.masked(text) == "[EMAIL] or [EMAIL]"


def test_pii_gate():
    for text in ("bob@example[.]com", "10.0.0[.]1", "bob@example{.}com", "bob@example(.)com", "bob@example < . >com", "(one two three four)", "\u201cone two three four\u201d", "plain (text) of one"):
        assert pii.disguised(text) == pii.normalised(text).changed, text
    assert pii.masked("bob@example[.]com, 10.0.0[.]1") == "[EMAIL], [IP]"


def test_embeddings(spark):
    g = np.random.default_rng(1)
    base = g.standard_normal((60, 8))
    v = [*base, *(base[:20] + 0.12 * g.standard_normal((20, 8))), base[0], base[0] * 3, np.zeros(8)]
    data = [(k, [float(y) for y in x], 1) for k, x in enumerate(v)] + [(90, None, 1), (91, [1.0, None], 1), (92, [float("nan")] * 8, 1), (93, [], 1), (94, [1e-200] + [0.0] * 7, 1), (95, [1e200] + [0.0] * 7, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, copies int")
    ok = {k: np.array(x) / np.abs(x).max() for k, x, _ in data if k is not None and x and None not in x and np.isfinite(x).all() and np.any(x)}
    links = {k: {j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] / np.linalg.norm(ok[j]) / np.linalg.norm(ok[k]) >= 0.9} for k in ok}

    def least(k):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), set()) - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    want = sorted((k, len(links.get(k, ())), least(k), least(k) == k) for k, _, _ in data if k is not None)
    assert rows(embedding_dedup.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup.near_vectors(df.where("vec_id = -1")).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i, _ in TEXTS], "doc_id long, quality int, toxic int")
    noise = spark.createDataFrame([(200, "QZ!! XW## " * 30, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in kneser_ney.judged(docs.select(noise.columns).union(noise).where("doc_id is not null"), labels).collect()}
    assert len(got) == len(TEXTS) + 1 and not got[200].keep and all(got[k].keep for k in range(40)) and got[101].perplexity is None
    assert kneser_ney.judged(none, labels).count() == 0
    table = np.zeros(0x110000, np.uint8)
    for k, c in enumerate("abc"):
        table[ord(c)] = k + 1
    counts = spark.createDataFrame([(int(x), int(n)) for x, n in zip(*np.unique(kneser_ney.codes(["abcabcacb"], table)[0], return_counts=True), strict=True)], "g int, n long")
    p = np.exp(kneser_ney.log_probabilities(kneser_ney.packed_model(kneser_ney.model_tables(counts))))
    assert np.allclose(p.reshape(-1, kneser_ney.SIGNS).sum(1), 1, atol=1e-3)


def plain_perplexities(trusted, texts):
    """Interpolated modified Kneser-Ney from its definition, on strings; None for empty texts."""
    signs, order, end = kneser_ney.SIGNS, kneser_ney.ORDER, "\n"
    seen = Counter("".join(trusted))
    known = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))][: signs - 1]
    sign = lambda c: known.index(c) + 1 if c in known else 0
    coded = lambda t: tuple(sign(c) for c in end * (order - 1) + t)
    counts = Counter(x[k : k + order] for x in map(coded, trusted) for k in range(len(x) - order + 1))
    tables = {}
    for n in range(order, 0, -1):
        t = Counter(c for c in counts.values() if c <= 4)
        y = t[1] / max(1, t[1] + 2 * t[2])
        d = [max(0.0, min(k, k - (k + 1) * y * t[k + 1] / t[k])) if t[k] else k / 2 for k in (1, 2, 3)]
        total, off = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        tables[n] = (dict(counts), d, total, off)
        counts = Counter(g[1:] for g in counts)

    def p(g):
        if not g:
            return 1 / signs
        own, d, total, off = tables[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        c = own.get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * p(g[1:])

    def one(t):
        x = coded(t)
        return math.exp(-sum(math.log(p(x[k : k + order])) for k in range(len(t))) / len(t)) if t else None

    return [*map(one, texts)]


def test_quality_by_definition(spark, docs):
    labels = spark.createDataFrame([(i, int(i < 40 or i == 103), 0) for i, _ in TEXTS], "doc_id long, quality int, toxic int")
    got = dict(rows(kneser_ney.judged(docs.where("doc_id is not null").withColumns({"keep": F.lit("x"), "upper": F.lit("y")}), labels), "doc_id", "perplexity"))
    want = plain_perplexities([t for i, t in TEXTS if i < 40 or i == 103], [t for _, t in TEXTS])
    for (i, _), x in zip(TEXTS, want, strict=True):
        assert got[i] is x is None or abs(got[i] / x - 1) < 1e-3, i


def test_quality_limit(spark):
    scored = spark.createDataFrame([("en", x) for x in [4.8, 5.0, 5.0, 5.2, 6.3]], "lang string, perplexity double")
    assert 5.2 < kneser_ney.limits(scored).first().upper < 6.3


def test_all_trusted_text_counts(spark):
    labels = spark.range(20_050).selectExpr("id doc_id", "1 quality", "0 toxic")
    assert kneser_ney.trusted_ids(labels).count() == 20_050


def test_bit_planes(spark, docs, none, tmp_path):
    t, at, want = tokens.library(tokens.vocabulary("word_bpe_49k.json")), 0, []
    for i, x in TEXTS:
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    folder = f"file://{tmp_path}/a"
    files, base = [], 0
    for r in sorted(bit_planes.write_ids(docs, folder).collect(), key=lambda r: r.part):
        files.append((r.file, base))
        base += r.ids
    assert rows(bit_planes.read_ids(spark, folder, files), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert bit_planes.write_ids(none, folder).count() == 0 and bit_planes.read_ids(spark, folder, []).count() == 0
    for ids in (np.zeros(0, np.uint32), np.array([0, 2**32 - 1, 7], np.uint32), np.arange(70000, dtype=np.uint32)):
        assert (bit_planes.decode_planes(bit_planes.encode_planes(ids), len(ids)) == ids).all()
    with pytest.raises(ValueError):
        bit_planes.read_index(io.BytesIO(b"x" * 40), 40)


@pytest.mark.parametrize("together, sent", [(3, 64 << 20), (5000, 64 << 20), (5000, 0)])
def test_substrings(docs, none, together, sent, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    monkeypatch.setattr(repeat_filter, "SENT", sent)
    monkeypatch.setattr(repeat_filter, "RANGE_KEYS", 500)
    seen, want = set(), []
    for i, t in TEXTS:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    assert sum(w[2] for w in want) > 500
    assert [(*r[:4], bytes(r[4])) for r in rows(substring_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")] == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substrings_of_repeated_ids(spark):
    a, b = prose(80), prose(80)
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a + b)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {(1, len(a)): (0, 0), (1, len(b)): (0, 0), (2, len(a + b)): (len(a + b), 1)}


@pytest.mark.parametrize("bits", [0, 2, 3])
def test_simhash(docs, none, bits):
    fp = [simhash.fingerprint(t) for _, t in TEXTS]
    parent = list(range(len(fp)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fp)):
        for b in range(a + 1, len(fp)):
            if (fp[a] ^ fp[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = [(i, f"{f:016x}", TEXTS[root(k)][0]) for k, ((i, _), f) in enumerate(zip(TEXTS, fp, strict=True))]
    assert rows(simhash.groups(docs, bits=bits), "doc_id", "fingerprint", "component_id") == want
    assert simhash.groups(none).count() == 0


def test_similar(docs, none, spark):
    words = [R.choice(WORDS) + str(k) for k in range(150)]
    edited = [(400 + k, " ".join(words[:k * 7] + ["new"] * (k > 0) + words[k * 7 + k // 3 :])) for k in range(20)]
    edited += [(500 + k, " ".join(["X"] * k + words)) for k in range(0, 60, 3)]
    df = docs.select("doc_id", "text", "key").union(spark.createDataFrame([(i, t, 0) for i, t in edited], "doc_id long, text string, key int"))
    all_texts = TEXTS + edited
    sets = [set(simhash.shingles_of(t, 5)) for _, t in all_texts]
    label = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b in range(a):
            if len(x & sets[b]) * 5 >= len(x | sets[b]) * 4 and label[a] != label[b]:
                label = [min(label[a], label[b]) if y in (label[a], label[b]) else y for y in label]
    want = sorted((i, all_texts[label[k]][0]) for k, (i, _) in enumerate(all_texts))
    assert rows(simhash.similar_groups(df), "doc_id", "component_id") == want
    assert simhash.similar_groups(none).count() == 0


def test_sketch_pairs_are_all_tried(spark, monkeypatch):
    """A long list of texts, of which only few pairs have the similarity, and none with the list's leader."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    r = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(540):
        w = list(base)
        for at in r.sample(range(200), 9):
            w[at] = f"x{r.random()}"
        texts.append(" ".join(w))
        if k % 60 == 0:
            texts.append(" ".join(w[:-1]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [simhash.hash_set(t, 5) for t in texts]
    nodes = spark.createDataFrame([(bytearray(simhash.sketch(x)), k) for k, x in enumerate(sets)], "sketch binary, rep long")
    members = spark.createDataFrame([(1, k, k) for k in range(len(texts))], "list long, rep long, c long")
    label = list(range(len(sets)))
    for a, b in map(tuple, simhash.crossing_links(members, nodes, docs, 5, 0.8).collect()):
        assert simhash.alike(sets[a], sets[b], 0.8)
        label = [min(label[a], label[b]) if y in (label[a], label[b]) else y for y in label]
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if want[a] != want[b] and simhash.alike(sets[a], sets[b], 0.8):
                want = [min(want[a], want[b]) if y in (want[a], want[b]) else y for y in want]
    assert 9 <= len(set(range(len(sets)))) - len(set(want)) < 540 and label == want
    assert simhash.crossing_links(members.withColumn("c", F.lit(0)), nodes, docs, 5, 0.8).count() == 0


@pytest.mark.parametrize("sent", [0, 100])
def test_only(spark, docs, sent, monkeypatch):
    monkeypatch.setattr(common, "SENT_IDS", sent)
    ids = spark.createDataFrame([(3,), (100,), (7777,)], "doc_id long")
    assert {r.doc_id for r in common.only(common.texts(docs), ids).collect()} == {3, 100}
    assert common.only(common.texts(docs), ids.where("doc_id < 0")).count() == 0


def test_long_sketch_lists(monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 8)
    r = np.random.default_rng(5)
    x = r.integers(0, 256, (3, simhash.SKETCH), np.uint8)[np.arange(90) % 3]
    x = np.where(r.random(x.shape) < 0.1, 0, x).astype(np.uint8)
    label = list(range(len(x)))
    for i, j in simhash.heaviest_forest(x, 90):
        assert (x[i] == x[j]).sum() >= 90
        label = [label[i] if y == label[j] else y for y in label]
    assert len(set(label)) == 3


def test_long_posting_lists(monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 8)
    r = np.random.default_rng(3)
    for bits in (1, 2, 3):
        for fixed in simhash.position_sets(bits)[:3]:
            free = np.uint64(~simhash._mask(fixed) & (1 << 64) - 1)
            x = np.unique(r.integers(0, 1 << 63, 4, dtype=np.uint64).repeat(60) & free)
            x = np.unique(x.repeat(40) ^ (np.uint64(1) << r.integers(0, 64, len(x) * 40).astype(np.uint64) & free))
            near = np.bitwise_count(x[:, None] ^ x) <= bits
            label = list(range(len(x)))
            for i, j in simhash.forest(len(x), simhash.links(x, fixed, bits)):
                assert near[i, j]
                label = [label[i] if y == label[j] else y for y in label]
            for i, j in zip(*np.nonzero(near), strict=True):
                assert label[i] == label[j]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 50), (100, 51), (51, 52), (7, 7)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long")), "id", "component_id"))
    assert got == {k: 0 for k in range(41)} | {k: 50 for k in (50, 51, 52, 100)}


def test_bpe(docs, none):
    path = tokens.vocabulary("byte_bpe_50k.json")
    t, bpe = tokens.library(path), bpe_stream.load(path)
    want = []
    for i, x in TEXTS:
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    assert rows(bpe_stream.decode_documents(bpe_stream.encode_documents(docs)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe_stream.decode_documents(bpe_stream.encode_documents(none)).count() == 0
    for x in ("a" * 9000, " " * 70000 + "b", "the" * 3000, "x\n" * 50, " \t　 a's'S <|endoftext|>", "!" * 66000 + "\n"):
        assert list(bpe_stream.encode(bpe, x)) == t.encode(x, add_special_tokens=False).ids
    machine = bpe_stream.Transducer(bpe)
    data = "".join(R.choice("therain") for _ in range(9000)).encode()
    out, most = [], 0
    for k in range(0, len(data), 7):
        out += machine.feed(data[k : k + 7])
        most = max(most, len(machine.held))
    assert out + list(machine.end()) == bpe.ids(data) and most <= 2 * bpe.lookahead + 7


def test_pipeline_tells_texts_of_one_id_apart(spark):
    a, b = prose(90), prose(90)
    data = [(1, a, "en", "s", 5), (1, a, "de", "s", 5), (2, b, "en", "s", 5), (2, prose(90), "en", "s", 5), (3, b, "fr", None, None), (4, None, None, None, None), (5, "", "en", "s", 0), (None, a, "en", "s", 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(corpus_pipeline.near_duplicates(spark, df, "").collect(), key=str)
    assert len([r for r in got if r.doc_id == 2]) + len([r for r in got if r.doc_id == 3]) == 2 and [r.lang for r in got if r.doc_id == 1] == ["de"]
    assert sum(r.text == b for r in got) == 1 and len([r for r in got if r.doc_id in (4, 5)]) == 1
    assert corpus_pipeline.near_duplicates(spark, df.where("doc_id = -1"), "").count() == 0


def test_pipeline(spark, docs, tmp_path):
    d = docs.select(*corpus_pipeline.COLUMNS)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = common.documents(spark, str(tmp_path))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.written(stage(spark, now, str(tmp_path)), f"file://{tmp_path}/{k}")
        if k < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        if k == 2:
            kept = {r.doc_id for r in out.collect()}
            assert {105, 106} & kept == set() and 3 in kept and len({101, 102, 100} & kept) == 1
        now = out
    assert {r.doc_id for r in now.collect()} == kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_embeddings_are_shuffled_as_tiles(spark, monkeypatch):
    """Each vector's bytes meet each tile once, whatever the cells hold; sure links are counted where they are found and are no rows."""
    g = np.random.default_rng(4)
    middle = g.standard_normal((4, 16))
    v = np.concatenate([middle[k] + s * g.standard_normal((90, 16)) for k, s in enumerate((0.05, 0.1, 0.3, 0.9))])
    df = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)] + [(1000, [float(y) for y in v[0]])], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    reps = spark.createDataFrame([(k, 1 + (k == 0), [float(y) for y in x]) for k, x in enumerate(v)], "rep long, copies long, embedding array<double>")
    sent = embedding_dedup.coded(reps.coalesce(1), 8)
    assert sent.count() == 8 and sum(len(r.code) for r in sent.collect()) == v.size
    found = embedding_dedup.candidates(reps, 0.9, 4).collect()
    assert len(found) < links.sum() / 4
    for tile in (1 << 19, 30):  # of 30: more tiles than TILES
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
        label = np.arange(len(v))
        while True:
            after = np.array([label[row].min() for row in links])
            if (after == label).all():
                break
            label = after
        n = links.sum(1) - 1 + links[:, 0]
        assert got == {k: (int(n[k]), int(label[k])) for k in range(len(v))} | {1000: (int(n[0]), 0)}


def test_every_character_is_a_sign(spark, monkeypatch):
    """More characters than SIGNS: each of them counts, in texts that differ by the rarest alone too; a model that tasks can't hold is joined to, one whose codes are too long as well."""
    many = "".join(chr(0x4E00 + k) for k in range(90))
    trusted = [many, "one two three " * 3, "two one " + many[:50], many[85:] * 2 + "\n", "three"]
    others = ["", many[80:], many[80:84] + many[88:84:-1], "two one \U0001f600", None]
    docs = spark.createDataFrame([(k, t, "zh") for k, t in enumerate(trusted + others)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(trusted))], "doc_id long, quality int, toxic int")
    with monkeypatch.context() as m:
        m.setattr(kneser_ney, "SIGNS", len(set("".join(trusted))) + 1)
        want = plain_perplexities(trusted, [t or "" for t in trusted + others])
    assert abs(want[6] / want[7] - 1) > 0.1
    for name, most in ((None, None), ("HELD", 0), ("PACKED", 0)):
        with monkeypatch.context() as m:
            if name:
                m.setattr(kneser_ney, name, most)
            scorer = kneser_ney.train(docs, labels)
            assert type(scorer) is (kneser_ney.Joined if name else kneser_ney.Scorer)
            got = dict(rows(kneser_ney.perplexities(docs.select("doc_id", "text"), scorer), "doc_id", "perplexity"))
            assert all(got[k] is x is None or abs(got[k] / x - 1) < 1e-4 for k, x in enumerate(want)), name
