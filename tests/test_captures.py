"""Captures written and read: whole or not at all, each line that can't be used with its reason."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import captures

NODES = [{"role": "paragraph", "path": "body/1", "text": "é\n\"x\""}, {"role": "heading", "path": "body/2", "text": ""}]
GOOD = {"url": "https://a.example/", "captured_at": "2024-01-01T00:00:00Z", "title": None, "nodes": NODES}
DDL = "url string, captured_at string, title string, nodes array<struct<role string, path string, text string>>, label string"


def rows(n, label=None):
    return [(f"https://a.example/{i}", "2024-01-01", None if i % 2 else f"t{i}", None if i == 3 else [tuple(x.values()) for x in NODES[: i % 3]], label) for i in range(n)]


def load(spark, path, **options):
    return spark.read.format("captures").options(**options).load(str(path))


@pytest.fixture
def source(spark):
    captures.register(spark)
    return spark


def test_round_trip_append_and_overwrite(source, tmp_path):
    df = source.createDataFrame(rows(50), DDL).withColumn("more", F.lit(1)).repartition(5)
    path = str(tmp_path / "c")
    df.write.format("captures").mode("append").save(path)
    source.createDataFrame(rows(4, "kept"), DDL).write.format("captures").mode("append").save("file://" + path)
    good, refused = captures.split(load(source, path, sharebytes="2000"))
    got = [(r.url, r.captured_at, r.title, tuple(map(tuple, r.nodes)), r.label) for r in good.collect()]
    want = [(u, t, h, tuple(n or ()), s) for u, t, h, n, s in rows(50) + rows(4, "kept")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert refused.count() == 0 and not [x for x in os.listdir(path) if x.startswith("_")]
    source.createDataFrame(rows(2), DDL).write.format("captures").mode("overwrite").save(path)
    assert load(source, path).count() == 2
    source.createDataFrame([], DDL).write.format("captures").mode("overwrite").save(path)
    assert load(source, path).count() == 0 and load(source, tmp_path / "none").count() == 0


def test_lines_of_columns(source, tmp_path):
    c = F.col
    df = source.createDataFrame(rows(9) + rows(2, "kept"), DDL)
    df.select(captures.line(c("url"), c("captured_at"), c("title"), c("nodes"), c("label")).alias("line")).write.format("captures").mode("append").save(str(tmp_path / "a"))
    df.write.format("captures").mode("append").save(str(tmp_path / "b"))
    a, b = (sorted(load(source, tmp_path / x).drop("file", "line").collect(), key=repr) for x in "ab")
    assert a == b and len(a) == 11 and not any(r.reason for r in a)


def test_a_failed_write_leaves_nothing(source, tmp_path):
    path = str(tmp_path / "c")
    source.createDataFrame(rows(3), DDL).write.format("captures").mode("append").save(path)
    for mode in ("append", "overwrite"):
        broken = source.range(200).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(captures.to_line(GOOD)).alias("line"))
        with pytest.raises(Exception, match="lost"):
            broken.write.format("captures").mode(mode).save(path)
        assert load(source, path).count() == 3 and not [x for x in os.listdir(path) if x.startswith("_")]
    with pytest.raises(Exception, match="one line"):
        source.createDataFrame([("a\nb",)], "line string").write.format("captures").mode("append").save(path)
    with pytest.raises(Exception, match="needs captured_at, title, nodes"):
        source.createDataFrame([("a",)], "url string").write.format("captures").mode("append").save(path)
    assert load(source, path).count() == 3


def test_files_that_no_commit_named_are_not_read(source, tmp_path):
    os.makedirs(tmp_path / "_pending-x")
    for name in ("_pending-x/part-1.jsonl", ".part-2.jsonl", "_part-3.jsonl", "part-4.jsonl"):
        (tmp_path / name).write_text(captures.to_line(GOOD) + "\n")
    assert [r.file for r in load(source, tmp_path).collect()] == ["part-4.jsonl"]


def test_reasons(source, tmp_path):
    made = lambda **x: json.dumps(json.loads(captures.to_line(GOOD)) | x)
    wrapped = lambda **x: json.dumps(json.loads(captures.to_line(GOOD, "mine")) | x)
    less = json.loads(captures.to_line(GOOD))
    del less["title"]
    many = captures.to_line(GOOD | {"nodes": NODES[:1] * (captures.NODES + 1)})
    lines = [
        (captures.to_line(GOOD), None), (captures.to_line(GOOD, "mine"), None), (captures.to_line(GOOD)[:-9], "not_json"), ("", "not_json"), ("[" * 100_000, "not_json"), ("[1]", "not_a_capture"), ("null", "not_a_capture"),
        ('{"nodes": []}', "not_a_capture"), (wrapped(capture=None), "not_a_capture"), (made(version=0), "old_version"), (made(version=True), "old_version"), (made(version="1"), "old_version"), (wrapped(baseline=2), "old_version"),
        (wrapped(label=None), "malformed"), (wrapped(more=1), "malformed"), (json.dumps(less), "malformed"), (made(url=5), "malformed"), (made(more=1), "malformed"), (made(nodes=None), "malformed"), (made(nodes=[{}]), "malformed"),
        (made(nodes=[NODES[0] | {"text": None}]), "malformed"), (made(title="\ud800"), "malformed"), (made(nodes=NODES[:1]), "altered"), (made(sha256=""), "altered"), (many, "too_many_nodes"), ("x" * 2_000_000, "too_large"),
        (made(title="y" * 999_000), None), ("\x00", "not_json"), ("last, without its end", "not_json"),
    ]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(x.encode() for x, _ in lines))
    (tmp_path / "b.jsonl").write_bytes(b"\xff\xfe\n")
    (tmp_path / "c.jsonl").write_bytes(b"")
    found = load(source, tmp_path, linebytes="1000000").persist()
    assert {(r.file, r.line): r.reason for r in found.collect()} == {("a.jsonl", k): why for k, (_, why) in enumerate(lines)} | {("b.jsonl", 0): "not_json"}
    good, refused = captures.split(found)
    assert sorted(r.label or "" for r in good.collect()) == ["", "", "mine"] and {r.raw[:5] for r in refused.where("reason = 'too_large'").collect()} == {"xxxxx"}
    assert refused.columns == ["file", "line", "reason", "raw"] and max(len(r.raw) for r in refused.collect()) == 200
