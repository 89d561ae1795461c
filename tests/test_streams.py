"""Every stream operator over two batches and a restart: what it gives together is what the batch form gives of all rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import limits, state

R = random.Random(5)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.partitions", "2")
    yield spark
    spark.conf.unset(PROVIDER)


def played(spark, tmp_path, rows, schema, made, batches):
    """All that `made` gives of a stream of rows, read file by file; the query ends after each of `batches` and starts again from its checkpoint."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(source)
        stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(out)
        until = time.time() + 60  # a query whose state the clock can change goes on with empty batches, so none says that it has read all
        while sum(p["numInputRows"] for p in q.recentProgress) < len(rows[k * size : (k + 1) * size]) and time.time() < until:
            time.sleep(0.2)
        q.stop()
    return spark.read.parquet(out)


def hits(n=60, keys=3):
    rows = sorted((R.randint(0, 400) / 2, k % keys) for k in range(n))
    return [(key, k, t) for k, (t, key) in enumerate(rows)]


def told(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_limited_stream(spark, tmp_path):
    rows, rules = hits(), [(2, 10.0), (5, 60.0)]
    got = played(spark, tmp_path, rows, "key long, id long, t double", lambda s: limits.limited_stream(s, rules), 3)
    want = limits.limited(spark.createDataFrame(rows, "key long, id long, t double"), rules)
    assert told(got, "key", "id", "t", "accepted") == told(want, "key", "id", "t", "accepted")
    for key in range(3):
        own = [r for r in rows if r[0] == key]
        assert [r[3] for r in told(want, "key", "t", "id", "accepted") if r[0] == key].count(True) == sum(limits.accept([t for _, _, t in own], rules)[0])


def test_deduplicated(spark, tmp_path):
    rows = [("a", 0), ("a", 30), ("b", 40), ("b", 45), ("c", 2001), ("c", 2002), ("a", 2003), ("a", 2004), ("d", 2005)]  # the second file lets go of what the first held
    schema = "k string, s long"
    made = lambda s: limits.deduplicated(s.withColumn("at", F.timestamp_seconds("s")), "at", ["k"], "10 minutes")
    got = played(spark, tmp_path, rows, schema, made, 3)
    assert told(got, "k").count(("a",)) == 2 and told(got, "k").count(("b",)) == 1 and told(got, "k").count(("c",)) == 1


def test_cache_loads_stream(rocks, tmp_path):
    rows = hits()
    got = played(rocks, tmp_path, rows + [(None, 900, 1.0), (1, 901, None)], "key long, id long, t double", lambda s: state.cache_loads_stream(s, 20.0), 2)
    want = []
    for key in range(3):
        last = None
        for _, i, t in (r for r in rows if r[0] == key):
            load = last is None or t - last > 20.0
            last = t if load else last
            want.append((key, i, t, load))
    assert told(got, "key", "id", "t", "load") == sorted(want, key=str)
    df = rocks.createDataFrame(rows + [(None, 900, 1.0), (1, 901, None)], "key long, id long, t double").repartition(3)
    assert told(state.cache_loads(df, 20.0), "key", "id", "t", "load") == sorted(want, key=str)
    assert state.cache_loads(df.where("key = 9"), 20.0).count() == 0


def test_captures_stream(rocks, tmp_path):
    """With a baseline that is known before the stream begins; a null is a value like others."""
    rows = [(k % 3, k, float(k), R.choice(["x", "y", None])) for k in range(40)]
    baseline = rocks.createDataFrame([(0, "x"), (1, None), (7, "z")], "key long, value string")
    got = played(rocks, tmp_path, rows, "key long, id long, t double, value string", lambda s: state.captures_stream(s, baseline), 2)
    known, want = {0: ("x",), 1: (None,)}, []
    for key, i, _, v in rows:
        before = known.get(key)
        want.append((i, before and before[0], "first" if before is None else "unchanged" if before[0] == v else "changed"))
        known[key] = (v,)
    assert told(got, "id", "before", "state") == sorted(want, key=str)
    batch = state.captures_compared(rocks.createDataFrame([(2, 1, 1.0, "a"), (2, 2, 2.0, "a"), (2, 3, 3.0, None), (None, 4, 1.0, "q")], "key long, id long, t double, value string"))
    assert told(batch, "id", "before", "state") == [(1, None, "first"), (2, "a", "unchanged"), (3, "a", "changed")]


def test_state_is_cleared_in_time(rocks, tmp_path):
    """Nothing was heard of a key for longer than its state is kept: its next request loads anew, whatever the times in the rows say."""
    rows = [(1, 1, 0.0), (1, 2, 1.0)]
    got = played(rocks, tmp_path, rows, "key long, id long, t double", lambda s: state.cache_loads_stream(s, 1e9, keep_ms=1), 2)
    assert told(got, "id", "load") == [(1, True), (2, True)]


def test_a_key_of_many_batches_is_one(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(1, k, float(k)) for k in range(100)], "key long, id long, t double").repartition(4)
        assert [r.id for r in state.cache_loads(df, 9.0).where("load").orderBy("id").collect()] == [*range(0, 100, 10)]
        assert limits.limited(df, [(1, 10.0)]).where("accepted").count() == 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
