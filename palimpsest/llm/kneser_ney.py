"""Quality classifier (operator 6): an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Each character of the trusted text is a sign of its own, and those it lacks are one more. An n-gram is its context, a code of all but its last sign, and that sign, so any alphabet fits.
Counting, discounts, context totals and continuation counts are group-bys and joins of n-grams, dealt by n-gram or context. Up to SIGNS signs tasks get a dense table of
probabilities, beyond that the n-grams seen; a model of more than HELD n-grams is sent to nobody, the n-grams of texts are joined to it. All three give the same. Documents whose perplexity lies above
a limit taken from quantiles of their language are rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIGNS, ORDER = 64, 4
MIDDLE, HIGH, FACTOR = 0.5, 0.75, 3.0  # chosen on the labelled rows of sf0.1, figures in the README; a language's limit: MIDDLE quantile + FACTOR times the way from there to the HIGH quantile
HELD, PACKED = 2 << 20, 2**63  # n-grams of the highest order that go to tasks, about twice as many with those of the others, twelve bytes each; codes of n-grams that fit a long
TOGETHER = 400_000  # characters of texts scored at a time, one text at least
LANGUAGES = 10_000  # limits that go to tasks; with more languages they are joined


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all documents labelled good (quality 1) and not toxic."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def alphabet(texts: DataFrame) -> np.ndarray:
    """Sign of each code point: 1 and up for all of the texts, by count and then code point; else 0."""
    schema = pa.schema([("c", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c, n = np.unique(code_points(t), return_counts=True)
                total[c] += n
        c = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"c": c.astype(np.int32), "n": total[c]}, schema=schema)

    seen = texts.mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(0x110000, np.int32)
    for k, (c, _) in enumerate(sorted(seen, key=lambda r: (-r[1], r[0]))):
        out[c] = k + 1
    return out


def _signs(texts: list[str], table: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the texts laid end to end, before each of them line ends; where an n-gram of a text begins, and where each text ends."""
    pad = np.full(order - 1, ord("\n"), "<u4")
    points = [code_points(t) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    flat = table[np.concatenate([x for p in points for x in (pad, p)])] if points else np.zeros(0, table.dtype)
    ends = np.cumsum(sizes + order - 1)
    inside = np.ones(len(flat), bool)
    for k in range(order - 1):
        inside[ends - sizes - order + 1 + k] = False
    return flat, inside[order - 1 :], np.cumsum(sizes)


def _coded(flat: np.ndarray, order: int, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(flat) - order + 1), np.int32 if size**order < 2**31 else np.int64)
    for k in range(order):
        out *= size
        out += flat[k : k + len(out)]
    return out


def codes(texts: list[str], table: np.ndarray, order: int = ORDER, size: int = SIGNS) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each character of the texts laid end to end, and where each text ends. Before a text stand line ends."""
    flat, inside, ends = _signs(texts, table, order)
    out = _coded(flat, order, size)
    return out[inside] if len(flat) else out, ends


def _summed(context: np.ndarray, sign: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams with the sums of their counts."""
    order = np.lexsort((sign, context))
    context, sign, n = context[order], sign[order], n[order]
    starts = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (sign[1:] != sign[:-1])][: len(n)])
    return context[starts], sign[starts], np.add.reduceat(n, starts) if len(n) else n


def counted(texts: list[str], table: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, signs, counts) of the different n-grams of the texts."""
    if size**ORDER < PACKED:
        g, n = np.unique(codes(texts, table, size=size)[0], return_counts=True)
        return g.astype(np.int64) // size, g.astype(np.int64) % size, n
    flat, inside, _ = _signs(texts, table, ORDER)
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    return _summed(_coded(flat[:-1], ORDER - 1, size).astype(np.int64)[inside], flat[ORDER - 1 :].astype(np.int64)[inside], np.ones(int(inside.sum()), np.int64))


def gram_counts(texts: DataFrame, table: np.ndarray, size: int) -> DataFrame:
    """(context long, sign int, n long): all n-grams of the highest order; each task sends one row for each of its own, and again for what it can't hold together."""
    held = texts.sparkSession.sparkContext.broadcast(table.tobytes())
    schema = pa.schema([("context", pa.int64()), ("sign", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = np.frombuffer(held.value, np.int32), []

        def merged() -> pa.RecordBatch:
            c, s, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(s.astype(np.int32)), pa.array(n)], schema=schema)

        for batch in common.slices(batches, 500):
            parts.append(counted(batch.column(0).to_pylist(), own, size))
            if sum(len(p[2]) for p in parts) > 1 << 21:
                got = merged()
                if got.num_rows > 1 << 20:
                    yield got
                    parts.clear()
                else:
                    parts[:] = [tuple(c.to_numpy().astype(np.int64) for c in got.columns)]
        if parts:
            yield merged()

    return texts.mapInArrow(count, "context long, sign int, n long").groupBy("context", "sign").agg(F.sum("n").alias("n"))


def model_tables(counts: DataFrame, size: int = SIGNS) -> tuple[DataFrame, DataFrame]:
    """Of n-gram counts: (o, context, sign, x), an order's n-grams with their shares, and (o, context, x), its contexts with their weights, as in
    p(c | context) = share + weight * p of the shorter context.

    Modified Kneser-Ney: discounts D1, D2, D3+ of each order from its counts of counts; below the highest order an n-gram counts
    as often as it has different characters before it. counts: (context, sign, n), or codes in their place (g, n).
    """
    now, shares, weights = counts, [], []
    if "g" in counts.columns:
        now = counts.select(F.floor(F.col("g") / size).cast("long").alias("context"), (F.col("g") % size).cast("int").alias("sign"), "n")
    for order in range(ORDER, 0, -1):
        t = {r[0]: r[1] for r in now.where("n <= 4").groupBy("n").agg(F.count("*")).collect()}
        y = t.get(1, 0) / max(1, t.get(1, 0) + 2 * t.get(2, 0))
        d = [max(0.0, min(k, k - (k + 1) * y * t.get(k + 1, 0) / t[k])) if t.get(k) else k * 0.5 for k in (1, 2, 3)]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = now.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("off"))
        shares.append(now.join(context, "context").select(F.lit(order).alias("o"), "context", "sign", ((F.col("n") - discount) / F.col("total")).alias("x")))
        weights.append(context.select(F.lit(order).alias("o"), "context", (F.col("off") / F.col("total")).alias("x")))
        if order > 1:
            now = now.groupBy((F.col("context") % size ** (order - 2)).alias("context"), "sign").agg(F.count("*").alias("n"))
    return reduce(DataFrame.union, shares), reduce(DataFrame.union, weights)


def packed_model(tables: tuple[DataFrame, DataFrame], size: int = SIGNS) -> list[tuple[np.ndarray, ...]]:
    """For each order from 1: codes of n-grams, shares, contexts, weights. The driver gets them as arrays, eight bytes for an n-gram, or twelve with codes that need it."""
    schema, kind = pa.schema([("o", pa.int32()), ("g", pa.binary()), ("x", pa.binary())]), "<i4" if size**ORDER < 2**31 else "<i8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, g, x = (c.to_numpy() for c in b.columns)
            used = np.unique(o)
            parts = [[v[o == k].astype(t).tobytes() for k in used] for v, t in ((g, kind), (x, "<f4"))]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(v, pa.binary()) for v in parts)], schema=schema)

    out: list[tuple[np.ndarray, ...]] = [()] * ORDER
    for table in tables:
        g = F.col("context") * size + F.col("sign") if "sign" in table.columns else F.col("context")
        rows = table.select("o", g.alias("g"), "x").mapInArrow(pack, "o int, g binary, x binary").collect()
        for k in range(ORDER):
            g, x = (np.frombuffer(b"".join(bytes(r[c]) for r in rows if r[0] == k + 1), t) for c, t in ((1, kind), (2, "<f4")))
            order = np.argsort(g)
            out[k] += (g[order], x[order])
    return out


def log_probabilities(model: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log p of the last character of each n-gram of the highest order given the others: SIGNS ** ORDER numbers of four bytes."""
    p = np.full(1, 1 / SIGNS, np.float32)
    for order, (g, share, context, weight) in enumerate(model, 1):
        w = np.ones(SIGNS ** (order - 1), np.float32)  # a context never seen leaves all to the shorter one
        w[context] = weight
        # an n-gram's context is all but its last sign, its shorter n-gram all but its first
        p = (w * p[0])[:, None].repeat(SIGNS, 1).ravel() if order == 1 else np.multiply(w.reshape(SIGNS, -1, 1), p.reshape(1, -1, SIGNS)).ravel()
        p[g] += share
    return np.log(np.maximum(p, 1e-12, out=p), out=p)


class _Found:
    """Values by code, for look-ups of many codes at once: codes lie by the leading bits of their hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(1, (2 * len(keys)).bit_length()))
        keys = keys.astype(np.int64)
        h = self.hashed(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.start = np.searchsorted(h[order], np.arange((1 << 64 - int(self.shift)) + 1)).astype(np.int32)

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes are there, and the values of those."""
        h = self.hashed(keys)
        at, last = self.start[h], self.start[h + 1]
        there, live = np.zeros(len(keys), bool), np.flatnonzero(at < last)
        while len(live):
            hit = self.keys[at[live]] == keys[live]
            there[live[hit]] = True
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < last[live]]
        return there, self.values[at[there]]


class _Seen:
    """log p of the last character of n-grams of the highest order given the others, from the n-grams seen alone; what log_probabilities() gives of all."""

    def __init__(self, model: list[tuple[np.ndarray, ...]], size: int):
        self.size, self.orders, shorter, p = size, [], np.zeros(1, np.int64), np.full(1, 1 / size)
        for order, (g, share, context, weight) in enumerate(model, 1):
            g = g.astype(np.int64)
            if len(g):
                rest = p[np.searchsorted(shorter, g % size ** (order - 1))]  # a seen n-gram's shorter one is seen, and its context too
                p = share + weight[np.searchsorted(context, g // size)] * rest
            self.orders.append((_Found(g, np.log(np.maximum(p[: len(g)], 1e-12))), _Found(context, np.log(np.maximum(weight, 1e-12)))))
            shorter = g

    def __getitem__(self, g: np.ndarray) -> np.ndarray:
        g, out, left = g.astype(np.int64), np.zeros(len(g)), np.arange(len(g))
        for order in range(ORDER, 0, -1):
            own, context = self.orders[order - 1]
            code = g[left] % self.size**order
            there, x = own(code)
            out[left[there]] += x
            left, code = left[~there], code[~there]
            if not len(left):
                return out
            there, x = context(code // self.size)  # a context never seen leaves all to the shorter one
            out[left[there]] += x
        out[left] -= np.log(self.size)
        return out


_expanded: dict[str, np.ndarray | _Seen] = {}


class Scorer:
    """Mean -log p of a character, exponentiated. The table is made once for each Python worker."""

    def __init__(self, held):
        self.held = held

    def __call__(self, texts: list[str]) -> list[float | None]:
        table, size, model = self.held.value
        if self.held.id not in _expanded:
            _expanded.clear()
            _expanded[self.held.id] = log_probabilities(model) if size <= SIGNS else _Seen(model, size)
        logs, own, out = _expanded[self.held.id], np.frombuffer(table, np.int32), []
        a = 0
        while a < len(texts):
            b, length = a, 0
            while b < len(texts) and (b == a or length + len(texts[b]) <= TOGETHER):
                length, b = length + len(texts[b]), b + 1
            g, ends = codes(texts[a:b], own, size=size)
            total = np.r_[0.0, np.cumsum(logs[g], dtype=np.float64)]
            starts = np.r_[0, ends[:-1]]
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = (total[ends] - total[starts]) / (ends - starts)
            out += [round(float(np.exp(-x)), 6) if x == x else None for x in mean]
            a = b
        return out

    def scored(self, docs: DataFrame) -> DataFrame:
        names = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                scores = self([t or "" for t in batch.column(names.index("text")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "perplexity"])

        return docs.mapInArrow(run, docs.select("*").schema.add("perplexity", "double"))


class Joined:
    """A Scorer whose model is dealt to all tasks: the different n-grams of all texts meet it, then each text's own meet these."""

    def __init__(self, table: np.ndarray, size: int, tables: tuple[DataFrame, DataFrame]):
        self.table, self.size, self.tables = table, size, tables

    def scored(self, docs: DataFrame) -> DataFrame:
        held, size = docs.sparkSession.sparkContext.broadcast(self.table.tobytes()), self.size
        schema = pa.schema([("key", pa.binary()), ("context", pa.int64()), ("sign", pa.int32()), ("n", pa.int64())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.frombuffer(held.value, np.int32)
            for batch in common.slices(batches, 100):
                for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    c, s, n = counted([t], own, size)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(n), pa.binary()), pa.array(c), pa.array(s, pa.int32()), pa.array(n)], schema=schema)

        key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
        texts = docs.where("text <> ''").select(key.alias("key"), "text").dropDuplicates(["key"])
        grams = common.written(texts.mapInArrow(count, "key binary, context long, sign int, n long"), common.shared_folder(docs.sparkSession))
        known, p = grams.select("context", "sign").distinct(), F.lit(1 / size)
        for order in range(1, ORDER + 1):
            shares, weights = (t.where(F.col("o") == order) for t in self.tables)
            known = known.withColumn("_c", F.col("context") % size ** (order - 1))
            known = known.join(shares.select(F.col("context").alias("_c"), "sign", F.col("x").alias(f"_s{order}")), ["_c", "sign"], "left")
            known = known.join(weights.select(F.col("context").alias("_c"), F.col("x").alias(f"_w{order}")), "_c", "left").drop("_c")
            p = F.coalesce(f"_s{order}", F.lit(0.0)) + F.coalesce(f"_w{order}", F.lit(1.0)) * p
        logs = known.select("context", "sign", F.ln(F.greatest(p, F.lit(1e-12))).alias("x"))
        mean = grams.join(logs, ["context", "sign"]).groupBy("key").agg(F.round(F.exp(-F.sum(F.col("n") * F.col("x")) / F.sum("n")), 6).alias("perplexity"))
        own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), key.alias("key"))
        return own.join(mean, "key", "left").select("own.*", "perplexity")


class _Held:
    """A broadcast with a name of its own, to be known again in a reused worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def train(docs: DataFrame, labels: DataFrame) -> Scorer | Joined:
    """docs: doc_id, text; labels: doc_id, quality, toxic. Counts all trusted text. Without any all characters are equally likely."""
    spark = docs.sparkSession
    ids = common.written(trusted_ids(labels), trusted := common.shared_folder(spark))
    texts = common.written(common.only(common.texts(docs), ids).select("text"), f"{trusted}/texts")
    table = alphabet(texts)
    size = max(SIGNS, int(table.max()) + 1)
    counts = common.written(gram_counts(texts, table, size), folder := common.shared_folder(spark))
    tables = model_tables(counts, size)
    if size**ORDER < PACKED and (size <= SIGNS or counts.count() <= HELD):
        scorer = Scorer(_Held(spark.sparkContext.broadcast((table.tobytes(), size, packed_model(tables, size)))))
    else:
        root = common.shared_folder(spark)
        scorer = Joined(table, size, tuple(common.written(t, f"{root}/{k}") for k, t in enumerate(tables)))
    common.drop_folder(spark, folder)
    common.drop_folder(spark, trusted)
    return scorer


def perplexities(docs: DataFrame, scorer: Scorer | Joined) -> DataFrame:
    """docs with a column perplexity; null for empty texts."""
    return scorer.scored(docs)


def limits(scored: DataFrame) -> DataFrame:
    """(lang, upper) over all documents of a language; a null language is one of its own.

    Quantiles are exact over perplexities rounded to a ten-thousandth of their logarithm, so they don't depend on the order of rows and a
    language's table of them has a bound."""
    rounded = F.exp(F.round(F.ln("perplexity"), 4))
    got = scored.groupBy("lang", rounded.alias("p")).agg(F.count("*").alias("n"))
    got = got.groupBy("lang").agg(F.percentile("p", F.array(F.lit(MIDDLE), F.lit(HIGH)), F.col("n")).alias("q"))
    return got.select("lang", (F.col("q")[0] + FACTOR * (F.col("q")[1] - F.col("q")[0]) + 0.05 * F.col("q")[0]).alias("upper"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang and any more) with perplexity, upper (its language's limit) and keep; columns of these names are replaced.

    Empty texts have no perplexity and are kept: there is nothing to reject them for. Texts are read three times; the trusted ones are written
    down while the model is made, after a shuffle only where more than common.SENT_IDS are trusted; the driver gets a row for each language, at most LANGUAGES of them, else limits are joined.
    """
    spark, docs = docs.sparkSession, docs.drop("perplexity", "upper", "keep")
    scorer = train(docs, labels)
    scored = perplexities(docs.select("text", "lang"), scorer).select("lang", "perplexity")
    upper = common.written(limits(scored), folder := common.shared_folder(spark))
    out = perplexities(docs, scorer)
    if upper.count() <= LANGUAGES:
        known = {r[0]: r[1] for r in upper.collect() if r[1] is not None}
        common.drop_folder(spark, folder)
        of = F.create_map(*(F.lit(x) for k, v in known.items() if k is not None for x in (k, v))) if any(k is not None for k in known) else F.create_map().cast("map<string,double>")
        limit = F.when(F.col("lang").isNull(), F.lit(known.get(None))).otherwise(F.try_element_at(of, F.col("lang"))).cast("double")
        out = out.withColumn("upper", limit)
    else:
        of = upper.select(F.col("lang").alias("of"), F.struct("upper").alias("limit"))
        own = F.struct(*(F.col(f"`{c}`") for c in out.columns)).alias("own")
        out = out.select(own).join(of, F.col("own.lang").eqNullSafe(F.col("of")), "left").select("own.*", "limit.upper")
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("upper"), F.lit(True)))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, upper, keep, for each document."""
    docs = common.documents(spark, sf_dir).where("doc_id is not null").select("doc_id", "text", "lang")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "lang", "perplexity", "upper", "keep")
