"""Vector code compression (operator 12): product codes in whole numbers.

Each component x becomes floor(256 * x), so all that follows is exact and the same in any order of addition. Vectors are cut into equal parts, and each part
has a codebook of its own. Vectors are stored as blocks, a row of numbers for each component. One tree aggregation finds the first
codebooks, and each round is another: a task adds up the distances of its blocks component by component, adds its parts into tensors of sums and counts, and the tensors
merge on their way to the driver, which sees a bounded number of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_ROWS = 4096
TOGETHER = 1024  # vectors whose distances are held at a time
SMALL, MOST_DIMS = 1 << 24, 1 << 12  # within these, squared distances and sums are far from 64 bits; beyond, Python's integers are used
DEPTH = 2  # levels of the reduction tree

Books = dict[int, np.ndarray]  # by dimensions: (parts, width, entries)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, label, embedding array<double>) of rows with an id, without null and non-finite components. Empty vectors and those that can't be
    cut into equal parts are left out by blocks()."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return v.where("vec_id is not null").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**1015)))


def blocks(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(dims int, ids binary, labels array, columns binary): vectors of equal length, floor(256 * x) as doubles, component after component."""
    fine = usable(vectors)
    label = to_arrow_type(fine.schema["label"].dataType)
    schema = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(label)), ("columns", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, BLOCK_ROWS):
            ids, labels, raw = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            flat, ends = raw.values.to_numpy(zero_copy_only=False), raw.offsets.to_numpy()
            sizes = np.diff(ends)
            for dims in np.unique(sizes):
                if dims == 0 or dims % parts:
                    continue
                own = np.flatnonzero(sizes == dims)
                x = np.floor(flat[ends[own][:, None] + np.arange(dims)] * SCALE)
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids[own].astype(np.int64).tobytes()]), pa.array([labels.take(pa.array(own)).to_pylist()], schema.field("labels").type), pa.array([np.ascontiguousarray(x.T).tobytes()])], schema=schema)

    return fine.mapInArrow(run, f"dims int, ids binary, labels array<{fine.schema['label'].dataType.simpleString()}>, columns binary")


def columns(raw: bytes, dims: int) -> np.ndarray:
    """(dims, vectors) whole numbers: of 64 bits where they are small, Python's otherwise."""
    x = np.frombuffer(raw).reshape(dims, -1)
    if dims <= MOST_DIMS and (not x.size or np.abs(x).max() < SMALL):
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(dims, -1)


def nearest(x: np.ndarray, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, codes, squared distances) of (dims, vectors) for (parts, width, entries); ties go to the lower index."""
    parts, width, entries = book.shape
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)
    n = x.shape[1]
    for p in range(parts):
        codes, error = np.empty(n, np.int64), np.empty(n, x.dtype)
        for a in range(0, n, TOGETHER):
            far = np.zeros((min(TOGETHER, n - a), entries), x.dtype)
            for d in range(width):
                step = x[p * width + d, a : a + TOGETHER, None] - book[p, d]
                far += step * step
            codes[a : a + TOGETHER] = far.argmin(1)
            error[a : a + TOGETHER] = far[np.arange(len(far)), codes[a : a + TOGETHER]]
        yield p, codes, error


def first_vectors(found: Books, dims: int, ids: np.ndarray, x: np.ndarray, entries: int) -> Books:
    """The vectors of the `entries` smallest ids so far, by dimensions; of rows that share an id the least vector."""
    known = found.setdefault(dims, {})
    least = np.sort(np.unique(ids))[:entries]
    for i in np.flatnonzero(np.isin(ids, least)):
        v = tuple(x[:, i].tolist())
        known[int(ids[i])] = min(known.get(int(ids[i]), v), v)
    found[dims] = dict(sorted(known.items())[:entries])
    return found


def merged_first(a: dict, b: dict, entries: int) -> dict:
    for dims, known in b.items():
        both = a.setdefault(dims, {})
        for i, v in known.items():
            both[i] = min(both.get(i, v), v)
        a[dims] = dict(sorted(both.items())[:entries])
    return a


def first_books(rows, parts: int, entries: int) -> Books:
    """Each part of the vectors of the smallest ids."""

    def add(found: dict, r) -> dict:
        ids = np.frombuffer(r.ids, np.int64)
        return first_vectors(found, r.dims, ids, columns(bytes(r.columns), r.dims), entries)

    found = rows.treeAggregate({}, add, lambda a, b: merged_first(a, b, entries), DEPTH)
    return {dims: fitting(np.array([*known.values()], object).T.reshape(parts, dims // parts, -1)) for dims, known in found.items()}


def fitting(book: np.ndarray) -> np.ndarray:
    """As numbers of 64 bits where they are small."""
    return book.astype(np.int64) if all(abs(v) < SMALL for v in book.ravel()) and book.shape[0] * book.shape[1] <= MOST_DIMS else book


def trained(rows, books: Books) -> Books:
    """One round: each part goes to its nearest entry, and each entry becomes floor(sum / count) of its parts; unused ones stay."""
    sent = rows.context.broadcast(books)

    def add(total: dict, r) -> dict:
        x, book = columns(bytes(r.columns), r.dims), sent.value[r.dims]
        parts, width, entries = book.shape
        if r.dims not in total:
            total[r.dims] = np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64)
        sums, counts = total[r.dims]
        if x.dtype == object and sums.dtype != object:
            sums = sums.astype(object)
        for p, codes, _ in nearest(x, book):
            np.add.at(counts[p], codes, 1)
            for d in range(width):
                np.add.at(sums[p, d], codes, x[p * width + d])
        total[r.dims] = sums, counts
        return total

    def merge(a: dict, b: dict) -> dict:
        for dims, (sums, counts) in b.items():
            a[dims] = (a[dims][0] + sums, a[dims][1] + counts) if dims in a else (sums, counts)
        return a

    total = rows.treeAggregate({}, add, merge, DEPTH)
    sent.unpersist()
    new = {}
    for dims, book in books.items():
        sums, counts = total[dims]
        used = np.broadcast_to(counts[:, None, :] > 0, book.shape)
        mean = sums.astype(object) // np.maximum(counts, 1).astype(object)[:, None, :]
        new[dims] = fitting(np.where(used, mean, book.astype(object)))
    return new


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas between them."""
    return hashlib.sha256(",".join(map(str, book.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def coded(held: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, dims, code, error, codebooks_sha256) of blocks. An error beyond 64 bits is null."""
    label = held.schema["labels"].dataType.elementType
    schema = pa.schema([("vec_id", pa.int64()), ("label", to_arrow_type(label)), ("dims", pa.int32()), ("code", pa.string()), ("error", pa.int64()), ("codebooks_sha256", pa.string())])
    sent = held.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {dims: digest(book) for dims, book in sent.value.items()}
        for batch in common.slices(batches, 1):
            dims, raw = batch.column(0)[0].as_py(), batch.column(3)[0].as_py()
            x, book = columns(raw, dims), sent.value[dims]
            n = x.shape[1]
            codes, error = np.empty((n, len(book)), np.uint8), 0
            for p, own, far in nearest(x, book):
                codes[:, p] = own
                error = error + far
            hexed, w = codes.tobytes().hex(), 2 * len(book)
            errors = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(1)[0].as_py(), np.int64)), batch.column(2).flatten(), pa.array([dims] * n, pa.int32()), pa.array([hexed[k : k + w] for k in range(0, n * w, w)]), pa.array(errors, pa.int64()), pa.array([names[dims]] * n)], schema=schema)

    return held.mapInArrow(run, f"vec_id long, label {label.simpleString()}, dims int, code string, error long, codebooks_sha256 string")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(vec_id, label, dims, code, error, codebooks_sha256) of each usable row, and the codebooks.

    Reads vec_id, embedding (of any numeric type), label (of any type that can be grouped). Rows without an id are left out, as are vectors that are null, empty, hold null or non-finite
    components (2 ** 1015 and more count as such) or can't be cut into so many equal parts. Vectors of each length have codebooks of their own. Rows that share an id are rows of
    their own; the first codebooks have one entry for each id. entries is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    held = common.written(blocks(vectors, parts), common.shared_folder(vectors.sparkSession))
    rows = held.select("dims", "ids", "columns").rdd
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = trained(rows, books)
    return coded(held, books), books


def decoded(codes: DataFrame, books: Books) -> DataFrame:
    """(vec_id, embedding array<double>) of (vec_id, dims, code): the entries that the codes name, divided by 256 again."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def rows(batch: pa.RecordBatch) -> dict:
        out = []
        for dims, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            book = sent.value[dims]
            own = np.frombuffer(bytes.fromhex(code), np.uint8)
            out.append([v / SCALE for v in book[np.arange(len(book)), :, own].ravel().tolist()])
        return {"vec_id": batch.column(0), "embedding": out}

    return common.map_batches(codes.select("vec_id", "dims", "code"), rows, schema, "vec_id long, embedding array<double>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """With label_error: the error summed over equal labels, nulls together; null beyond 64 bits. Labels' sums are written down before they are joined, so Spark
    sends them to all tasks only if they are few, and splits a hot label's rows otherwise."""
    codes = common.written(codes, common.shared_folder(codes.sparkSession))
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    sums = common.written(codes.groupBy("label").agg(total), common.shared_folder(codes.sparkSession)).withColumnRenamed("label", "of")
    return codes.join(sums, codes.label.eqNullSafe(sums["of"]), "left").drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    codes, _ = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round_sql(k: int) -> str:
    """Assignment to the entries c{k}, and the entries c{k+1} that it gives. Whole numbers all through; // cuts towards zero, so the remainder goes first."""
    return f"""
a{k} AS (SELECT vec_id, parts.p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + k) AS best
  FROM parts JOIN c{k} ON c{k}.p = parts.p GROUP BY vec_id, parts.p),
s{k} AS (SELECT parts.p, best % 64 AS k, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN parts USING (vec_id, p), range(1, 5) t(i) GROUP BY ALL),
m{k} AS (SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY p, k),
c{k + 1} AS (SELECT p, k, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, k)),"""


#: For vectors of 64 components, as in the table.
SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[4 * p + 1:4 * p + 4] AS x FROM kept, range(16) t(p)),
c0 AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::HUGEINT AS k, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round_sql(0)}
{_round_sql(1)}
a2 AS (SELECT vec_id, parts.p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + k) AS best
  FROM parts JOIN c2 ON c2.p = parts.p GROUP BY vec_id, parts.p),
done AS (SELECT vec_id, string_agg(printf('%02x', (best % 64)::BIGINT), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
labels AS (SELECT label, sum(error)::BIGINT AS label_error FROM done JOIN kept USING (vec_id) GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM done JOIN kept USING (vec_id) JOIN labels ON labels.label IS NOT DISTINCT FROM kept.label, books
"""
