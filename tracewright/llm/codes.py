"""Vector code compression: one byte for each part of a vector, found by partial-distance search.

Components become integers, so every distance, sum and mean is exact and no order
of tasks shows in the result.  A part's dimensions are processed in descending
variance of its codebook; a vectorised mask drops the entries of a codebook
whose accumulated distance strictly exceeds the best complete distance known for
the row, so ties survive and go to the lower index.

Vectors stay in their partitions.  A round sends one row of sums for each part,
entry and task; only codebooks (parts x entries integers, whatever the table
holds) and these totals pass the driver.

Edge cases: rows whose vector is null, empty, or holds null or non-finite
components are dropped, as are vectors of another length than most; components
beyond +-2**20 count as that bound; a length that ``parts`` does not divide is
filled with zeros; with fewer kept rows than entries, codebooks are as short; rows
without vec_id come last in order and are coded like others; rows that share a
vec_id are rows each (the smaller vector first); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
STEPS = 256
BOUND = float(2**20)
#: Rows whose distances are held at once.
ROWS = 8_192
#: Labels (24 bytes each) whose sums are broadcast.
BROADCAST_ROWS = 200_000
SALTS = 32


# --- kernels ----------------------------------------------------------------


def nearest(x: np.ndarray, book: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry and the squared distance; ties to the lower index.

    ``guess`` (an entry for each row) gives the first complete distance; without
    it, that of the entry nearest in the first dimension does.
    """
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    rows = np.arange(len(x))
    partial = (x[:, :1] - book[None, :, 0]) ** 2
    if guess is None:
        guess = partial.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(partial <= best[:, None])
    far = partial[row, entry]
    for d in range(1, x.shape[1]):
        far = far + (x[row, d] - book[entry, d]) ** 2
        alive = far <= best[row]
        row, entry, far = row[alive], entry[alive], far[alive]
    # Survivors are in order of row and entry: of each row's, the first of the least distance.
    starts = np.searchsorted(row, rows)
    least = np.minimum.reduceat(far, starts)
    hit = np.flatnonzero(far == least[row])
    first = hit[np.searchsorted(row[hit], rows)]
    return entry[first], least


def assign(x: np.ndarray, books: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows x parts) and squared distances of vectors cut into parts (rows x parts x width)."""
    codes = np.empty(x.shape[:2], np.int64)
    errors = np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        codes[:, p], errors[:, p] = nearest(x[:, p], books[p], None if guess is None else guess[:, p])
    return codes, errors


# --- tables -----------------------------------------------------------------


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label and ``x``, the vector as ``floor(256 x)``, of the rows that take part."""
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    x = F.transform("v", lambda c: F.floor(STEPS * F.greatest(F.least(c, F.lit(BOUND)), F.lit(-BOUND))).cast("int"))
    return rows.where(F.size("v") == (usual["n"] if usual else 0)).select("key", "label", x.alias("x"))


def _cut(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """Column ``x`` as rows x parts x width."""
    held = batch.column(batch.schema.get_field_index("x"))
    x = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(held), -1)
    return _parts(x, parts)


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def totals(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n, s0, s1, ...: number and componentwise sum of the parts nearest to each entry, a few rows a task."""
    parts, entries, width = books.shape
    sums = [f"s{d}" for d in range(width)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, np.int64)
        s = np.zeros((parts * entries, width), np.int64)
        for batch in _slices(batches):
            x = _cut(batch, parts)
            at = (assign(x, books)[0] + np.arange(parts) * entries).ravel()
            n += np.bincount(at, minlength=len(n))
            np.add.at(s, at, x.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(n[used]), *[pa.array(np.ascontiguousarray(s[used, d])) for d in range(width)]], names=["part", "entry", "n", *sums])

    schema = ", ".join(["part int", "entry int", "n long", *[f"{c} long" for c in sums]])
    return rows.select("x").mapInArrow(kernel, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *sums]])


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x width: the parts of the first vectors, then means of what is nearest; unused entries stay."""
    first = rows.orderBy(F.asc_nulls_last("key"), "x").select("x").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = _parts(np.array([r["x"] for r in first], np.int64), parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for part, entry, n, *sums in totals(rows, books).collect():  # parts x entries rows at most
            books[part, entry] = np.array(sums) // n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """key, label, code (two hex digits a part) and error (squared distances summed)."""
    schema = T.StructType([rows.schema["key"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, errors = assign(_cut(batch, len(books)), books)
            held = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "label")]
            yield pa.RecordBatch.from_arrays([*held, pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(errors.sum(axis=1))], names=schema.names)

    return rows.mapInArrow(kernel, schema)


def report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Code and error of every row, and the error of its label."""
    if entries > 256:
        raise ValueError("an index takes one byte")
    rows = scratch.store(integers(df, key, vector, label), "vector-integers")
    books = codebooks(rows, parts, entries, rounds)
    done = scratch.store(coded(rows, books), "vector-codes")
    by_label = scratch.store(done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    if by_label.count() <= broadcast_rows:
        met = done.join(F.broadcast(by_label), same)
    else:
        salted = by_label.withColumn("grain", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = done.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("grain")))
    return met.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(n: int, last: bool = False) -> str:
    """SQL of one assignment to codebook ``n``, and of the codebook that follows."""
    found = f"""
, a{n} AS (
  SELECT v.no, v.p, min(((v.x[1] - b.x[1]) * (v.x[1] - b.x[1]) + (v.x[2] - b.x[2]) * (v.x[2] - b.x[2]) + (v.x[3] - b.x[3]) * (v.x[3] - b.x[3]) + (v.x[4] - b.x[4]) * (v.x[4] - b.x[4])) * 64 + b.e) AS best
  FROM v JOIN b{n} AS b ON v.p = b.p GROUP BY v.no, v.p
)"""
    if last:
        return found
    return f"""{found}, m{n} AS (
  SELECT p, best % 64 AS e, count(*) AS c, sum(x[1])::BIGINT AS s1, sum(x[2])::BIGINT AS s2, sum(x[3])::BIGINT AS s3, sum(x[4])::BIGINT AS s4
  FROM a{n} JOIN v USING (no, p) GROUP BY p, best % 64
), b{n + 1} AS (
  SELECT p, e, CASE WHEN c IS NULL THEN b.x ELSE [(s1 - (s1 % c + c) % c) // c, (s2 - (s2 % c + c) % c) // c, (s3 - (s3 % c + c) % c) // c, (s4 - (s4 % c + c) % c) // c] END AS x
  FROM b{n} AS b LEFT JOIN m{n} USING (p, e)
)"""


#: Vectors of 64 components, hence parts of four.
ORACLE = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS no, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT no, p, list_slice(q, p * 4 + 1, p * 4 + 4) AS x FROM k, range(16) AS r(p)
), b0 AS (SELECT p, no - 1 AS e, x FROM v WHERE no <= 64
){_round(0)}{_round(1)}{_round(2, True)}, c AS (
  SELECT no, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY no
), d AS (SELECT sha256(string_agg(x[1] || ',' || x[2] || ',' || x[3] || ',' || x[4], ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN c USING (no), d
"""
