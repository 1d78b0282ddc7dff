"""Mixing sources to target weights by capped water-filling.

A source's share of the mix follows its weight, but no source is repeated more
than ``max_epochs`` times: what exceeds that is clamped, and the excess goes to
the other sources by weight, round after round until none exceeds its cap.  Each
round is one aggregation over the small source table; two numbers reach the
driver.

A source's documents are then repeated ``floor(target / size)`` times whole, and
the fraction is drawn by seeded systematic sampling: in order of size (ties by
a seeded hash), every document moves a counter by the fraction and is taken once
more when the counter passes a whole number.  Neighbours in that order are of
like size, so a source misses its target by no more than its largest document,
and reruns agree.  The order's running numbers come from counts per (source,
size, beginning of the hash), so neither a hot source nor a size that a third of
all rows share is ever one group; the hash is of key and text, and equal rows are
counted as one row, so neither null nor repeated keys are one group.

Edge cases: size is the number of runs of characters other than ASCII white
space; null texts have size 0; sources go by code point, null last; a source or
a table without words has target 0 and takes nothing; rows equal in all columns
are numbered one after the other, rows that differ in any stay apart (128 bits of
hash name a row); other columns stay (of any type but maps).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import columns, scratch

WEIGHTS = (3, 1, 2)


def size_of(text: str = "text") -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table of (source_size, weight): clamp, reshare, until feasible."""
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > max_epochs * F.col("source_size")
        row = sources.agg(
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(over, max_epochs * F.col("source_size"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over & (F.col("source_size") > 0), F.col("weight"))), F.lit(0)),
        ).first()
        if row[0] == clamped or not row[2]:
            break
        clamped, level = row[0], (total - row[1]) / row[2]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), max_epochs * F.col("source_size")))


#: Equal rows, or copies of one, that are made from one row at once.
LOT = 100_000


def _each(df: DataFrame, name: str, count: str, most: int, by: str) -> DataFrame:
    """A row for each number ``name`` from 0 to ``count`` - 1; where one row makes more than a lot, lots are dealt out by ``by`` first."""
    lots = df.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / LOT))))
    if most > LOT:
        lots = lots.repartition(by, "_lot")
    numbers = F.sequence(F.col("_lot") * LOT, F.least(F.col(count), (F.col("_lot") + 1) * LOT) - 1)
    return lots.withColumn(name, F.explode(numbers)).drop("_lot")


def mixed(docs: DataFrame, **options) -> DataFrame:
    return _mixed(docs, **options)[0]


def _mixed(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 5) -> tuple[DataFrame, int]:
    """Per distinct row: doc_id, source, row (its identity), n (equal rows), size, source_size, target, whole, part, j.

    Of the ``n`` equal rows number i takes ``whole`` copies and one more if the
    counter passes a whole number between j + i and j + i + 1 times ``part``.
    Also the most equal rows, or copies of them, that one row stands for.
    """
    packed = columns.pack(docs, ["doc_id", "source", "text"])
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    row = columns.identity("doc_id", "source", "text", columns.OTHERS)
    named = packed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNotNull().alias("known"), row.alias("row"), size_of().alias("size"), draw.alias("draw"))
    # Equal rows are one from here on, however many they are.
    rows = scratch.store(named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    place = (F.row_number().over(Window.orderBy(F.col("known").desc(), "source")) - 1) % len(weights)
    sources = rows.groupBy("known", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    # One row per source: numbering them is a sort of the source names alone.
    sources = scratch.store(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))), "mix-sources")
    words, count = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    targets = fill(sources, share * words, max_epochs)

    # Lots of one source and size: about 100,000 rows each where all rows share both.
    digits = max(2, math.ceil(math.log(max(count, 1) / 100_000, 16)))
    rows = rows.withColumn("lot", F.substring("draw", 1, digits))
    lots = rows.groupBy("known", "source", "size", "lot").agg(F.sum("n").alias("m"))
    sizes = lots.groupBy("known", "source", "size").agg(F.sum("m").alias("m"))
    by_size = Window.partitionBy("known", "source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_lot = Window.partitionBy("known", "source", "size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(by_size), F.lit(0))).drop("m")
    lots = lots.withColumn("within", F.coalesce(F.sum("m").over(by_lot), F.lit(0))).drop("m")
    starts = lots.join(sizes, ["known", "source", "size"]).select("known", "source", "size", "lot", (F.col("before") + F.col("within")).alias("first"))
    in_lot = Window.partitionBy("known", "source", "size", "lot").orderBy("draw", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("number", F.coalesce(F.sum("n").over(in_lot), F.lit(0))).join(starts, ["known", "source", "size", "lot"])
    # The source table is as small as the list of source names; let its size decide on a broadcast.
    joined = placed.join(targets.select("known", "source", "source_size", "target"), ["known", "source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    most = rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    placed = joined.select("doc_id", F.when(F.col("known"), F.col("source")).alias("source"), "row", "n", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"), (F.col("number") + F.col("first")).alias("j"))
    return placed, most * math.ceil(max_epochs)


def _passed(upto: Column, start: Column) -> Column:
    """Whole numbers that the counter passes between two positions."""
    return F.floor(upto * F.col("part") + 0.5) - F.floor(start * F.col("part") + 0.5)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken words."""
    rows, most = _mixed(docs, **options)
    each = _each(rows, "i", "n", most, "row")
    copies = F.col("whole") + _passed(F.col("j") + F.col("i") + 1, F.col("j") + F.col("i"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns."""
    used = ["doc_id", "source", "text"]
    copies = F.col("n") * F.col("whole") + _passed(F.col("j") + F.col("n"), F.col("j"))
    mix, most = _mixed(docs, **options)
    taken = mix.select(F.col("row").alias("_row"), copies.cast("long").alias("_copies")).where("_copies > 0")
    # Rows equal in all columns are one row here, with the copies of all of them.
    rows = columns.pack(docs, used).withColumn("_row", columns.identity("doc_id", "source", "text", columns.OTHERS)).dropDuplicates(["_row"]).join(taken, "_row")
    return columns.unpack(_each(rows, "_copy", "_copies", most, "_row"), docs.columns, used)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('5:' || doc_id || ':' || coalesce(text, '')) AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][place % 3 + 1] AS weight FROM s
), o AS (
  SELECT *, 2.0 * source_size / weight AS bar,
         coalesce(sum(2.0 * source_size) OVER a, 0) AS filled, coalesce(sum(weight) OVER a, 0) AS used
  FROM w WHERE source_size > 0
  WINDOW a AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT 1.5 * sum(source_size) AS total, sum(weight) AS weights FROM o
), c AS (
  SELECT o.*, o.bar < (t.total - o.filled) / (t.weights - o.used) AS clamped FROM o, t
), v AS (
  SELECT (any_value(t.total) - coalesce(sum(2.0 * source_size) FILTER (clamped), 0))::DOUBLE / sum(weight) FILTER (NOT clamped) AS level FROM c, t
), g AS (
  SELECT w.source, w.source_size, least(w.weight * coalesce(v.level, 0.0), 2.0 * w.source_size)::DOUBLE AS target FROM w, v
), j AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.draw, d.doc_id) - 1 AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + floor((n + 1) * (rate - floor(rate)) + 0.5) - floor(n * (rate - floor(rate)) + 0.5)))::BIGINT AS taken
FROM j
"""
