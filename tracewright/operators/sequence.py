"""Ordered operators: islands, greedy folds, recurrences, range counts, interval and nearest joins.

Islands compare a row with the previous member, so ``lag`` and a running sum do.
Greedy rules compare with the last row *accepted*.  A row that comes ``gap`` or
more after the row before it is accepted whatever was accepted earlier, so it
begins a run of its own: a fold sees one burst of rows, not a recording, and
walks it in pieces, so that a burst of any length takes time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Callable[[Callable[[str], Column]], Column], out: str = "island") -> DataFrame:
    """Number runs of rows; ``breaks(previous)`` says where a new run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce(breaks(lambda c: F.lag(c).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    flagged = df.withColumn("_new", F.when(new, 1).otherwise(0))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: Rows of a piece of a fold: accepted rows are copied within a piece only.
PIECE = 256


def cut(rows: Column) -> Column:
    """An array in pieces."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PIECE).cast("int")), lambda k: F.slice(rows, k * PIECE + 1, F.lit(PIECE)))


def greedy(pieces: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Accepted rows of sorted pieces; ``step(accepted, row)`` gives them after ``row``, and looks at the last one only.

    The first row is always accepted.  One walk finds the row that each piece
    begins with, that is the last one accepted before it; with it every piece
    gives its own rows, so no walk carries what it has accepted along.
    """
    first = F.get(pieces, F.lit(0))
    rest = F.concat(F.array(F.slice(first, F.lit(2), F.lit(PIECE))), F.slice(pieces, F.lit(2), F.size(pieces)))
    last = lambda begun: F.element_at(begun, -1)
    begun = F.aggregate(rest, F.array(F.slice(first, 1, 1)), lambda b, piece: F.concat(b, F.array(F.slice(F.aggregate(piece, last(b), step), -1, 1))))

    def of_piece(b: Column) -> Column:
        final = F.transform(rest, lambda piece, k: F.aggregate(piece, F.get(b, k), step, lambda x: F.slice(x, F.lit(1), F.size(x) - 1)))
        return F.concat(F.flatten(final), last(b))

    return F.get(F.transform(F.array(begun), of_piece), F.lit(0))


def bursts(df: DataFrame, keys: list[str], order: list[str], column: str, gap: int, candidate: Column | None = None, out: str = "_run") -> DataFrame:
    """Number the runs of candidate rows that follow each other within less than ``gap`` (other rows stay with the run before them)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    candidate = F.lit(True) if candidate is None else candidate
    before = F.last(F.when(candidate, F.col(column)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(candidate & (before.isNull() | (F.col(column) - before >= gap)), 1).otherwise(0))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fold(df: DataFrame, keys: list[str], order: list[str], keep: list[str], step: Callable[[Column, Column], Column], column: str, gap: int) -> DataFrame:
    """One row per accepted row; ``step`` must accept every row that is ``gap`` or more after the last accepted one."""
    fields = list(dict.fromkeys([*order, *keep]))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) - 1
    runs = bursts(df, keys, order, column, gap).withColumn("_piece", F.floor(place / PIECE))
    pieces = runs.groupBy(*keys, "_run", "_piece").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))
    grouped = pieces.groupBy(*keys, "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_rows"))), lambda p: p["_rows"]).alias("_pieces"))
    return grouped.select(*keys, F.explode(greedy(F.col("_pieces"), step)).alias("_row")).select(*keys, *[F.col("_row")[f].alias(f) for f in fields])


def spaced(column: str, least: int) -> Callable[[Column, Column], Column]:
    """Accept a row at least ``least`` after the last accepted one."""
    return lambda acc, row: F.when(row[column] - F.element_at(acc, -1)[column] >= least, F.concat(acc, F.array(row))).otherwise(acc)


def better_within(column: str, gap: int, score: str) -> Callable[[Column, Column], Column]:
    """Within ``gap`` of the last accepted row the higher score replaces it."""

    def step(acc: Column, row: Column) -> Column:
        last = F.element_at(acc, -1)
        swapped = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(row))
        return F.when(row[column] - last[column] >= gap, F.concat(acc, F.array(row))).when(row[score] > last[score], swapped).otherwise(acc)

    return step


#: Children of a block of ranks: 2 ** BITS.
BITS = 3


def rank_blocks(first: Column, behind: Column, levels: Column) -> Column:
    """Blocks of ranks that cover [first, behind) exactly: structs of level and block, at most 14 a level.

    Block b of level l holds the ranks b * 8**l up to (b + 1) * 8**l.  On every
    level the blocks left and right of whole parents are taken.
    """

    def span(low: Column, high: Column) -> Column:
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    def of_level(level: Column) -> Column:
        size = F.pow(F.lit(2.0**BITS), level)
        low, high = F.ceil(first / size).cast("long"), F.floor(behind / size).cast("long")
        up, down = F.ceil(low / 2**BITS).cast("long") * 2**BITS, F.floor(high / 2**BITS).cast("long") * 2**BITS
        blocks = F.when((up >= down) | (level >= levels), span(low, high)).otherwise(F.concat(span(low, up), span(down, high)))
        return F.transform(blocks, lambda b: F.struct(level.alias("level"), b.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), levels), of_level))


def damped(values: Column) -> Column:
    """out0 = v0, out_i = round(v_i * (0.8 + 0.2 * out_(i-1)), 3), as an array."""
    first = F.array(F.round(F.element_at(values, 1), 3))
    return F.when(
        F.size(values) > 0,
        F.aggregate(F.slice(values, F.lit(2), F.size(values)), first, lambda acc, v: F.concat(acc, F.array(F.round(v * (0.8 + 0.2 * F.element_at(acc, -1)), 3)))),
    ).otherwise(F.array().cast("array<double>"))


def upper_median(values: Column) -> Column:
    """The upper of the middle values of an array, null if it is empty."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def in_bins(df: DataFrame, low: Column, high: Column, width: int, out: str = "_bin") -> DataFrame:
    """One row per time bin that [low, high] touches: two at most, if it is no wider than ``width``.

    Joins of an interval with instants are equal on the bin, so one long
    recording is many small groups.
    """
    return df.withColumn(out, F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def nearest(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, order: str, take: str, out: str) -> DataFrame:
    """Add the value of ``right`` that is nearest in time, the earliest on ties; null where the key has none.

    Both sides are sorted by time once, and each left row looks at the last
    right row before it and the first after it: no pairs are made.
    """
    ids = left.columns
    r = right.groupBy(key, F.col(right_t).alias("_t")).agg(F.min_by(F.struct(F.col(order).alias("o"), F.col(take).alias("v")), order).alias("_r"))
    rows = r.select(key, "_t", "_r").unionByName(left.select(key, F.col(left_t).alias("_t"), F.struct(*ids).alias("_l")), allowMissingColumns=True)
    seen = F.when(F.col("_r").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_r.o").alias("o"), F.col("_r.v").alias("v")))
    asks = F.col("_l").isNotNull()
    upto = lambda *o: Window.partitionBy(key).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_a", F.last(seen, True).over(upto(F.col("_t"), asks))).withColumn("_b", F.last(seen, True).over(upto(F.col("_t").desc(), asks)))
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("_t")).alias("d"), F.col(c)["o"].alias("o"), F.col(c)["v"].alias("v")))
    return both.where(asks).select("_l.*", F.least(far("_a"), far("_b"))["v"].alias(out))
