"""Pairs of texts at or above a similarity of shingle sets, found through bands of minima.

A text has ``BANDS`` bands of ``ROWS`` minima over its shingle hashes, each
under another linear map.  Two texts of similarity s share a band, and with it a
bucket, with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8, more above.

Every pair of a bucket ends up in one component, is ruled out by a bound, or
fails the exact check.  The bound: shingles that no other text has (``own``) are
shared with nobody, so of sizes x and y at most m = min(x - own_x, y - own_y)
are shared and the similarity is at most m / (x + y - m).  Pairs of which too few
minima agree in two bits (``least_alike``) are ruled out as well, unless that is
turned off.

A bucket does not give all its pairs at once.  First the member that meets most
others (over all bands: the middle of a group of copies) is compared with all;
then, in a seeded random order, 32 members, 32 times as many, and so on, each with
those behind them that no verified link joins to them yet.  A bucket is done when
it is one component or all its members had their turn.  A large group of copies so
costs one star, and only a bucket of many dissimilar members that the bound does
not tell apart costs their pairs.  Counts and the first member come from
aggregates with partial sums, and who is next from the random number and the
count, so no bucket is sorted or held as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import components, scratch
from tracewright.llm.arrow import chunks

BANDS, ROWS = 32, 6
#: Hashes that meet all maps at once.
BLOCK = 1024
_RNG = np.random.default_rng(64)
_TIMES = (_RNG.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_PLUS = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of every map over 64-bit hashes."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), BLOCK):
        values = _TIMES * high[None, at : at + BLOCK]
        values += _PLUS
        np.minimum(least, values.min(1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One signed long per band, which names the band too."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def least_alike(similar: float, deviations: float) -> int:
    """Minima of which two bits must agree, at least: so many standard deviations below what ``similar`` leads to expect.

    Five deviations miss one pair in a million that is just as similar: 138 of 192 at 0.8.
    """
    share = similar + (1 - similar) / 4
    return math.floor(BANDS * ROWS * share - deviations * math.sqrt(BANDS * ROWS * share * (1 - share)))


def planes(least: np.ndarray) -> np.ndarray:
    """The two lowest bits of all minima as six signed longs: three of the lowest, three of the next."""
    bits = np.concatenate([least & 1, (least >> 1) & 1]).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def alike(a: str, b: str) -> Column:
    """How many minima agree in both bits, from two array columns of ``planes``."""
    words = BANDS * ROWS // 64
    differ = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]).bitwiseOR(F.col(a)[i + words].bitwiseXOR(F.col(b)[i + words]))) for i in range(words)]
    return F.lit(BANDS * ROWS) - reduce(lambda x, y: x + y, differ)


def members(banded: DataFrame) -> DataFrame:
    """(bucket, node, r, n) of buckets with ``n`` > 1 members; ``banded`` has distinct nodes, and bands."""
    # r: a random number in [0, 1) that orders the members.
    r = F.shiftrightunsigned(F.xxhash64(F.lit(17), "node"), 11) / F.lit(2.0**53)
    rows = scratch.store(banded.select("node", F.explode("bands").alias("bucket")), "band-rows")
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return scratch.store(rows.join(many, "bucket").select("bucket", "node", r.alias("r"), "n"), "band-members")


def own_counts(sets: DataFrame) -> DataFrame:
    """(node, size, own) of shingle sets (node, set): how many shingles, and how many that no other set has."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "set"):
                held = part.column(1).to_pylist()
                nodes = np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in held])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.frombuffer(b"".join(held), np.int64))], names=["node", "h"])

    rows = sets.select("node", "set").mapInArrow(flat, "node long, h long")
    once = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    own = once.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("node", (F.length("set") / 8).cast("long").alias("size")).join(own, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def links(placed: DataFrame, sets: DataFrame, first: DataFrame, check, similar: float, sketches: DataFrame | None = None, deviations: float | None = 5.0) -> DataFrame:
    """(a, b) of verified links that join all pairs of buckets that ``check`` accepts.

    ``placed`` is what ``members`` gives, ``sets`` has a shingle set (node, set)
    of every member, ``first`` are further pairs to try, ``check`` takes pairs
    (a, b), each once, and ``sketches`` has the planes (node, planes) of members,
    by which pairs are left out unless ``deviations`` is None.
    """
    sketches = None if deviations is None else sketches
    meets = placed.groupBy("node").agg(F.sum("n").alias("meets"))
    sizes = own_counts(sets).join(meets, "node")
    if sketches is not None:
        sizes = sizes.join(sketches.select("node", "planes"), "node")
    placed = scratch.store(placed.join(sizes, "node"), "band-sizes")
    sketch = ["planes"] if sketches is not None else []
    found, tried, turns, before = scratch.store(check(first), "band-links"), first, 0, 0
    open_ = placed
    while True:
        if not turns:
            best = F.max_by(F.struct("r", "node", "size", "own", *sketch), F.struct("meets", -F.col("node")))
            hubs = open_.groupBy("bucket").agg(best.alias("h")).select("bucket", "h.*")
            ahead = F.col("node") != F.col("a")
        else:
            share = lambda t: F.lit(float(t)) / F.col("n")
            hubs = open_.where((F.col("r") < share(turns)) & (F.col("r") >= share(before)))
            ahead = (F.struct("r", "node") > F.col("at")) & (F.col("root") != F.col("at_root"))
        hub = hubs.select("bucket", F.struct("r", "node").alias("at"), F.col("node").alias("a"), F.col("size").alias("s"), F.col("own").alias("o"), *[F.col(c).alias("p") for c in sketch], *([F.col("root").alias("at_root")] if turns else []))
        most = F.least(F.col("s") - F.col("o"), F.col("size") - F.col("own"))
        near = most >= similar * (F.col("s") + F.col("size") - most)
        if sketch:
            near = near & (alike("p", "planes") >= least_alike(similar, deviations))
        pairs = open_.join(hub, "bucket").where(ahead & near)
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = scratch.store(pairs, "band-pairs")
        tried = tried.unionByName(pairs)
        found = found.unionByName(scratch.store(check(pairs), "band-links"))
        roots = components.roots(found).withColumnRenamed("node", "x")
        now = open_.drop("root").join(roots, F.col("node") == F.col("x"), "left").withColumn("root", F.coalesce("root", "node")).drop("x")
        # Buckets whose members are not all joined, and have not all had their turn.
        left = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("n")).where((F.col("low") != F.col("high")) & (F.col("n") > turns))
        open_ = scratch.store(now.join(left.select("bucket"), "bucket", "left_semi"), "band-open")
        if open_.isEmpty():
            return found
        before, turns = turns, 32 * turns or 32
