"""Connected components of a link table by alternating star contraction.

Every round hangs the larger neighbours of each node below its smallest one
(large star), then all smaller neighbours (small star), until nothing changes;
the number of rounds grows with the logarithm of the node count.  Each round is
two aggregations and joins on node ids, written to the shared folder, so no
lineage piles up and nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import scratch


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def roots(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node with a smaller member in its component.

    ``links`` has long columns ``a`` and ``b``; loops and repeats are harmless.
    Raises if ``most_rounds`` do not suffice: an unfinished state is no result.
    """
    stars = scratch.store(links.select("a", "b").where("a <> b").distinct(), "links")
    state = _state(stars)
    for _ in range(most_rounds):
        if not state[0]:
            break
        turned = scratch.store(_small(_large(stars)), "links")
        scratch.discard(stars)
        stars, before, state = turned, state, _state(turned)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
