"""Benchmark passages inside documents: a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (an item of fewer is
one window), a window into shingles of three words.  Shingles are ordered by
rarity, that is by how often the documents hold them.  To contain a window
exactly a text needs every shingle of it, so the necessary prefix is one
shingle, the rarest, and only that one is joined.  Neighbouring windows of an item that share
their rarest shingle travel as one segment.

A document that holds a segment's shingle is compared with it word by word to
both sides.  The length bound (the equal run must fill a window) and the
positional bound (no further than the segment and the text reach) settle the
pair; the comparison is on the words, so no hash decides.

Documents are read twice: to count the items' shingles, then to join and verify.
Their texts are never shuffled while the segments fit a broadcast of a checked
size; beyond it candidates are joined by shuffles, with the same rows.

Edge cases: null and empty texts have no words; an item without words has no
window; rows without item_id mark words but are no item of ``n_items``; rows that
share an item_id are one item; equal documents are a row each; an empty table on
either side marks nothing; long texts are whole; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import columns, scratch

WINDOW = 10
SHINGLE = 3
#: Segments, or shingles of items, and characters up to which they are broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower case.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def _named(df: DataFrame, key: str, column: str) -> DataFrame:
    """The key, 128 bits that name the row, its words."""
    name = columns.identity(key, column)
    return df.select(F.col(key).alias("key"), name["a"].alias("a"), name["b"].alias("b"), words(F.col(column)).alias("words"))


def _starts(named: DataFrame, sizes: list[int], ends: bool = False) -> DataFrame:
    """A row for each place and size where a shingle starts; with ``ends``, one more behind the last word, of hash 0."""
    places = F.concat("words", F.array(F.lit(None).cast("string"))) if ends else F.col("words")
    beside = F.arrays_zip(places.alias("w0"), *[F.slice("words", j + 1, F.size("words")).alias(f"w{j}") for j in range(1, max(sizes))])
    rows = named.select("*", F.posexplode(beside).alias("pos", "at"))
    w = [F.col(f"at.w{j}") for j in range(max(sizes))]
    hashes = [F.when(w[k - 1].isNotNull(), F.xxhash64(F.lit(k), *w[:k])) for k in sizes]
    if ends:
        hashes[0] = F.when(w[0].isNull(), F.lit(0).cast("long")).otherwise(hashes[0])
    hashed = rows.withColumn("h", hashes[0] if len(sizes) == 1 else F.explode(F.array(*hashes)))
    return hashed.withColumn("behind", w[0].isNull()).drop("at").where(F.col("h").isNotNull())


def _small(df: DataFrame, rows: int, chars: Column | None = None) -> bool:
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if chars is None else chars).alias("c")).first()
    return got["n"] <= rows and (got["c"] or 0) <= BROADCAST_CHARS


def segments(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, list[int]]:
    """Parts of items around the rarest shingle of their windows, and the shingle sizes in use.

    Both take ``key, a, b, words``.  Columns: ``h`` (the shingle), ``item``,
    ``part`` (the words of all windows that share it), ``off`` (its place in
    ``part``), ``need`` (words of a window).  Windows with a shingle that no
    document holds are left out.
    """
    sized = items.where(F.size("words") > 0).withColumn("need", F.least(F.size("words"), F.lit(window)))
    sizes = sorted({r[0] for r in sized.select(F.least("need", F.lit(shingle))).distinct().collect()}) or [shingle]
    shingles = _starts(sized, sizes)
    if len(sizes) > 1:  # an item's own size only
        own = reduce(lambda rest, k: F.when(F.least("need", F.lit(shingle)) == k, F.xxhash64(F.lit(k), *[F.get("words", F.col("pos") + j) for j in range(k)])).otherwise(rest), sizes, F.lit(None).cast("long"))
        shingles = shingles.where(F.col("h") == own)
    shingles = scratch.store(shingles.select("key", "a", "b", "words", "need", "pos", "h"), "item-shingles")
    wanted = shingles.select("h").distinct()
    side = F.broadcast(wanted) if _small(wanted, broadcast_rows) else wanted
    counts = _starts(docs.select("words"), sizes).join(side, "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("seen"))
    last = F.size("words") - F.col("need")
    first_window = F.greatest(F.lit(0), F.col("pos") + F.least("need", F.lit(shingle)) - F.col("need"))
    in_windows = shingles.join(counts, "h", "left").withColumn("start", F.explode(F.sequence(first_window, F.least(F.col("pos"), last))))
    rarest = in_windows.groupBy("a", "b", "start").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "pos", "h")).alias("rare")).where(F.col("rare.seen") > 0)
    runs = rarest.groupBy("a", "b", F.col("rare.pos").alias("pos")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    held = shingles.join(runs, ["a", "b", "pos"])
    part = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("need"))
    return held.select("h", F.col("key").alias("item"), part.alias("part"), (F.col("pos") - F.col("first")).alias("off"), "need").distinct(), sizes


def _equal_words(step: int, most: int) -> Column:
    """Length of the run of words that a text and a segment share from the shingle on (step 1), or before it (step -1)."""
    out = F.lit(most)
    for j in reversed(range(most)):
        by = j if step > 0 else -1 - j
        out = F.when(F.get("words", F.col("pos") + by) == F.get("part", F.col("off") + by), out).otherwise(F.lit(j))
    return out


def _verified(candidates: DataFrame, window: int) -> DataFrame:
    """First and last word of the run that fills a window at least; null otherwise."""
    reach = candidates.withColumn("left", _equal_words(-1, window - 1)).withColumn("right", _equal_words(1, window))
    fills = ~F.col("behind") & F.col("part").isNotNull() & (F.col("left") + F.col("right") >= F.col("need"))
    return reach.withColumn("first", F.when(fills, F.col("pos") - F.col("left"))).withColumn("last", F.col("pos") + F.col("right") - 1)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id", item: str = "item_id", column: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Runs of words that documents share with items.

    Columns: ``key, a, b`` (the document), ``item, first, last`` (words from 0);
    and a row for each document with ``n_words`` and nulls in these three.
    """
    texts = _named(docs, key, column)
    found, sizes = segments(texts, _named(items, item, column), window, shingle, broadcast_rows)
    found = scratch.store(found, "item-segments")
    kept = ["key", "a", "b", "n_words", "item", "first", "last"]
    n_words = F.when(F.col("behind"), F.col("pos")).cast("long").alias("n_words")
    if _small(found, broadcast_rows, F.length(F.array_join("part", " "))):
        table = F.broadcast(found.unionByName(found.sparkSession.range(1).select(F.lit(0).cast("long").alias("h")), allowMissingColumns=True))
        rows = _verified(_starts(texts, sizes, ends=True).join(table, "h"), window)
        return rows.where((F.col("behind") & F.col("part").isNull()) | F.col("first").isNotNull()).select("key", "a", "b", n_words, *[F.col(c).cast("long") if c != "item" else c for c in kept[4:]])
    hits = _starts(texts, sizes).join(found, "h").drop("key", "words").distinct().join(texts.dropDuplicates(["a", "b"]), ["a", "b"])
    rows = _verified(hits, window).where(F.col("first").isNotNull()).select("key", "a", "b", F.lit(None).cast("long").alias("n_words"), "item", F.col("first").cast("long"), F.col("last").cast("long"))
    return rows.unionByName(texts.select("key", "a", "b", F.size("words").cast("long").alias("n_words")), allowMissingColumns=True)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", item: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: its words, those that windows of items cover, and the items."""
    rows = scratch.store(matches(docs, items, window, key=key, item=item, broadcast_rows=broadcast_rows), "item-matches")
    hits = rows.where(F.col("first").isNotNull())
    places = hits.select("a", "b", F.explode(F.sequence("first", "last")).alias("place")).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.where(F.col("item").isNotNull()).select("a", "b", F.col("item").cast("string").alias("item")).distinct()
    lists = named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("ids"))
    found = rows.where(F.col("first").isNull()).join(places, ["a", "b"], "left").join(lists, ["a", "b"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return found.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), items AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), sized AS (SELECT item_id, words, least(len(words), 10) AS n FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, n, list_slice(words, s, s + n - 1) AS part
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM sized)
), places AS (
  SELECT row_no, p, n, list_slice(words, p, p + n - 1) AS part
  FROM (SELECT row_no, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)
), found AS (SELECT row_no, p, places.n, item_id FROM places JOIN windows USING (part)
), covered AS (SELECT row_no, count(DISTINCT w) AS n_hit FROM (SELECT row_no, unnest(range(p, p + n)) AS w FROM found) GROUP BY row_no
), listed AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row_no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_no) LEFT JOIN listed USING (row_no)
"""
