"""Cross-site boilerplate lines.

Every line hash gets a HyperLogLog sketch of the sites it was seen on; sketches
merge by aggregation, so a line that fills a third of the corpus moves as a few
sketches.  Lines whose estimate is far above the threshold are boilerplate,
those far below are not, and those near it get exact distinct counts (sites of a
line are made distinct before they are counted, so no line is one group).

The occurrence with the smallest (doc_id, position) stays, others are removed,
whatever share of their document they are: of pages copied across sites the first
stays whole.

Edge cases: a line is known by 96 bits of two hashes and its length; it is compared without blanks, tabs and carriage returns at its
ends, and only if ``min_chars`` remain; null texts have no lines and stay null;
a null site is a site of its own; rows with a null doc_id come first in order;
equal rows (same doc_id and text) lose the same lines; long texts are whole;
other columns stay, except ``n_chars``, which follows the new text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import columns, scratch

#: Boilerplate lines (24 bytes each, and their place) up to which a broadcast is used.
BROADCAST_ROWS = 400_000
SALTS = 32


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """One row per line that counts: row key, position, length, hash, site."""
    key = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("n")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(" \t\r"))
    return key.select("doc_id", "row", "pos", "site", F.length(line).alias("len"), F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g")).alias("hash")).where(F.col("len") >= min_chars)


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(hash, len, first) of lines on at least ``min_sites`` distinct sites."""
    sketched = lines.groupBy("hash", "len").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("doc_id", "pos", "row")).alias("first"))
    margin = max(1, math.ceil(3 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    wide = scratch.store(sketched.select("hash", "len", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin), "line-spread")
    near = wide.where(F.abs(F.col("sites") - min_sites) <= margin)
    pairs = lines.select("hash", "len", "site").distinct()
    exact = pairs.join(near.select("hash", "len"), ["hash", "len"], "left_semi").groupBy("hash", "len").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    sure = wide.where(F.col("sites") > min_sites + margin).select("hash", "len", "first")
    return sure.unionByName(near.join(exact, ["hash", "len"]).select("hash", "len", "first"))


def _occurrences(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines beside their boilerplate entry, whatever the share of one line."""
    if found.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(found), ["hash", "len"])
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "len", "salt"])


def marked(docs: DataFrame, site: str = "source", min_sites: int = 3, min_chars: int = 15) -> DataFrame:
    """``docs`` with ``removed``, the positions of lines to remove (null: none)."""
    lines = scratch.store(_lines(docs, site, min_chars), "lines")
    found = scratch.store(boilerplate(lines, min_sites), "boilerplate")
    again = _occurrences(lines, found).where(~(F.struct("doc_id", "pos", "row").eqNullSafe(F.col("first"))))
    by_row = again.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("removed"))
    left = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    right = by_row.withColumnRenamed("doc_id", "_doc")
    joined = left.join(right, (left["_row"] == right["row"]) & left["doc_id"].eqNullSafe(right["_doc"]), "left")
    return joined.drop("_row", "row", "_doc")


def _kept_text() -> Column:
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    return F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """Documents without their boilerplate lines, with their own columns."""
    used = ["doc_id", "text", "source"]
    got = marked(columns.pack(docs, used), **options)
    values = {"text": _kept_text()}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.coalesce(F.length(_kept_text()), F.lit(0)).cast("long")
    return columns.unpack(got, docs.columns, used, **values)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the digest of the text that stays."""
    got = marked(docs.select("doc_id", "text", "source"), **options)
    return got.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.md5(_kept_text().cast("binary")).alias("text_md5"),
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))


ORACLE = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, coalesce('s' || source, 'n') AS site, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l
), b AS (
  SELECT key, min({'d': doc_id, 'p': pos}) AS first FROM k
  WHERE length(key) >= 15 GROUP BY key HAVING count(DISTINCT site) >= 3
), r AS (
  SELECT doc_id, list(pos) AS removed FROM k JOIN b ON k.key = b.key
  WHERE doc_id <> first.d OR pos <> first.p GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.text, r.removed
  FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
)
SELECT doc_id,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(removed), 0)::BIGINT AS n_removed,
       md5(CASE WHEN removed IS NULL THEN text ELSE array_to_string(
         list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(removed, i - 1)), chr(10)) END) AS text_md5
FROM m
"""
