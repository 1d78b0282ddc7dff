"""Queries over artifacts, objects and containers, with their SQL: what is written is read back and measured."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import media, probe, recordings
from tracewright.sources import tables
from tracewright.sources.tables import fresh, stored, table


def artifacts_replaced(spark, sf):
    """Artifacts of every customer, some jobs and stages written anew, and one stage read back."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    score = F.when(key % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal"))
    rows = c.select(
        key.alias("t_ms"), score.alias("score"), (key % 100 / 100).alias("change_frac"), F.lit(9.0).alias("lum"),
        F.col("c_nationkey").cast("string").alias("org_id"), F.regexp_replace("c_mktsegment", "[^A-Za-z]", "").alias("job_id"), F.when(key % 2 == 0, "s03").otherwise("s05").alias("stage"),
    )
    root = fresh(spark, "artifacts")
    place = ["org_id", "job_id", "stage"]
    tables.write_artifacts(rows.repartition(*place), root)
    # A second run has fewer rows of some jobs: theirs replace what was there, all others stay.
    tables.write_artifacts(rows.where("t_ms % 3 = 0 AND org_id % 2 = 1").withColumn("lum", F.lit(1.0)).repartition(*place), root)
    read = tables.artifacts(spark, root, tables.SAMPLE).where("stage = 's03'")
    return read.select("org_id", "job_id", "t_ms", F.coalesce("score", F.lit(-1e9)).alias("score"), "change_frac", "lum")


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    """(name, frame, width, height, pixels): up to three gray pictures for each supplier, none for every fourth."""
    s = table(spark, sf, "supplier").withColumn("n", F.col("s_suppkey") % 4)
    width, height = (1 + F.pmod(F.floor("s_acctbal"), F.lit(50))).cast("int"), (1 + F.col("s_nationkey")).cast("int")
    pixels = F.rpad(F.encode("s_name", "UTF-8"), 2000, F.lit(b"."))
    one = s.where("n > 0").select(F.col("s_suppkey").cast("string").alias("name"), F.explode(F.sequence(F.lit(1), "n")).alias("frame"), width.alias("width"), height.alias("height"), pixels.alias("p"))
    return one.select("name", "frame", "width", "height", F.substring(F.col("p"), F.lit(1), F.col("width") * F.col("height")).alias("pixels"))


def _uploads(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """(video_id, path) that every supplier should have, and the folder where most are."""
    folder = fresh(spark, "uploads")
    stored(recordings.written(_pictures(spark, sf), folder), "uploads-written")
    wanted = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("video_id"), F.concat(F.lit(folder + "/"), F.col("s_suppkey").cast("string")).alias("path"))
    return wanted, folder


def _name(path: str):
    return F.substring_index(path, "/", -1).cast("long").alias("video_id")


def objects_listed(spark, sf):
    """Which uploads are there, and how long; the files are listed and not read."""
    wanted, folder = _uploads(spark, sf)
    there = tables.listing(spark, folder).select(_name("path"), F.col("length").alias("byte_size"))
    got = wanted.join(there, "video_id", "left")
    return got.select("video_id", F.col("byte_size").isNotNull().alias("there"), F.coalesce("byte_size", F.lit(0)).alias("byte_size"))


def blobs_hashed(spark, sf):
    """Length and content hash of every file."""
    _, folder = _uploads(spark, sf)
    return tables.blobs(spark, folder).select(_name("path"), F.col("length").alias("byte_size"), "sha256")


def _container(path: str) -> str:
    """What a probe says of concatenated pictures at two seconds each; it fails where no file is."""
    form = recordings.Pgm()
    with recordings.opened(path) as f:
        width, height, _ = form.head(f, 0)
        n = sum(1 for _ in form.index(f, f.size()))
    video = {"codec_type": "video", "codec_name": "pgm", "avg_frame_rate": "1/2", "width": width, "height": height}
    return json.dumps({"format": {"format_name": "gray", "duration": f"{2.0 * n}"}, "streams": [video]})


def recordings_probed(spark, sf):
    """A probe run on every upload in tasks, its JSON parsed and held against the policy; what it cannot open is told so."""
    wanted, _ = _uploads(spark, sf)
    said = stored(probe.probed(wanted, _container), "probes")
    got = probe.validated(probe.parsed(said))
    return got.select(_name("path"), "container", "codec", "duration_s", "fps", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "device_class", F.coalesce("error", F.lit("")).alias("error"))


def packet_durations(spark, sf):
    """The last readable stamp of each recording's packets, some of which have none."""
    li = table(spark, sf, "lineitem")
    stamp = lambda c, bad: F.when(bad, "N/A").otherwise(F.col(c).cast("string"))
    packets = li.select(F.col("l_orderkey").cast("string").alias("path"), stamp("l_quantity", F.col("l_linenumber") % 3 == 0).alias("pts_time"), F.when(F.col("l_partkey") % 5 != 0, stamp("l_discount", F.col("l_linenumber") % 2 == 0)).alias("dts_time"))
    return tables.packet_duration(packets)


def polygon_boxes(spark, sf):
    """Boxes around the polygons that a recogniser gives for slanted lines."""
    x, y, slant = F.col("p_partkey") % 500, F.col("p_size").cast("long"), F.col("p_partkey") % 7 - 3
    width, height = F.length("p_name"), F.lit(12)
    point = lambda px, py: F.struct(px.cast("double").alias("x"), (py + 0.75).alias("y"))
    points = F.array(point(x, y), point(x + width, y + slant), point(x + width - slant, y + height + slant), point(x - slant, y + height))
    return table(spark, sf, "part").select("p_partkey", media.polygon_box(points).alias("b")).select("p_partkey", "b.*")


#: Side of the frames of ``media_moves``: a dot and its surroundings are small enough there for a cursor.
SIDE = 64


def media_moves(spark, sf):
    """Motion of whole frames and of one dot, in places that the suppliers' balances give.

    Five frames: a texture, the same moved with its edges carried round, plain
    gray, a dot, the same dot.
    """
    cents = F.abs(F.round(F.col("s_acctbal") * 100)).cast("long")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", cents.alias("c"))
    s = s.select("*", (F.col("c") % 31 - 15).cast("int").alias("dx"), (F.floor(F.col("c") / 31) % 31 - 15).cast("int").alias("dy"), (F.col("c") % SIDE).cast("int").alias("x"), (F.floor(F.col("c") / SIDE) % SIDE).cast("int").alias("y"))
    rows = F.sequence(F.lit(0), F.lit(SIDE - 1))
    texture = F.transform(rows, lambda r: F.sha2(F.concat_ws(" ", "s_name", r.cast("string")), 512))  # 64 bytes: one row each
    turned = lambda h: F.concat(F.substring(h, 2 * SIDE + 1 - 2 * F.pmod("dx", F.lit(SIDE)), F.lit(2 * SIDE)), F.substring(h, F.lit(1), 2 * SIDE - 2 * F.pmod("dx", F.lit(SIDE))))
    moved = F.transform(rows, lambda r: turned(F.get(F.col("t"), F.pmod(r - F.col("dy"), F.lit(SIDE)))))
    blank = F.lit("40" * SIDE * SIDE)
    place = (F.col("y") * SIDE + F.col("x")) * 2
    dot = F.concat(F.substring(blank, F.lit(1), place), F.lit("FF"), F.substring(blank, place + 3, F.lit(2 * SIDE * SIDE)))
    head = F.lit(f"P5 {SIDE} {SIDE} 255\n").cast("binary")
    frames = [F.array_join("t", ""), F.array_join(moved, ""), blank, dot, dot]
    content = F.concat(*[F.concat(head, F.unhex(f)) for f in frames])
    files = s.withColumn("t", texture).select(F.col("s_suppkey").cast("string").alias("path"), content.alias("content"))
    m = media.frames_of(files, fps=5.0, sample_fps=5.0).where("t_ms IN (200, 600, 800)")
    # From plain gray to a dot, nothing has moved as a whole.
    whole = lambda c: F.when(F.col("t_ms") != 600, F.round(c)).cast("long").alias(c)
    return m.select(
        F.col("path").cast("long").alias("video_id"), "t_ms", *[F.coalesce(whole(c), F.lit(99)).alias(c) for c in ("dx", "dy")],
        *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("x", "y")], F.coalesce("conf", F.lit(0.0)).alias("confidence"),
    )


QUERIES = {f.__name__: f for f in (artifacts_replaced, objects_listed, blobs_hashed, recordings_probed, packet_durations, polygon_boxes, media_moves)}

PICTURES = """p AS (SELECT s_suppkey AS video_id, s_suppkey % 4 AS n, ((floor(s_acctbal)::BIGINT % 50 + 50) % 50 + 1)::BIGINT AS w, (s_nationkey + 1)::BIGINT AS h, s_name FROM supplier
), f AS (SELECT video_id, n, w, h, repeat('P5' || chr(10) || w || ' ' || h || chr(10) || '255' || chr(10) || left(rpad(s_name, 2000, '.'), w * h), n) AS content FROM p)"""

ORACLE_SQL = {
    "artifacts_replaced": """WITH r AS (SELECT c_custkey AS t_ms, CASE WHEN c_custkey % 7 = 0 THEN -1e9::DOUBLE ELSE c_acctbal END AS score, c_custkey % 100 / 100.0::DOUBLE AS change_frac, c_nationkey AS org,
          regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g') AS job_id FROM customer WHERE c_custkey % 2 = 0
      ), again AS (SELECT * FROM r WHERE t_ms % 3 = 0 AND org % 2 = 1), met AS (SELECT DISTINCT org, job_id FROM again)
      SELECT org::VARCHAR AS org_id, job_id, t_ms, score, change_frac, 9.0::DOUBLE AS lum FROM r ANTI JOIN met USING (org, job_id)
      UNION ALL SELECT org::VARCHAR, job_id, t_ms, score, change_frac, 1.0::DOUBLE FROM again""",
    "objects_listed": f"WITH {PICTURES} SELECT video_id, n > 0 AS there, length(content)::BIGINT AS byte_size FROM f",
    "blobs_hashed": f"WITH {PICTURES} SELECT video_id, length(content)::BIGINT AS byte_size, sha256(content) AS sha256 FROM f WHERE n > 0",
    "recordings_probed": f"""WITH {PICTURES} SELECT video_id, CASE WHEN n > 0 THEN 'gray' ELSE '' END AS container, CASE WHEN n > 0 THEN 'pgm' ELSE '' END AS codec, n * 2.0::DOUBLE AS duration_s, CASE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS fps,
      CASE WHEN n > 0 THEN w ELSE 0 END AS width, CASE WHEN n > 0 THEN h ELSE 0 END AS height, CASE WHEN n > 0 AND h * 10 > w * 12 THEN 'mobile' ELSE 'desktop' END AS device_class, CASE WHEN n > 0 THEN '' ELSE 'file contains no video stream' END AS error FROM f""",
    "packet_durations": """SELECT l_orderkey::VARCHAR AS path, coalesce(max(greatest(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END, CASE WHEN l_partkey % 5 <> 0 AND l_linenumber % 2 <> 0 THEN l_discount END)), 0.0::DOUBLE) AS duration_s FROM lineitem GROUP BY 1""",
    "polygon_boxes": """WITH q AS (SELECT p_partkey, p_partkey % 500 AS x, p_size::BIGINT AS y, p_partkey % 7 - 3 AS s, length(p_name)::BIGINT AS w FROM part)
      SELECT p_partkey, least(x, x - s) AS x, trunc(y + least(0, s) + 0.75::DOUBLE)::BIGINT AS y, greatest(x, x - s, x + w, x + w - s) - least(x, x - s, x + w, x + w - s) AS w, 12 + greatest(s, 0) - least(s, 0) AS h FROM q""",
    "media_moves": f"""WITH c AS (SELECT s_suppkey AS video_id, abs(round(s_acctbal * 100))::BIGINT AS c FROM supplier
      ), m AS (SELECT video_id, c % 31 - 15 AS dx, (c // 31) % 31 - 15 AS dy, c % {SIDE} AS x, (c // {SIDE}) % {SIDE} AS y FROM c
      ), d AS (SELECT *, (3 - (x IN (0, {SIDE - 1}))::INT) AS w, (3 - (y IN (0, {SIDE - 1}))::INT) AS h FROM m)
      SELECT video_id, 200::BIGINT AS t_ms, dx, dy, -1::BIGINT AS x, -1::BIGINT AS y, 0.0::DOUBLE AS confidence FROM m
      UNION ALL SELECT video_id, 800, 0, 0, -1, -1, 0.0::DOUBLE FROM m
      UNION ALL SELECT video_id, 600, 99, 99, CASE WHEN w * h > 4 THEN least(x, {SIDE - 2}) ELSE -1 END, CASE WHEN w * h > 4 THEN least(y, {SIDE - 2}) ELSE -1 END,
        CASE WHEN w * h > 4 THEN round(0.5::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, pi() * w * h / ((w + h) * (w + h))), 2) ELSE 0.0::DOUBLE END FROM d""",
}
