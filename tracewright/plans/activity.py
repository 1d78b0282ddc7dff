"""Queries over events, anomalies, steps and scores, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import geometry
from tracewright.operators import events as ev
from tracewright.operators import scoring, sequence, steps
from tracewright.operators import segmentation as seg
from tracewright.operators.settings import Settings
from tracewright.plans.segmentation import BASE, SEGS
from tracewright.sources import adapters as a

S = Settings()
#: The test series are noisy: with these limits some of them stand still at their end.
STILL = replace(S, stall_score=0.6, stall_ms=2000)

MOVES = """, motions AS (
  SELECT job_id, i AS seq, t_ms, (k - 50)::DOUBLE AS dy FROM base WHERE event_type IN ('view', 'signup')
), cur AS (
  SELECT job_id, i AS seq, t_ms, (k * 10)::DOUBLE AS x, floor(value * 4) AS y FROM base WHERE event_type = 'click'
)"""
LEFT = (
    SEGS
    + MOVES
    + """, open AS (
  SELECT s.* FROM segs s WHERE transition_type IN ('nav', 'dialog') AND NOT EXISTS (
    SELECT 1 FROM motions m WHERE m.job_id = s.job_id AND abs(m.dy) >= 3 AND m.t_ms BETWEEN s.start_ms - 500 AND s.start_ms + 250)
), raw AS (
  SELECT o.job_id, o.idx, o.transition_type, o.start_ms,
         max({'t': c.t_ms, 's': c.seq, 'x': c.x, 'y': c.y}) FILTER (c.t_ms IS NOT NULL) AS hit
  FROM open o LEFT JOIN cur c ON c.job_id = o.job_id AND c.t_ms BETWEEN o.start_ms - 1200 AND o.start_ms + 150
  GROUP BY ALL
), clicks AS (
  SELECT job_id, idx AS led_to_segment, CASE WHEN hit IS NULL THEN greatest(0, start_ms - 400) ELSE hit.t END AS t_start_ms,
         start_ms AS t_end_ms, hit.x::BIGINT AS x, hit.y::BIGINT AS y, CASE WHEN hit IS NULL THEN 0.55 ELSE 0.75 END::DOUBLE AS confidence
  FROM raw WHERE hit IS NOT NULL OR transition_type = 'nav'
)"""
)
EVENTS = (
    BASE
    + """, ev AS (
  SELECT job_id, i AS seq, event_id, t_ms AS t_start_ms, t_ms + 100 AS t_end_ms, value, k,
         CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'form_submit' WHEN 'error' THEN CASE WHEN k < 50 THEN 'navigate' ELSE 'dialog_open' END ELSE 'scroll' END AS type
  FROM base
), el AS (
  SELECT job_id, seq, event_id, t_start_ms, t_end_ms, type,
         CASE WHEN type IN ('click', 'form_submit') AND k % 2 = 1 THEN k * 10 END AS x,
         CASE WHEN type IN ('click', 'form_submit') AND k % 2 = 1 THEN floor(value * 4)::BIGINT END AS y,
         CASE WHEN type IN ('click', 'form_submit') AND k % 5 <> 0 THEN ['Save', 'Open cart', 'Help'][k % 3 + 1] ELSE '' END AS target,
         CASE WHEN type = 'scroll' THEN CASE WHEN k < 50 THEN 'down' ELSE 'up' END END AS direction,
         CASE WHEN type = 'scroll' THEN abs(k - 50)::DOUBLE END AS magnitude_px,
         CASE WHEN type IN ('click', 'form_submit') AND k % 2 = 1 THEN 0.75 ELSE 0.55 END::DOUBLE AS confidence
  FROM ev
)"""
)
LIST = (
    EVENTS
    + """, act AS (SELECT * FROM el WHERE type IN ('click', 'tap', 'form_submit')
), effect AS (
  SELECT e.job_id, e.seq FROM el e WHERE e.type IN ('navigate', 'dialog_open') AND EXISTS (
    SELECT 1 FROM act a WHERE a.job_id = e.job_id AND (e.t_start_ms - a.t_end_ms BETWEEN 0 AND 2000
      OR (e.type = 'navigate' AND (abs(e.t_start_ms - a.t_start_ms) <= 400 OR abs(e.t_start_ms - a.t_end_ms) <= 400))))
)"""
)


def islands_sql(source: str, same: str, out: str) -> str:
    """Runs of rows that ``same`` joins to the row before (p)."""
    return f""", {out}_w AS (
  SELECT *, lag(type) OVER w AS p_type, lag(direction) OVER w AS p_direction, lag(t_end_ms) OVER w AS p_end, lag(target) OVER w AS p_target, lag(x) OVER w AS p_x
  FROM {source} WINDOW w AS (PARTITION BY job_id ORDER BY t_start_ms, seq)
), {out}_i AS (
  SELECT *, sum(CASE WHEN coalesce({same}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY t_start_ms, seq) AS isl FROM {out}_w
), {out} AS (
  SELECT job_id, isl, arg_min(seq, (t_start_ms, seq)) AS seq, min(t_start_ms) AS t_start_ms, arg_max(t_end_ms, (t_start_ms, seq)) AS t_end_ms,
         arg_min(type, (t_start_ms, seq)) AS type, first(target ORDER BY t_start_ms, seq) AS target, first(x ORDER BY t_start_ms, seq) AS x, first(y ORDER BY t_start_ms, seq) AS y,
         first(direction ORDER BY t_start_ms, seq) AS direction, round(sum(magnitude_px), 1) AS magnitude_px, count(*) AS n,
         first(confidence ORDER BY t_start_ms, seq) AS c_first, min(confidence) AS c_min, max(confidence) AS c_max
  FROM {out}_i GROUP BY job_id, isl
)"""


KEPT_ONLY = ", kept AS (SELECT el.*, 1 AS merged, 1 AS repeated FROM el WHERE NOT EXISTS (SELECT 1 FROM effect f WHERE f.job_id = el.job_id AND f.seq = el.seq))"
KEPT = LIST + KEPT_ONLY
MERGED_SCROLLS = islands_sql("kept", "type = 'scroll' AND p_type = 'scroll' AND direction = p_direction AND t_start_ms - p_end < 2500", "ms")
SCROLLS = KEPT + MERGED_SCROLLS
MERGED_BLIND = ", m1 AS (SELECT * EXCLUDE (isl, n), c_first AS confidence FROM ms)" + islands_sql("m1", "type IN ('click', 'tap') AND x IS NULL AND target = '' AND p_type IN ('click', 'tap') AND p_x IS NULL AND p_target = '' AND t_start_ms - p_end <= 3000", "mu")
BLIND = SCROLLS + MERGED_BLIND
MERGED_AGAIN = ", m2 AS (SELECT * EXCLUDE (isl, n), c_min AS confidence, n AS merged FROM mu)" + islands_sql("m2", "type = p_type AND type IN ('click', 'tap', 'form_submit') AND target <> '' AND target = p_target AND t_start_ms - p_end <= 3000", "mr")
AGAIN = BLIND + MERGED_AGAIN
#: From usable events (el) to merged ones (mr, with the counts of mu).
CHAIN = LIST[len(EVENTS) :] + KEPT_ONLY + MERGED_SCROLLS + MERGED_BLIND + MERGED_AGAIN


def _segs(spark, sf):
    return seg.segments(a.samples(spark, sf))


def scroll_islands(spark, sf):
    return ev.scrolls(a.motions(spark, sf)).drop("island").withColumn("signals", F.array_join("signals", ","))


def scroll_explains_anti(spark, sf):
    return ev.unexplained(_segs(spark, sf), a.motions(spark, sf)).select("job_id", "idx", "start_ms", "transition_type")


def click_asof_cursor(spark, sf):
    got = ev.raw_clicks(_segs(spark, sf), a.cursor(spark, sf), a.motions(spark, sf), scale=1.25)
    return got.withColumn("signals", F.array_join("signals", ",")).withColumn("x", F.coalesce("x", F.lit(-1).cast("long"))).withColumn("y", F.coalesce("y", F.lit(-1).cast("long")))


def click_dedupe(spark, sf):
    e = a.event_list(spark, sf).where(F.col("type") == "click").select("job_id", "seq", "t_start_ms", "confidence")
    return ev.deduped(e, "seq").select("job_id", "seq", "t_start_ms", "confidence")


def blank_dedupe(spark, sf):
    return ev.blanks(a.samples(spark, sf)).select("job_id", "t_ms", "lum", "ord")


def stall_detect(spark, sf):
    s = a.samples(spark, sf)
    return ev.stalls(s, ev.last_actions(a.event_list(spark, sf).where("type <> 'scroll'")), STILL)


def bug_rank_top6(spark, sf):
    s = a.samples(spark, sf)
    dark = ev.blanks(s).select("job_id", "t_ms", "type", "score", "ord")
    loud = s.where("score >= 0.9").select("job_id", "t_ms", F.lit("layout_shift").alias("type"), F.col("change_frac").alias("score"), F.col("i").alias("ord"))
    return ev.ranked(dark.unionByName(loud)).select("job_id", "place", "t_ms", "type", "score", "bug_type")


def compress_semi(spark, sf):
    return steps.suppressed(a.event_list(spark, sf)).select("job_id", "seq", "type", "t_start_ms")


def compress_anti(spark, sf):
    return steps.unsuppressed(a.event_list(spark, sf)).select("job_id", "seq", "type", "t_start_ms")


def post_bug_cut(spark, sf):
    e = a.event_list(spark, sf)
    bugs = e.where("type = 'dialog_open'").groupBy("job_id").agg(F.min("t_start_ms").alias("t_ms"))
    usable, spans = steps.post_bug_cut(e, bugs)
    kept = usable.groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(spans, "job_id", "full").select("job_id", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("n", F.lit(0)).cast("long").alias("omitted"), "t_start_ms", "t_end_ms")


def merge_scrolls(spark, sf):
    return steps.merged_scrolls(steps.unsuppressed(a.event_list(spark, sf))).select("job_id", "seq", "type", "t_start_ms", "t_end_ms", "magnitude_px")


def merge_unlabeled(spark, sf):
    return steps.merged_unlabeled(steps.merged_scrolls(steps.unsuppressed(a.event_list(spark, sf)))).select("job_id", "seq", "type", "t_end_ms", "confidence", F.col("merged_count").alias("n"))


def merge_repeated(spark, sf):
    m = steps.merged_unlabeled(steps.merged_scrolls(steps.unsuppressed(a.event_list(spark, sf))))
    return steps.merged_repeated(m).select("job_id", "seq", "type", "target", "t_end_ms", "confidence", F.col("repeat_count").alias("n"))


def step_sentences(spark, sf):
    """The flagship: every recording's steps, phrased, numbered and scored."""
    made = steps.synthesized(a.event_list(spark, sf), 1080, 720)
    return scoring.propagated(made.select("job_id", "idx", "text", "uncertainty_note", "grounding", scoring.step_confidence(F.col("confidence"), F.lit(0.8), F.lit(0.9)).alias("confidence")))


def propagate(spark, sf):
    e = a.event_list(spark, sf).where("type <> 'scroll'")
    w = Window.partitionBy("job_id").orderBy("t_start_ms", "seq")
    return scoring.propagated(e.select("job_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.round(F.col("confidence"), 3).alias("confidence")))


def chronology_violations(spark, sf):
    w = Window.partitionBy("job_id").orderBy("event_id")
    e = a.event_list(spark, sf).select("job_id", F.row_number().over(w).cast("long").alias("idx"), (F.col("t_start_ms") - F.when(F.col("seq") % 7 == 3, 4000).otherwise(0)).alias("t_ms"))
    return scoring.violations(e).select("job_id", "idx", "t_ms", F.col("before").cast("long").alias("before"))


def coverage(spark, sf):
    e = a.event_list(spark, sf)
    ends = e.groupBy("job_id").agg(F.min_by("t_start_ms", F.struct("t_start_ms", "seq")).alias("first_ms"), F.max_by("t_end_ms", F.struct("t_start_ms", "seq")).alias("last_ms"))
    return ends.select("job_id", scoring.coverage(F.col("last_ms") - F.col("first_ms"), F.lit(60000)).alias("coverage"))


def overall_confidence(spark, sf):
    e = a.event_list(spark, sf)
    jobs = e.groupBy("job_id").agg(F.round(F.max("confidence"), 3).alias("bug"), F.lit(0.5).alias("coverage"))
    basis = F.when(F.col("job_id") % 3 == 0, "visible_convention").when(F.col("job_id") % 3 == 1, "assumed")
    return scoring.overall(e.select("job_id", "confidence"), jobs.withColumn("basis", basis))


def evidence_semi(spark, sf):
    e = a.event_list(spark, sf).select("job_id", "seq", F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat_ws("-", "job_id", F.col("seq"))).alias("frame_id"))
    f = a.samples(spark, sf).where("change_frac >= 0.5").select("job_id", F.concat_ws("-", "job_id", "i").alias("frame_id"))
    return scoring.known_evidence(e, f).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("frame_id") == "", 1).otherwise(0)).alias("unnamed"))


def nearest_frame(spark, sf):
    e = a.event_list(spark, sf).where("type = 'form_submit'").select("job_id", "seq", "t_start_ms")
    f = a.samples(spark, sf).where("change_frac >= 0.8").select("job_id", "i", "t_ms", F.col("t_ms").alias("frame_ms"))
    return sequence.nearest(e, f, "job_id", "t_start_ms", "t_ms", "i", "i", "frame")


def screen_region(spark, sf):
    e = a.event_list(spark, sf).where("x IS NOT NULL")
    r = geometry.region(F.col("x"), F.col("y"), F.lit(1080), F.lit(720))
    c = geometry.crop(F.col("x"), F.col("y"), F.lit(1080), F.lit(720))
    return e.groupBy(r.alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum(c["x0"]).alias("x0"), F.sum(c["y1"]).alias("y1"))


QUERIES = {
    f.__name__: f
    for f in (
        scroll_islands, scroll_explains_anti, click_asof_cursor, click_dedupe, blank_dedupe, stall_detect, bug_rank_top6, compress_semi, compress_anti, post_bug_cut,
        merge_scrolls, merge_unlabeled, merge_repeated, step_sentences, propagate, chronology_violations, coverage, overall_confidence, evidence_semi, nearest_frame, screen_region,
    )
}

FOLD = "list_reduce(list_transform(list({rec} ORDER BY {order}), lambda x: [x]), lambda acc, x: {step})"
BLANKS = """, dark AS (SELECT job_id, t_ms, i, lum FROM samples WHERE coalesce(lum, 100) < 8
), dark_f AS (SELECT job_id, """ + FOLD.format(rec="{'t': t_ms, 'i': i, 'lum': lum}", order="t_ms, i", step="CASE WHEN x[1].t - acc[len(acc)].t >= 2000 THEN list_concat(acc, x) ELSE acc END") + """ AS kept FROM dark GROUP BY job_id
), blanks AS (SELECT job_id, u.b.t AS t_ms, u.b.lum AS lum, u.b.i AS ord FROM dark_f, unnest(kept) AS u(b))"""
REGION = """CASE WHEN fy BETWEEN 0.25 AND 0.75 AND fx BETWEEN 0.33 AND 0.66 THEN 'center of the screen'
  WHEN fy BETWEEN 0.25 AND 0.75 THEN CASE WHEN fx < 0.33 THEN 'left' ELSE 'right' END || ' side of the screen'
  WHEN fx BETWEEN 0.33 AND 0.66 THEN CASE WHEN fy < 0.25 THEN 'top' ELSE 'bottom' END || ' of the screen'
  ELSE CASE WHEN fy < 0.25 THEN 'top ' ELSE 'bottom ' END || CASE WHEN fx < 0.33 THEN 'left' ELSE 'right' END || ' of the screen' END"""
DAMP = FOLD.format(rec="confidence", order="idx", step="list_append(acc, round(x[1] * (0.8 + 0.2 * acc[len(acc)]), 3))")

ORACLE_SQL = {
    "scroll_islands": f"""WITH {BASE} {MOVES}, s AS (SELECT * FROM motions WHERE abs(dy) >= 3), l AS (
        SELECT *, CASE WHEN t_ms - lag(t_ms) OVER w > 600 OR (dy > 0) <> (lag(dy) OVER w > 0) OR lag(t_ms) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM s WINDOW w AS (PARTITION BY job_id ORDER BY t_ms, seq)
      ), g AS (SELECT *, sum(f) OVER (PARTITION BY job_id ORDER BY t_ms, seq) AS isl FROM l)
      SELECT job_id, min(t_ms) AS t_start_ms, max(t_ms) AS t_end_ms, CASE WHEN sum(dy) < 0 THEN 'down' ELSE 'up' END AS direction, round(abs(sum(dy)), 1) AS magnitude_px, 0.92::DOUBLE AS confidence, 'scroll' AS type, 'global_motion' AS signals FROM g GROUP BY job_id, isl""",
    "scroll_explains_anti": f"WITH {LEFT} SELECT job_id, idx, start_ms, transition_type FROM open",
    "click_asof_cursor": f"WITH {LEFT} SELECT * REPLACE (coalesce(trunc(x * 1.25), -1)::BIGINT AS x, coalesce(trunc(y * 1.25), -1)::BIGINT AS y), CASE WHEN x IS NULL THEN 'transition_only' ELSE 'cursor_dwell,transition' END AS signals FROM clicks",
    "click_dedupe": f"""WITH {LIST}, f AS (SELECT job_id, """ + FOLD.format(
        rec="{'t': t_start_ms, 's': seq, 'c': confidence}", order="t_start_ms, seq",
        step="CASE WHEN x[1].t - acc[len(acc)].t >= 800 THEN list_concat(acc, x) WHEN x[1].c > acc[len(acc)].c THEN list_concat(acc[:-2], x) ELSE acc END",
    ) + """ AS kept FROM el WHERE type = 'click' GROUP BY job_id)
      SELECT job_id, u.b.s AS seq, u.b.t AS t_start_ms, u.b.c AS confidence FROM f, unnest(kept) AS u(b)""",
    "blank_dedupe": f"WITH {BASE} {BLANKS} SELECT job_id, t_ms, lum, ord FROM blanks",
    "stall_detect": f"""WITH {LIST}, la AS (SELECT job_id, max(t_end_ms) AS last_ms FROM el WHERE type <> 'scroll' GROUP BY 1), t AS (
        SELECT s.job_id, bool_and(score < 0.6) AS still, min(t_ms) AS t_ms, max(t_ms) - min(t_ms) AS static_ms FROM samples s JOIN la USING (job_id) WHERE t_ms > last_ms GROUP BY 1)
      SELECT job_id, t_ms, 'stall' AS type, static_ms, 0.5::DOUBLE AS score FROM t WHERE still AND static_ms > 2000""",
    "bug_rank_top6": f"""WITH {BASE} {BLANKS}, an AS (
        SELECT job_id, t_ms, 'blank_screen' AS type, 0.7::DOUBLE AS score, ord FROM blanks UNION ALL SELECT job_id, t_ms, 'layout_shift', change_frac, i FROM samples WHERE score >= 0.9
      ), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, t_ms DESC, ord)::INT AS place FROM an)
      SELECT job_id, place, t_ms, type, score, CASE type WHEN 'blank_screen' THEN 'crash' ELSE 'rendering' END AS bug_type FROM r WHERE place <= 6""",
    "compress_semi": f"WITH {LIST} SELECT el.job_id, el.seq, el.type, el.t_start_ms FROM el JOIN effect USING (job_id, seq)",
    "compress_anti": f"WITH {KEPT} SELECT job_id, seq, type, t_start_ms FROM kept",
    "post_bug_cut": f"""WITH {LIST}, b AS (SELECT job_id, min(t_start_ms) AS bug FROM el WHERE type = 'dialog_open' GROUP BY 1), j AS (
        SELECT el.*, coalesce(t_start_ms > bug + 1500, false) AS late FROM el LEFT JOIN b USING (job_id))
      SELECT job_id, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS omitted, min(t_start_ms) FILTER (late) AS t_start_ms, arg_max(t_end_ms, (t_start_ms, seq)) FILTER (late) AS t_end_ms FROM j GROUP BY job_id""",
    "merge_scrolls": f"WITH {SCROLLS} SELECT job_id, seq, type, t_start_ms, t_end_ms, magnitude_px FROM ms",
    "merge_unlabeled": f"WITH {BLIND} SELECT job_id, seq, type, t_end_ms, c_min AS confidence, n FROM mu",
    "merge_repeated": f"WITH {AGAIN} SELECT job_id, seq, type, target, t_end_ms, c_max AS confidence, n FROM mr",
    "step_sentences": f"""WITH {AGAIN}, st AS (
        SELECT mr.*, first_merged.merged AS merged, row_number() OVER (PARTITION BY mr.job_id ORDER BY mr.t_start_ms, mr.seq) AS idx, x / 1080.0 AS fx, y / 720.0 AS fy
        FROM mr JOIN (SELECT job_id, seq, n AS merged FROM mu) first_merged ON first_merged.job_id = mr.job_id AND first_merged.seq = mr.seq
      ), raw AS (SELECT *, round(greatest(0.0, least(1.0, (0.5 * c_max + 0.3 * 0.8 + 0.2 * 0.75)::DOUBLE * 0.9::DOUBLE)), 3) AS confidence FROM st
      ), fold AS (SELECT job_id, {DAMP} AS cs FROM raw GROUP BY job_id
      )
      SELECT raw.job_id, raw.idx,
        CASE WHEN type IN ('click', 'form_submit') THEN CASE
               WHEN target <> '' AND raw.n > 1 THEN 'Click "' || target || '" (' || raw.n || ' times).'
               WHEN target <> '' THEN 'Click "' || target || '".'
               WHEN merged > 1 THEN 'Click through the next ' || merged || ' screens (the exact controls could not be read from the video).'
               WHEN x IS NOT NULL THEN 'Click the control at the ' || ({REGION}) || '.'
               ELSE 'Click the control that opens the next screen.' END
             WHEN type = 'scroll' THEN 'Scroll ' || direction || ' the page.'
             WHEN type = 'navigate' THEN 'Go to the next screen.' ELSE 'A dialog or overlay opens.' END AS text,
        CASE WHEN type IN ('click', 'form_submit') AND target = '' THEN CASE
               WHEN merged > 1 THEN 'several screen changes in a row; individual targets were not readable'
               WHEN x IS NOT NULL THEN 'target text could not be read; location is from the cursor track'
               ELSE 'activation inferred from the screen transition only; the cursor/touch indicator was not visible' END
             WHEN type = 'navigate' THEN 'destination title/URL was not readable' ELSE '' END AS uncertainty_note,
        CASE WHEN c_max >= 0.8 THEN 'observed' ELSE 'inferred' END AS grounding, fold.cs[raw.idx] AS confidence
      FROM raw JOIN fold ON fold.job_id = raw.job_id""",
    "propagate": f"""WITH {LIST}, e AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY t_start_ms, seq) - 1 AS idx, round(confidence, 3) AS confidence FROM el WHERE type <> 'scroll'
      ), f AS (SELECT job_id, {DAMP} AS cs FROM e GROUP BY job_id)
      SELECT e.job_id, e.idx, f.cs[e.idx + 1] AS confidence FROM e JOIN f ON f.job_id = e.job_id""",
    "chronology_violations": f"""WITH {LIST}, e AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS idx, t_start_ms - CASE WHEN seq % 7 = 3 THEN 4000 ELSE 0 END AS t_ms FROM el
      ), b AS (SELECT *, coalesce(max(t_ms) OVER (PARTITION BY job_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM e)
      SELECT job_id, idx, t_ms, before::BIGINT AS before FROM b WHERE t_ms < before - 1500""",
    "coverage": f"""WITH {LIST} SELECT job_id, round(least(1.0, (arg_max(t_end_ms, (t_start_ms, seq)) - min(t_start_ms)) / 60000.0::DOUBLE), 3)::DOUBLE AS coverage FROM el GROUP BY job_id""",
    "overall_confidence": f"""WITH {LIST} SELECT job_id, round(greatest(0.0, least(1.0, 0.35::DOUBLE * median(confidence) + 0.25::DOUBLE * round(max(confidence), 3) + 0.2::DOUBLE * 0.5::DOUBLE
        + 0.2::DOUBLE * (CASE WHEN job_id % 3 = 0 THEN 0.7 WHEN job_id % 3 = 1 THEN 0.3 ELSE 0.5 END)::DOUBLE)), 3) AS overall FROM el GROUP BY job_id""",
    "evidence_semi": f"""WITH {LIST}, e AS (SELECT job_id, seq, CASE WHEN seq % 3 = 0 THEN '' ELSE job_id || '-' || seq END AS frame_id FROM el)
      SELECT job_id, count(*) AS n, sum(CASE WHEN frame_id = '' THEN 1 ELSE 0 END)::BIGINT AS unnamed FROM e
      WHERE frame_id = '' OR EXISTS (SELECT 1 FROM samples s WHERE s.job_id = e.job_id AND s.change_frac >= 0.5 AND s.job_id || '-' || s.i = e.frame_id) GROUP BY job_id""",
    "nearest_frame": f"""WITH {LIST} SELECT el.job_id, el.seq, el.t_start_ms, arg_min(s.i, (abs(s.t_ms - el.t_start_ms), s.i)) AS frame
      FROM el LEFT JOIN samples s ON s.job_id = el.job_id AND s.change_frac >= 0.8 WHERE el.type = 'form_submit' GROUP BY ALL""",
    "screen_region": f"""WITH {LIST}, p AS (SELECT x, y, x / 1080.0 AS fx, y / 720.0 AS fy FROM el WHERE x IS NOT NULL)
      SELECT {REGION} AS region, count(*) AS n, sum(greatest(0, least(x - 230, 620)))::BIGINT AS x0, sum(least(720, greatest(0, least(y - 110, 500)) + 220))::BIGINT AS y1 FROM p GROUP BY 1""",
}
