"""Queries over change samples, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracewright.functions import geometry
from tracewright.operators import media, probe, scoring
from tracewright.operators import segmentation as seg
from tracewright.operators.settings import Settings
from tracewright.sources import adapters as a
from tracewright.sources.tables import table

S = Settings()
#: The test timelines are short: with these limits about half of the boundaries count as ambient.
BUSY = replace(S, ambient_samples=8, nav_rate=3.0, dialog_rate=3.0)

BASE = """
base AS (
  SELECT user_id AS job_id, event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CAST(floor((epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY user_id)) / 36000.0) AS BIGINT) AS t_ms,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
  FROM events
), samples AS (
  SELECT job_id, i, t_ms, round(least(value / 250, 1.0), 4) AS score, round(k / 100.0, 4) AS change_frac, round(value, 1) AS lum FROM base
), thr AS (
  SELECT job_id, round(greatest(0.08, avg(score) + 2 * stddev_pop(score)), 6) AS threshold FROM samples GROUP BY job_id
)"""

MARKS = (
    BASE
    + """, cand AS (
  SELECT s.* FROM samples s JOIN thr USING (job_id) WHERE s.i = 0 OR s.score >= thr.threshold
), folded AS (
  SELECT job_id, list_reduce(
    list_transform(list({'i': i, 't': t_ms} ORDER BY i), lambda x: [x]),
    lambda acc, x: CASE WHEN x[1].t - acc[len(acc)].t >= 700 THEN list_concat(acc, x) ELSE acc END) AS kept
  FROM cand GROUP BY job_id
), marks AS (
  SELECT f.job_id, u.k.i AS i, s.t_ms, s.score, s.change_frac
  FROM folded f, unnest(f.kept) AS u(k) JOIN samples s ON s.job_id = f.job_id AND s.i = u.k.i
), span AS (
  SELECT job_id, max(t_ms) - min(t_ms) AS span, max(t_ms) + 200 AS end_ms FROM samples GROUP BY job_id
), amb AS (
  SELECT m.job_id, m.i, count(s.t_ms) AS n,
         round(count(s.t_ms) / greatest(any_value(span.span) / 60000.0, 1.0 / 60), 4) AS rate_per_min,
         round(CASE WHEN any_value(span.span) > 0 THEN coalesce(max(s.t_ms) - min(s.t_ms), 0) / any_value(span.span)::DOUBLE ELSE 0.0 END, 4) AS spread
  FROM marks m JOIN span ON span.job_id = m.job_id
  LEFT JOIN samples s ON s.job_id = m.job_id AND m.score > 0 AND s.score >= 0.6 * m.score AND s.score <= 1.6 * m.score
  GROUP BY m.job_id, m.i
)"""
)


def segs_sql(samples: int = 30, nav: float = 24.0, dialog: float = 8.0) -> str:
    return (
        MARKS
        + f""", segs AS (
  SELECT m.job_id, row_number() OVER w - 1 AS idx, m.t_ms AS start_ms, coalesce(lead(m.t_ms) OVER w, span.end_ms) AS end_ms,
         CASE WHEN row_number() OVER w = 1 THEN 'start'
              WHEN m.change_frac >= 0.55 THEN CASE WHEN amb.n >= {samples} AND amb.spread >= 0.7 AND amb.rate_per_min > {nav} THEN 'minor' ELSE 'nav' END
              WHEN m.change_frac >= 0.12 THEN CASE WHEN amb.n >= {samples} AND amb.spread >= 0.7 AND amb.rate_per_min > {dialog} THEN 'minor' ELSE 'dialog' END
              ELSE 'minor' END AS transition_type
  FROM marks m JOIN span USING (job_id) JOIN amb ON amb.job_id = m.job_id AND amb.i = m.i
  WINDOW w AS (PARTITION BY m.job_id ORDER BY m.i)
)"""
    )


SEGS = segs_sql()


def sample_threshold(spark, sf):
    return seg.thresholds(a.samples(spark, sf))


def boundaries_greedy(spark, sf):
    return seg.boundaries(a.samples(spark, sf)).select("job_id", "i", "t_ms")


def segments(spark, sf):
    return seg.segments(a.samples(spark, sf))


def ambient_profile(spark, sf):
    return seg.ambient(a.samples(spark, sf))


def transition_mix(spark, sf):
    return seg.segments(a.samples(spark, sf), BUSY).groupBy("transition_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


def keyframe_times(spark, sf):
    return seg.keyframe_times(seg.segments(a.samples(spark, sf)))


def upper_median_theme(spark, sf):
    return seg.themes(a.samples(spark, sf))


def vector_hist_delta(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("series"), "vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("v"))
    return media.series_deltas(v, "series", "vec_id", "v", 0.1)


def fps_flags(spark, sf):
    p = table(spark, sf, "part")
    rated = p.withColumn("rate", F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(1001).cast("string"))).withColumn("fps", F.round(probe.fps(F.col("rate")), 4))
    flags = scoring.quality_flags(F.col("fps"), F.col("p_retailprice") / 25, F.col("p_partkey") % 5)
    w, h = (F.col("p_size") * 40).cast("int"), ((F.col("p_partkey") % 50) * 40).cast("int")
    vw, vh = geometry.viewport(w, h)
    device = probe.device_class(w, h)
    return rated.select(F.col("p_partkey").alias("job_id"), "fps", F.array_join(flags, ",").alias("flags"), scoring.quality_prior(flags).alias("prior"), vw.cast("long").alias("width"), vh.cast("long").alias("height"), device.alias("device_class"))


def blur_medians(spark, sf):
    """Upper median of the first ten samples of each job."""
    return seg.blur_medians(a.samples(spark, sf), "lum")


QUERIES = {f.__name__: f for f in (sample_threshold, boundaries_greedy, segments, ambient_profile, transition_mix, keyframe_times, upper_median_theme, vector_hist_delta, fps_flags, blur_medians)}

ORACLE_SQL = {
    "sample_threshold": f"WITH {BASE} SELECT job_id, threshold FROM thr",
    "boundaries_greedy": f"WITH {MARKS} SELECT job_id, i, t_ms FROM marks",
    "segments": f"WITH {SEGS} SELECT job_id, idx, start_ms, end_ms, transition_type FROM segs",
    "ambient_profile": f"WITH {MARKS} SELECT job_id, i, n::BIGINT AS n, rate_per_min, spread FROM amb",
    "transition_mix": f"WITH {segs_sql(8, 3.0, 3.0)} SELECT transition_type, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS total_ms FROM segs GROUP BY 1",
    "keyframe_times": f"""WITH {SEGS}, t AS (
      SELECT job_id, idx AS segment_idx, least(start_ms + 350, end_ms - 1) AS a, CASE WHEN end_ms - start_ms > 4000 THEN end_ms - 500 END AS b FROM segs)
      SELECT job_id, segment_idx, 0::BIGINT AS part, a AS t_ms FROM t UNION ALL SELECT job_id, segment_idx, 1::BIGINT, b FROM t WHERE b IS NOT NULL""",
    "upper_median_theme": f"""WITH {BASE}, m AS (SELECT job_id, list_sort(list(lum))[count(*) // 2 + 1] AS median_lum FROM samples GROUP BY job_id)
      SELECT job_id, median_lum, CASE WHEN coalesce(median_lum, 128) < 90 THEN 'dark' ELSE 'light' END AS theme FROM m""",
    "vector_hist_delta": """WITH v AS (
        SELECT label::BIGINT AS series, vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS v FROM embeddings
      ), p AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY vec_id) AS b FROM v
      ), x AS (SELECT series, vec_id, pos, v[pos] AS q, b[pos] AS p, b IS NULL AS first FROM p, unnest(range(1, len(v) + 1)) AS u(pos)
      ), s AS (SELECT series, vec_id, bool_or(first) AS first, corr(p, q) AS c, avg(CASE WHEN abs(p - q) > 0.1 THEN 1.0 ELSE 0.0 END) AS f FROM x GROUP BY 1, 2)
      SELECT series, vec_id, round(CASE WHEN first THEN 0.0 ELSE 0.6 * greatest(0.0, 1 - coalesce(c, 0)) + 0.4 * f END, 4) AS score,
             round(CASE WHEN first THEN 0.0 ELSE f END, 4) AS change_frac FROM s""",
    "fps_flags": """WITH p AS (
        SELECT p_partkey AS job_id, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE round(p_size * 1000 / 1001.0::DOUBLE, 4) END AS fps,
               p_retailprice / 25 AS blur, p_partkey % 5 AS hits, p_size * 40 AS w, (p_partkey % 50) * 40 AS h FROM part
      ), f AS (SELECT *, fps > 0 AND fps < 12 AS low, blur > 0 AND blur < 40 AS soft, hits < 3 AS blind FROM p)
      SELECT job_id, fps, concat_ws(',', CASE WHEN soft THEN 'blurry' END, CASE WHEN blind THEN 'cursor_invisible' END, CASE WHEN low THEN 'low_fps' END) AS flags,
        greatest(0.6, round((CASE WHEN soft THEN 0.85 ELSE 1.0 END)::DOUBLE * (CASE WHEN blind THEN 0.9 ELSE 1.0 END)::DOUBLE * (CASE WHEN low THEN 0.9 ELSE 1.0 END)::DOUBLE, 6))::DOUBLE AS prior,
        (CASE WHEN w = 0 OR h = 0 THEN 0 WHEN w >= h THEN least(1080, w) ELSE round_even(w::DOUBLE * least(1080, h) / h / 2, 0) * 2 END)::BIGINT AS width,
        (CASE WHEN w = 0 OR h = 0 THEN 0 WHEN w >= h THEN round_even(h::DOUBLE * least(1080, w) / w / 2, 0) * 2 ELSE least(1080, h) END)::BIGINT AS height,
        CASE WHEN h > 1.2 * w THEN 'mobile' ELSE 'desktop' END AS device_class FROM f""",
    "blur_medians": f"WITH {BASE} SELECT job_id, list_sort(list(lum))[count(*) // 2 + 1] AS blur FROM samples WHERE i < 10 GROUP BY job_id",
}
