"""Evidence, chronology and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.sequence import damped
from tracewright.operators.settings import Settings

DEFAULT = Settings()

# Factors of quality flags and scores of what an expectation rests on.
PENALTIES = {"blurry": 0.85, "low_fps": 0.9, "cursor_invisible": 0.9, "camera_capture": 0.7}
BASIS = {"visible_convention": 0.7, "ui_text": 0.8, "narration": 0.6, "assumed": 0.3}


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def quality_flags(fps: Column, blur: Column, cursor_hits: Column) -> Column:
    """Sorted distinct flags of a recording."""
    flags = F.array(F.when((fps > 0) & (fps < 12), "low_fps"), F.when((blur > 0) & (blur < 40), "blurry"), F.when(cursor_hits < 3, "cursor_invisible"))
    return F.array_sort(F.array_distinct(F.array_compact(flags)))


def quality_prior(flags: Column) -> Column:
    product = F.aggregate(flags, F.lit(1.0), lambda acc, f: acc * _lookup(PENALTIES, f, 1.0))
    return F.greatest(F.lit(0.6), F.round(product, 6))


def known_evidence(evidence: DataFrame, frames: DataFrame) -> DataFrame:
    """Evidence rows whose frame exists (or that name none)."""
    return evidence.where(F.col("frame_id") == "").unionByName(evidence.where(F.col("frame_id") != "").join(frames.select("job_id", "frame_id"), ["job_id", "frame_id"], "left_semi").select(*evidence.columns))


def violations(steps: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Steps whose evidence lies well before that of an earlier step."""
    w = Window.partitionBy("job_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = steps.where(F.col("t_ms").isNotNull()).withColumn("before", F.coalesce(F.max("t_ms").over(w), F.lit(-1)))
    return seen.where(F.col("t_ms") < F.col("before") - s.chronology_ms)


def step_confidence(action: Column, evidence: Column, prior: Column, agreement: float = 0.75) -> Column:
    raw = 0.5 * action + 0.3 * F.coalesce(evidence, F.lit(0.4)) + 0.2 * agreement
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * prior)), 3)


def propagated(steps: DataFrame) -> DataFrame:
    """Steps in order of ``idx``, each confidence damped by the uncertainty of the step before it.

    All columns stay; one recording's steps are folded in one pass.
    """
    others = [c for c in steps.columns if c not in ("job_id", "idx", "confidence")]
    jobs = steps.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("idx", "confidence", *others))).alias("r"))
    jobs = jobs.withColumn("c", damped(F.transform("r", lambda r: r["confidence"])))
    each = jobs.select("job_id", F.explode(F.arrays_zip("r", "c")).alias("s"))
    return each.select("job_id", *[F.col("s.c" if c == "confidence" else f"s.r.{c}").alias(c) for c in steps.columns if c != "job_id"])


def coverage(span: Column, duration: Column) -> Column:
    return F.when(duration <= 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), span / duration), 3))


def _overall(mid: Column, bug: Column, covered: Column, basis: Column) -> Column:
    value = 0.35 * F.coalesce(mid, F.lit(0.0)) + 0.25 * bug + 0.2 * covered + 0.2 * basis
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3)


def overall(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, overall): from steps (confidence) and jobs (bug, coverage, basis)."""
    mid = steps.groupBy("job_id").agg(F.median("confidence").alias("mid"))
    basis = F.when(F.col("basis").isNull(), 0.5).otherwise(_lookup(BASIS, F.col("basis"), 0.0))
    return jobs.join(mid, "job_id", "left").select("job_id", _overall(F.col("mid"), F.col("bug"), F.col("coverage"), basis).alias("overall"))


def grounded(steps: DataFrame, frames: DataFrame) -> DataFrame:
    """Steps without evidence of unknown frames; a step that has none left is assumed, with a note."""
    e = steps.select("job_id", "idx", F.explode("evidence").alias("e")).select("job_id", "idx", "e.*")
    left = known_evidence(e, frames).groupBy("job_id", "idx").agg(F.array_sort(F.collect_list(F.struct("t_start_ms", "t_end_ms", "frame_id"))).alias("_e"))
    kept = steps.join(left, ["job_id", "idx"], "left")
    shown = F.transform(F.coalesce("_e", F.array().cast("array<struct<t_start_ms:bigint,t_end_ms:bigint,frame_id:string>>")), lambda x: F.struct(x["frame_id"].alias("frame_id"), x["t_start_ms"].alias("t_start_ms"), x["t_end_ms"].alias("t_end_ms")))
    none = F.col("_e").isNull()
    noted = F.when(none & (F.col("uncertainty_note") == ""), "no direct frame evidence for this step").otherwise(F.col("uncertainty_note"))
    return kept.select(*[{"evidence": shown, "grounding": F.when(none, "assumed").otherwise(F.col("grounding")), "uncertainty_note": noted}.get(c, F.col(c)).alias(c) for c in steps.columns])


def scored(steps: DataFrame, frames: DataFrame, blocks: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated steps with their final confidence, and one row of scores per job.

    ``jobs`` has flags (array), bug (confidence), basis (null: none),
    expected_confidence and duration_ms.  Scores: overall, actions, ocr, bug_localization,
    expected_result, coverage, and notes on the chronology.
    """
    checked = grounded(steps, frames)
    ocr = blocks.groupBy("job_id").agg(F.round(F.avg("confidence"), 9).alias("ocr"))
    rated = checked.join(jobs.select("job_id", quality_prior(F.col("flags")).alias("_prior")), "job_id").join(ocr, "job_id", "left")
    seen = F.when(F.size("evidence") > 0, F.coalesce("ocr", F.lit(0.0)))
    raw = rated.withColumn("confidence", step_confidence(F.col("confidence"), seen, F.col("_prior"))).drop("_prior", "ocr")
    final = propagated(raw)
    low = (F.col("confidence") < 0.6) & (F.col("uncertainty_note") == "")
    final = final.withColumn("uncertainty_note", F.when(low, "low-confidence inference; verify during review").otherwise(F.col("uncertainty_note")))
    # The span runs between the first and the last step, if both have evidence.
    ends = final.groupBy("job_id").agg(
        F.median("confidence").alias("mid"),
        F.round(F.avg("confidence"), 3).alias("actions"),
        F.min_by(F.get("evidence", F.lit(0))["t_start_ms"], "idx").alias("_from"),
        F.max_by(F.get("evidence", F.lit(0))["t_end_ms"], "idx").alias("_to"),
    )
    at = final.withColumn("t_ms", F.array_min(F.transform("evidence", lambda e: e["t_start_ms"])))
    said = F.concat(F.lit("chronology check: step "), F.col("key"), F.lit(" evidence at "), F.col("t_ms").cast("string"), F.lit("ms precedes prior step"))
    notes = violations(at.select("job_id", "idx", "key", "t_ms")).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", said.alias("s")))), lambda x: x["s"]).alias("chronology"))
    all_ = jobs.join(ends, "job_id", "left").join(ocr, "job_id", "left").join(notes, "job_id", "left")
    all_ = all_.withColumn("coverage", coverage(F.coalesce(F.col("_to") - F.col("_from"), F.lit(0)), F.col("duration_ms")))
    shares = F.when(F.col("basis").isNull(), 0.5).otherwise(_lookup(BASIS, F.col("basis"), 0.0))
    return final, all_.select(
        "job_id",
        _overall(F.col("mid"), F.col("bug"), F.col("coverage"), shares).alias("overall"),
        F.coalesce("actions", F.lit(0.0)).alias("actions"),
        F.round(F.coalesce("ocr", F.lit(0.0)), 3).alias("ocr"),
        F.round("bug", 3).alias("bug_localization"),
        F.when(F.col("basis").isNull(), 0.0).otherwise(F.col("expected_confidence")).alias("expected_result"),
        "coverage",
        F.coalesce("chronology", F.array().cast("array<string>")).alias("chronology"),
    )
