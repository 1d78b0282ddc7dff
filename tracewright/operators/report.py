"""Assembly and validation of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.geometry import no_place, one_place, upper_first
from tracewright.operators import contract
from tracewright.operators.contract import BASES, BUG_TYPES, GROUNDINGS
from tracewright.operators.segmentation import themes
from tracewright.operators.sequence import nearest

# Sentences of a report.
EXPECTED = "The action completes without the error shown, or the UI explains clearly which input must change."
AMBIGUITIES = {
    "no events": "No user actions could be detected; the recording may be static, heavily degraded, or show only the failure state.",
    "cursor_invisible": "No cursor or touch indicator was visible; click positions are inferred from screen transitions.",
    "blurry": "The recording is blurry; extracted text may be incomplete.",
    "no bug": "The bug manifestation point was not detected automatically and must be marked during review.",
}
NO_TEXTS = "array<string>"
FACTS = "array<struct<text:string,grounding:string,confidence:double>>"
OMITTED = "array<struct<t_start_ms:bigint,t_end_ms:bigint,reason:string>>"


def environments(jobs: DataFrame, blocks: DataFrame, samples: DataFrame) -> DataFrame:
    """(job_id, environment, field_confidence) from jobs (width, height, device_class), their text and their light."""
    bars = blocks.groupBy("job_id").agg(F.bool_or(F.col("role") == "url_bar").alias("_bar"))
    light = themes(samples).select("job_id", "theme")
    out = jobs.join(bars, "job_id", "left").join(light, "job_id", "left")
    bar = F.coalesce("_bar", F.lit(False))
    size = F.concat(F.coalesce("width", F.lit(0)).cast("string"), F.lit("x"), F.coalesce("height", F.lit(0)).cast("string"))
    values = {"os": F.lit(""), "browser": F.when(bar, "browser (URL bar visible)").otherwise(""), "app": F.lit(""), "device_class": F.coalesce("device_class", F.lit("unknown")), "resolution": size, "locale": F.lit(""), "theme": F.coalesce("theme", F.lit("light"))}
    sure = {"device_class": F.lit(0.8), "resolution": F.lit(0.95), "browser": F.when(bar, 0.7).otherwise(0.0), "theme": F.lit(0.75)}
    return out.select("job_id", F.struct(*[v.alias(k) for k, v in values.items()]).alias("environment"), F.create_map(*[x for k, v in sure.items() for x in (F.lit(k), v)]).alias("field_confidence"))


def title(found: Column, bug_type: Column, source: Column, filename: Column, job_id: Column) -> Column:
    word = upper_first(F.when(found, bug_type).otherwise("issue"))
    name = F.coalesce(F.nullif(filename, F.lit("")), F.left(job_id.cast("string"), F.lit(8)))
    return F.left(F.when(F.coalesce(source, F.lit("")) != "", F.concat(word, F.lit(" in "), source)).otherwise(F.concat(word, F.lit(" reproduced from recording "), name)), F.lit(200))


def summary(found: Column, duration_s: Column, device: Column) -> Column:
    outcome = F.when(found, "Bug manifestation detected automatically.").otherwise("No bug manifestation auto-detected.")
    return F.concat(F.lit("Reproduction extracted from a "), no_place(duration_s), F.lit("s "), device, F.lit(" recording. "), outcome)


def ambiguity(any_events: Column, flags: Column, found: Column) -> Column:
    has = lambda f: F.array_contains(flags, f)
    return F.array_compact(F.array(F.when(~any_events, AMBIGUITIES["no events"]), F.when(has("cursor_invisible"), AMBIGUITIES["cursor_invisible"]), F.when(has("blurry"), AMBIGUITIES["blurry"]), F.when(~found, AMBIGUITIES["no bug"])))


def alternates(candidates: Column, most: int = 3) -> Column:
    return F.transform(F.slice(candidates, 1, most), lambda c: F.concat(F.lit("Alternative failure point at "), one_place(c["t_ms"] / 1000), F.lit("s ("), c["type"], F.lit(")")))


def assembled(jobs: DataFrame, bugs: DataFrame, steps: DataFrame, omitted: DataFrame, preconditions: DataFrame, titles: DataFrame, environment: DataFrame, frames: DataFrame, events: DataFrame) -> DataFrame:
    """One draft report per job, in the form that the renderers take.

    ``jobs`` has filename, duration_s, device_class, flags; ``bugs`` is what
    ``events.localized`` gives, ``steps`` numbered with key and evidence.
    """
    step = F.struct("idx", "key", "text", "action_type", "grounding", "confidence", "uncertainty_note", "evidence", F.get("evidence", F.lit(0))["t_start_ms"].alias("t_start_ms"))
    made = steps.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s.withField("index", s["idx"])).alias("steps"))
    spans = omitted.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("t_start_ms", "t_end_ms", "reason"))).alias("omitted"))
    said = preconditions.groupBy("job_id").agg(F.collect_list("text").alias("preconditions"), F.collect_list(F.struct("text", "grounding", "confidence")).alias("_facts"))
    active = events.groupBy("job_id").agg(F.lit(True).alias("_active"))
    shown = nearest(bugs.where("found").select("job_id", "t_ms"), frames, "job_id", "t_ms", "t_ms", "seq", "frame_id", "_frame").select("job_id", "_frame")
    out = jobs.join(bugs, "job_id")
    for rows in (made, spans, said, titles.select("job_id", F.col("title").alias("_source")), environment, active, shown):
        out = out.join(rows, "job_id", "left")
    found, t = F.col("found"), F.col("t_ms")
    link = F.array(F.struct(F.coalesce("_frame", F.lit("")).alias("frame_id"), t.alias("t_start_ms"), (t + 500).alias("t_end_ms")))
    none = F.array().cast("array<struct<frame_id:string,t_start_ms:bigint,t_end_ms:bigint>>")
    return out.select(
        "job_id",
        title(found, F.col("bug_type"), F.col("_source"), F.col("filename"), F.col("job_id")).alias("title"),
        summary(found, F.col("duration_s"), F.col("device_class")).alias("summary"),
        "bug_type",
        F.lit(0.5).alias("overall_confidence"),
        F.coalesce("preconditions", F.array().cast(NO_TEXTS)).alias("preconditions"),
        F.coalesce("_facts", F.array().cast(FACTS)).alias("precondition_facts"),
        "environment",
        "field_confidence",
        "steps",
        F.struct(F.col("observed").alias("text"), t.alias("t_ms"), F.when(found, F.col("confidence")).otherwise(0.2).alias("confidence"), F.when(found, link).otherwise(none).alias("evidence")).alias("observed"),
        F.when(found & (F.col("type") == "error_text"), F.struct(F.lit(EXPECTED).alias("text"), F.lit("visible_convention").alias("basis"), F.lit(0.5).alias("confidence"))).alias("expected"),
        F.when(found, F.struct(t.alias("t_ms"), F.col("confidence").alias("confidence"), link.alias("evidence"))).alias("manifestation"),
        alternates(F.col("candidates")).alias("alternates"),
        ambiguity(F.coalesce("_active", F.lit(False)), F.coalesce("flags", F.array().cast(NO_TEXTS)), found).alias("ambiguity"),
        F.coalesce("omitted", F.array().cast(OMITTED)).alias("omitted"),
    )


def finished(drafts: DataFrame, steps: DataFrame, scores: DataFrame) -> DataFrame:
    """Drafts with their scored steps, breakdown and notes on the chronology."""
    step = F.struct("idx", "key", "text", "action_type", "grounding", "confidence", "uncertainty_note", "evidence", F.get("evidence", F.lit(0))["t_start_ms"].alias("t_start_ms"))
    made = steps.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s.withField("index", s["idx"])).alias("steps"))
    parts = ("actions", "ocr", "bug_localization", "expected_result", "coverage")
    rated = scores.select("job_id", F.col("overall").alias("overall_confidence"), F.struct(*parts).alias("breakdown"), "chronology")
    both = drafts.drop("steps", "overall_confidence").join(made, "job_id", "left").join(rated, "job_id")
    return both.withColumn("ambiguity", F.concat("ambiguity", "chronology")).drop("chronology")


#: Names of the contract for columns that renderers know by another.
CONTRACT_NAMES = {
    "observed_result": "observed",
    "expected_result": "expected",
    "bug_manifestation": "manifestation",
    "alternate_interpretations": "alternates",
    "ambiguity_notes": "ambiguity",
    "omitted_activity": "omitted",
    "confidence_breakdown": "breakdown",
}


def exported(reports: DataFrame) -> DataFrame:
    """(job_id, body): each report as a JSON document of the contract, nulls kept.

    Steps without a key are named by their index; preconditions that are texts
    alone are assumptions.
    """
    out = reports.withColumns({theirs: F.col(ours) for theirs, ours in CONTRACT_NAMES.items() if ours in reports.columns})
    kinds = dict(reports.dtypes)
    if "precondition_facts" in kinds:
        out = out.withColumn("preconditions", F.col("precondition_facts"))
    elif "preconditions" in kinds:
        out = out.withColumn("preconditions", F.transform("preconditions", lambda p: F.struct(p.alias("text"))))
    if "steps" in kinds and "key" not in reports.schema["steps"].dataType.elementType.names:
        out = out.withColumn("steps", F.transform("steps", lambda s: s.withField("key", F.concat(F.lit("s"), s["index"].cast("string")))))
    if "environment" in kinds and "field_confidence" in kinds:
        out = out.withColumn("environment", F.col("environment").withField("field_confidence", F.col("field_confidence")))
    return out.select("job_id", contract.body(out).alias("body"))


def violations(reports: DataFrame) -> DataFrame:
    """(job_id, path, rule): what breaks the main rules of the contract, before export; ``contract.violations`` has all rules, on documents."""
    outside = lambda c: ~F.coalesce(c.between(0.0, 1.0), F.lit(False))
    unknown = lambda c, allowed: ~F.coalesce(c.isin(*allowed), F.lit(False))
    broken = lambda path, cond, rule: F.when(cond, F.struct(F.lit(path).alias("path") if isinstance(path, str) else path.alias("path"), F.lit(rule).alias("rule")))
    own = F.array(
        broken("title", F.col("title").isNull(), "required"),
        broken("bug_type", unknown(F.col("bug_type"), BUG_TYPES), "unknown value"),
        broken("overall_confidence", outside(F.col("overall_confidence")), "outside of 0 to 1"),
        broken("observed_result.text", F.col("observed.text").isNull(), "required"),
        broken("expected_result.basis", F.col("expected").isNotNull() & unknown(F.col("expected.basis"), BASES), "unknown value"),
        broken("expected_result.confidence", F.col("expected").isNotNull() & outside(F.col("expected.confidence")), "outside of 0 to 1"),
    )
    at = lambda s, field: F.concat(F.lit("steps["), (s["index"] - 1).cast("string"), F.lit(f"].{field}"))
    each = F.flatten(
        F.transform(
            F.coalesce("steps", F.array()),
            lambda s: F.array(
                broken(at(s, "text"), F.trim(F.coalesce(s["text"], F.lit(""))) == "", "must not be empty"),
                broken(at(s, "grounding"), unknown(s["grounding"], GROUNDINGS), "unknown value"),
                broken(at(s, "confidence"), outside(s["confidence"]), "outside of 0 to 1"),
            ),
        )
    )
    return reports.select("job_id", F.explode(F.array_compact(F.concat(own, each))).alias("v")).select("job_id", "v.*")
