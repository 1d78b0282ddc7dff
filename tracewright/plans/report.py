"""Queries from detected events to validated reports, and over the writes of the catalogue, with their SQL."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import geometry
from tracewright.operators import catalog, contract, probe, render, report, scoring, steps, targets
from tracewright.operators import events as ev
from tracewright.operators import segmentation as seg
from tracewright.plans.activity import BLANKS, CHAIN, DAMP, EVENTS, FOLD, LEFT, REGION, STILL
from tracewright.plans.segmentation import BASE
from tracewright.plans.texts import BLOCKS, DOMAIN, EARLY, ERROR_WORDS, LABELLED, TIME_INSIDE, label_sql, quality_sql
from tracewright.sources import adapters as a
from tracewright.sources.tables import stored, table

WIDTH, HEIGHT = 1080, 720


# --- relations ----------------------------------------------------------------


class Recordings:
    """Relations of one query, each computed once and stored, since several branches use them."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    def _from(self, relation, label):
        return stored(relation(self.spark, self.sf), label)

    @cached_property
    def blocks(self):
        return self._from(a.blocks, "blocks")

    @cached_property
    def frames(self):
        return a.frames(self.spark, self.sf)

    @cached_property
    def samples(self):
        return self._from(a.samples, "samples")

    @cached_property
    def events(self):
        return self._from(a.event_list, "events")

    @cached_property
    def acts(self):
        return self.events.where("type <> 'scroll'")

    @cached_property
    def jobs(self):
        """Length, size, device and flags of the recording that a user's event stream stands for."""
        b = self.samples.groupBy("job_id").agg(F.max("t_ms").alias("duration_ms"))
        job = F.col("job_id")
        tall = job % 4 == 0
        flags = F.when(job % 5 == 0, F.array(F.lit("blurry"))).when(job % 5 == 1, F.array(F.lit("cursor_invisible"), F.lit("low_fps"))).otherwise(F.array().cast("array<string>"))
        width, height = F.when(tall, 720).otherwise(1280), F.when(tall, 1600).otherwise(720)
        name = F.when(job % 3 == 0, "").otherwise(F.concat(F.lit("take "), job.cast("string"), F.lit(".mp4")))
        return stored(b.select("job_id", "duration_ms", (F.col("duration_ms") / 1000).alias("duration_s"), name.alias("filename"), width.alias("width"), height.alias("height"), probe.device_class(width, height).alias("device_class"), flags.alias("flags")), "jobs")

    @cached_property
    def anomalies(self):
        return ev.anomalies(self.blocks, self.samples, self.acts, STILL)

    @cached_property
    def bugs(self):
        return stored(ev.localized(self.jobs, self.anomalies), "bugs")

    @cached_property
    def steps_and_omitted(self):
        made, omitted = steps.reproduction(self.events, self.frames, self.bugs.where("found").select("job_id", "t_ms"), WIDTH, HEIGHT)
        entries = steps.entry_steps(self.jobs, self.blocks, self.frames)
        return stored(steps.with_entry(made, entries), "steps"), omitted

    @cached_property
    def scored(self):
        """With every third keyframe lost."""
        bugs = self.bugs.select("job_id", F.col("confidence").alias("bug"), F.when(F.col("type") == "error_text", "visible_convention").alias("basis"))
        jobs = self.jobs.join(bugs, "job_id").withColumn("expected_confidence", F.lit(0.5))
        return scoring.scored(self.steps_and_omitted[0], self.frames.where("seq % 3 <> 2"), self.blocks, jobs)

    @cached_property
    def drafts(self):
        made, omitted = self.steps_and_omitted
        env = report.environments(self.jobs, self.blocks, self.samples)
        said = steps.preconditions(self.jobs.select("job_id"), self.blocks, self.frames)
        return report.assembled(self.jobs, self.bugs, made, omitted, said, steps.title_sources(self.blocks), env, self.frames, self.acts)

    @cached_property
    def finished(self):
        return report.finished(self.drafts, *self.scored)


# --- queries --------------------------------------------------------------------


def events_detected(spark, sf):
    """All four detectors in order, clicks on submit buttons promoted."""
    s = a.samples(spark, sf)
    found = ev.detected(seg.segments(s), a.motions(spark, sf), a.cursor(spark, sf), a.blocks(spark, sf), a.frames(spark, sf))
    return found.select("job_id", "seq", "type", "t_start_ms", "t_end_ms", F.coalesce("x", F.lit(-1).cast("long")).alias("x"), F.coalesce("y", F.lit(-1).cast("long")).alias("y"), "target", "confidence", F.array_join("signals", ",").alias("signals"), F.coalesce("button", F.lit("")).alias("button"))


def anomalies_ordered(spark, sf):
    return Recordings(spark, sf).anomalies.select("job_id", "ord", "type", "t_ms", F.round("score", 6).alias("score"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("static_ms", F.lit(0).cast("long")).alias("static_ms"))


def bug_localized(spark, sf):
    shown = F.array_join(report.alternates(F.col("candidates")), "; ")
    return Recordings(spark, sf).bugs.select("job_id", "found", "bug_type", F.coalesce("t_ms", F.lit(-1).cast("long")).alias("t_ms"), "observed", "confidence", F.size("candidates").cast("long").alias("n_candidates"), shown.alias("alternates"))


def report_steps(spark, sf):
    """Numbered steps with their entry step and evidence, up to the bug."""
    made, _ = Recordings(spark, sf).steps_and_omitted
    e = F.col("evidence")[0]
    return made.select("job_id", "idx", "key", "text", "action_type", "grounding", "confidence", "uncertainty_note", e["frame_id"].alias("frame_id"), e["t_start_ms"].alias("t_start_ms"), e["t_end_ms"].alias("t_end_ms"))


def report_headers(spark, sf):
    d = Recordings(spark, sf).drafts
    env = F.col("environment")
    return d.select(
        "job_id",
        "title",
        "summary",
        "bug_type",
        F.array_join("preconditions", "; ").alias("preconditions"),
        F.concat_ws("|", env["browser"], env["device_class"], env["resolution"], env["theme"]).alias("environment"),
        F.element_at("field_confidence", "browser").alias("browser_confidence"),
        F.coalesce("expected.text", F.lit("")).alias("expected"),
        F.array_join("alternates", "; ").alias("alternates"),
        F.array_join("ambiguity", "; ").alias("ambiguity"),
        F.array_join(F.transform("omitted", lambda o: F.concat(o["t_start_ms"].cast("string"), F.lit("-"), o["t_end_ms"].cast("string"), F.lit(" "), o["reason"])), "; ").alias("omitted"),
        F.col("observed.confidence").alias("observed_confidence"),
        F.coalesce(F.get("observed.evidence", F.lit(0))["frame_id"], F.lit("")).alias("frame_id"),
    )


def report_scores(spark, sf):
    _, scores = Recordings(spark, sf).scored
    return scores.select("job_id", "overall", "actions", "ocr", "bug_localization", "expected_result", "coverage", F.size("chronology").cast("long").alias("n_notes"))


def report_validated_steps(spark, sf):
    """Steps after lost frames are dropped from their evidence and confidence is propagated."""
    final, _ = Recordings(spark, sf).scored
    return final.select("job_id", "idx", "grounding", "confidence", "uncertainty_note", F.size("evidence").cast("long").alias("n_evidence"))


def report_export(spark, sf):
    """Assembled, validated reports as JSON of the contract, read back."""
    back = contract.checked(report.exported(Recordings(spark, sf).finished)).where(F.size("broken") == 0)
    r = F.col("report")
    return back.select("job_id", r["title"].alias("title"), r["bug_type"].alias("bug_type"), F.size(r["steps"]).cast("long").alias("n_steps"), r["overall_confidence"].alias("overall"), F.get(r["steps"], F.lit(0))["text"].alias("first_step"), F.size(r["ambiguity_notes"]).cast("long").alias("n_ambiguity"))


def report_read_back(spark, sf):
    """Every field of the contract, from the documents."""
    back = contract.checked(report.exported(Recordings(spark, sf).finished)).select("job_id", "report.*", F.size("broken").cast("long").alias("n_broken"))
    env, pre, parts = F.col("environment"), F.get("preconditions", F.lit(0)), F.col("confidence_breakdown")
    said = lambda c, t: F.array_join(F.transform(c, t), "; ")
    first = F.get("steps", F.lit(0))
    return back.select(
        "job_id",
        "n_broken",
        "schema_version",
        "summary",
        pre["text"].alias("precondition"),
        pre["grounding"].alias("precondition_grounding"),
        F.concat_ws("|", env["browser"], env["device_class"], env["resolution"], env["theme"]).alias("environment"),
        F.element_at(env["field_confidence"], "browser").alias("browser_confidence"),
        first["key"].alias("first_key"),
        first["action_type"].alias("first_action"),
        first["screen_state"].alias("first_state"),
        F.coalesce("expected_result.text", F.lit("")).alias("expected"),
        F.coalesce("expected_result.basis", F.lit("")).alias("basis"),
        F.col("observed_result.confidence").alias("observed_confidence"),
        F.coalesce(F.get("observed_result.evidence", F.lit(0))["frame_id"], F.lit("")).alias("frame_id"),
        F.col("bug_manifestation").isNotNull().alias("manifest"),
        F.array_join("alternate_interpretations", "; ").alias("alternates"),
        said("omitted_activity", lambda o: F.concat(o["t_start_ms"].cast("string"), F.lit("-"), o["t_end_ms"].cast("string"), F.lit(" "), o["reason"])).alias("omitted"),
        parts["actions"].alias("actions"),
        parts["ocr"].alias("ocr"),
        parts["bug_localization"].alias("bug_localization"),
        parts["expected_result"].alias("expected_confidence"),
        parts["coverage"].alias("coverage"),
    )


#: What is put in place of a good document's part, and what the contract says to it.
SPOILT = (
    ("", None, None, None),
    ("title", None, "title", "required"),
    ("title", 7, "title", "not a text"),
    ("summary", None, "summary", "must not be null"),
    ("schema_version", "2.0", "schema_version", "unknown value"),
    ("bug_type", "cosmic", "bug_type", "unknown value"),
    ("overall_confidence", 1.01, "overall_confidence", "outside of 0 to 1"),
    ("overall_confidence", "high", "overall_confidence", "not a number"),
    ("overall_confidence", "0.25", None, None),
    ("preconditions", [{"grounding": "assumed"}], "preconditions[0].text", "required"),
    ("preconditions", [{"text": "Signed in", "grounding": "seen"}], "preconditions[0].grounding", "unknown value"),
    ("preconditions", [{"text": "Signed in", "confidence": 9}], None, None),
    ("preconditions", "none", "preconditions", "not a list"),
    ("environment", None, "environment", "must not be null"),
    ("environment", {"os": 3}, "environment.os", "not a text"),
    ("environment", {"field_confidence": {"os": "sure"}}, "environment.field_confidence.os", "not a number"),
    ("environment", {"extra": 1}, None, None),
    ("steps", {}, "steps", "not a list"),
    ("steps.text", " \t\u00a0", "steps[1].text", "must not be empty"),
    ("steps.text", None, "steps[1].text", "required"),
    ("steps.key", None, "steps[1].key", "required"),
    ("steps.index", 1.5, "steps[1].index", "not a whole number"),
    ("steps.index", "4", None, None),
    ("steps.grounding", "guessed", "steps[1].grounding", "unknown value"),
    ("steps.confidence", -0.1, "steps[1].confidence", "outside of 0 to 1"),
    ("steps.action_type", ["tap"], "steps[1].action_type", "not a text"),
    ("steps.uncertainty_note", None, "steps[1].uncertainty_note", "must not be null"),
    ("steps.evidence", [{"t_start_ms": 1, "t_end_ms": 2}, {"t_start_ms": 3}], "steps[1].evidence[1].t_end_ms", "required"),
    ("steps.evidence", [{"t_start_ms": "soon", "t_end_ms": 2}], "steps[1].evidence[0].t_start_ms", "not a whole number"),
    ("steps.compressed_from", [1], "steps[1].compressed_from", "not an object"),
    ("steps.compressed_from", {"events": [1, 2]}, None, None),
    ("observed_result", None, "observed_result", "required"),
    ("observed_result", {"confidence": 0.5}, "observed_result.text", "required"),
    ("observed_result", {"text": "It stops.", "confidence": 2}, "observed_result.confidence", "outside of 0 to 1"),
    ("observed_result", {"text": "It stops.", "evidence": [{"t_start_ms": 0, "t_end_ms": 1, "frame_id": None}]}, "observed_result.evidence[0].frame_id", "must not be null"),
    ("expected_result", None, None, None),
    ("expected_result", {"text": "It goes on.", "basis": "hope"}, "expected_result.basis", "unknown value"),
    ("expected_result", {"text": "It goes on.", "confidence": 1.2}, "expected_result.confidence", "outside of 0 to 1"),
    ("expected_result", "It goes on.", "expected_result", "not an object"),
    ("bug_manifestation", {"confidence": 0.2}, "bug_manifestation.t_ms", "required"),
    ("bug_manifestation", {"t_ms": 5, "confidence": 3}, None, None),
    ("alternate_interpretations", ["one", 2], "alternate_interpretations[1]", "not a text"),
    ("ambiguity_notes", [None], "ambiguity_notes[0]", "required"),
    ("omitted_activity", [{"t_start_ms": 1, "t_end_ms": 2}], "omitted_activity[0].reason", "required"),
    ("confidence_breakdown", {"ocr": None}, "confidence_breakdown.ocr", "must not be null"),
    ("confidence_breakdown", {"ocr": "x"}, "confidence_breakdown.ocr", "not a number"),
    ("not JSON", None, "", "not JSON"),
)


def spoilt(part, value):
    """A document of two steps with one part replaced."""
    if part == "not JSON":
        return "{"
    step = {"key": "s", "index": 1, "text": "Open it.", "evidence": [{"t_start_ms": 1, "t_end_ms": 2}]}
    doc = {"title": "Crash in shop", "steps": [dict(step), dict(step)], "observed_result": {"text": "It stops."}}
    if part.startswith("steps."):
        doc["steps"][1][part[6:]] = value
    elif part:
        doc[part] = value
    return json.dumps(doc)


def contract_rules(spark, sf):
    """Orders stand for documents, each spoilt in one of the ways above: what the contract finds, and what stays readable."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"))
    bodies = F.array(*[F.lit(spoilt(*s[:2])) for s in SPOILT])
    docs = o.withColumn("body", F.element_at(bodies, (F.col("job_id") % len(SPOILT) + 1).cast("int")))
    done = contract.checked(docs)
    return done.select("job_id", F.explode_outer("broken").alias("v"), F.coalesce("report.title", F.lit("")).alias("title")).select("job_id", F.coalesce("v.path", F.lit("-")).alias("path"), F.coalesce("v.rule", F.lit("-")).alias("rule"), "title")


def assembled_markdown(spark, sf):
    """Validated reports as Markdown: their lines, counted, and the title line."""
    done = Recordings(spark, sf).finished
    lines = F.split(render.markdown(), "\n")
    # Every report has steps, so the title, the counts of steps and of notes stand for all sections.
    return done.select("job_id", F.get(lines, F.lit(0)).alias("title"), F.size(F.filter(lines, lambda x: x.rlike(r"^[0-9]+\. "))).cast("long").alias("n_steps"), F.size(F.filter(lines, lambda x: x.startswith("## "))).cast("long").alias("n_sections"))


def contract_violations(spark, sf):
    """Reports of which some were spoilt."""
    r = a.reports(spark, sf)
    bad = F.col("job_id") % 5
    spoilt = F.transform("steps", lambda s: F.struct(s["index"].alias("index"), F.when((bad == 1) & (s["index"] == 2), F.lit("  ")).otherwise(s["text"]).alias("text"), F.when((bad == 2) & (s["index"] == 1), F.lit(1.5)).otherwise(s["confidence"]).alias("confidence"), F.when((bad == 3) & (s["index"] == 1), F.lit("guessed")).otherwise("inferred").alias("grounding")))
    r = r.withColumn("steps", spoilt).withColumn("bug_type", F.when(bad == 4, "cosmic").otherwise(F.col("bug_type")))
    return report.violations(r)


def submit_promotion(spark, sf):
    """Clicks promoted by the nearest text that looks like a button."""
    c = table(spark, sf, "conversations")
    e = c.select(F.col("conv_id").alias("job_id"), F.concat_ws("-", "conv_id", "turn").alias("event_id"), (F.col("turn") * 1500).cast("long").alias("t_start_ms"), F.lit(300).cast("long").alias("x"), F.lit(330).cast("long").alias("y"), F.lit("click").alias("type"))
    words = F.array(*map(F.lit, ("Save", "Sign in", "Cancel", "next", "Help")))
    b = c.select(F.col("conv_id").alias("job_id"), F.concat_ws("-", "conv_id", "turn").alias("frame_id"), (F.col("turn") * 1500).cast("long").alias("t_ms"), F.col("turn").cast("long").alias("block_no"), F.element_at(words, (F.pmod(F.col("turn") + F.col("conv_id"), F.lit(5)) + 1).cast("int")).alias("text"), (F.lit(240) + F.col("turn") % 3 * 20).cast("long").alias("x"), F.lit(310).cast("long").alias("y"), F.lit(120).cast("long").alias("w"), F.lit(40).cast("long").alias("h"), F.lit(0.9).alias("confidence"), F.when(F.col("turn") % 4 == 3, "body").otherwise("button_like").alias("role"))
    return ev.submits(e, b).select("job_id", "event_id", "type", F.coalesce("button", F.lit("")).alias("button"))


def targets_resolved(spark, sf):
    """Names from keyframes first, else from the lines read in a crop."""
    e = a.event_list(spark, sf).where("type IN ('click', 'form_submit')").withColumn("event_id", F.concat_ws("-", "job_id", "seq"))
    words = F.array(*map(F.lit, ("Open cart", "wll ull", "Checkout now", "Help")))
    lines = e.select("job_id", "event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"), "seq").select("job_id", "event_id", F.col("n").cast("long").alias("line_no"), F.element_at(words, (F.pmod(F.col("seq") + F.col("n"), F.lit(4)) + 1).cast("int")).alias("text"), F.round(0.4 + F.col("n") * 0.2, 2).alias("confidence"), (F.col("n") * 120).cast("long").alias("box_x"), F.lit(90).cast("long").alias("box_y"), F.lit(100).cast("long").alias("box_w"), F.lit(30).cast("long").alias("box_h"))
    got = targets.resolved(e, a.blocks(spark, sf), lines)
    stored = e.select("job_id", "event_id", F.lit("(none)").alias("target_desc"))
    named = targets.updated_actions(stored, got)
    return targets.with_targets(named, got).select("job_id", "event_id", "target", "target_desc")


def probe_validated(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    duration = F.when(n % 7 == 0, "0").when(n % 7 == 1, "N/A").otherwise((F.col("p_size") * 60 + 0.5).cast("string"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), (F.col("p_size") * 30).cast("string").alias("duration"), F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/"), F.when(n % 9 == 0, "0").otherwise("1001")).alias("avg_frame_rate"), (F.col("p_size") * 40).cast("int").alias("width"), ((n % 50) * 40).cast("int").alias("height"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("1").alias("duration"), F.lit("0/0").alias("avg_frame_rate"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    streams = F.when(n % 11 == 0, F.array(audio)).when(n % 2 == 0, F.array(audio, video)).otherwise(F.array(video))
    files = p.select(n.cast("string").alias("path"), F.to_json(F.struct(F.struct(duration.alias("duration"), F.lit("mov,mp4").alias("format_name")).alias("format"), streams.alias("streams"))).alias("probe"))
    packets = p.where(n % 14 == 0).select(n.cast("string").alias("path"), F.lit(12.5).alias("duration_s"))
    got = probe.validated(probe.parsed(files), packets)
    return got.select("path", "container", "codec", F.round("duration_s", 3).alias("duration_s"), F.round("fps", 4).alias("fps"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "device_class", "has_audio", F.coalesce("error", F.lit("")).alias("error"))


def motion_filter(spark, sf):
    s = a.base(spark, sf).select("job_id", "i", ((F.col("k") - 50) / 30).alias("dx"), (F.col("value") / 100).alias("dy"))
    return probe.moving(s)


def uploads_completed(spark, sf):
    c, n = table(spark, sf, "customer"), F.col("c_custkey")
    up = c.select(n.alias("video_id"), F.concat(F.lit("raw/"), n.cast("string")).alias("storage_key"), F.lit("uploading").alias("status"), F.lit(0).cast("long").alias("byte_size"))
    there = c.where(n % 3 != 0).select(F.concat(F.lit("raw/"), n.cast("string")).alias("storage_key"), (n * 1000).alias("length"))
    return catalog.completed(up, there).select("video_id", "code", "status", "byte_size")


def jobs_created(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    states = F.array(*map(F.lit, ("uploading", "uploaded", "processing", "processed", "failed")))
    videos = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("video_id"), F.element_at(states, (F.col("c_custkey") % 5 + 1).cast("int")).alias("status"))
    made = catalog.created_jobs(o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("video_id")), videos)
    ready = catalog.runnable(made.select("request_id", F.coalesce("status", F.lit("failed")).alias("status"))).select("request_id", F.lit(True).alias("runs"))
    return made.join(ready, "request_id", "left").select("request_id", "code", F.coalesce("runs", F.lit(False)).alias("runs"))


def stages_appended(spark, sf):
    o = table(spark, sf, "orders")
    none = "array<struct<stage:string,status:string,ms:bigint>>"
    old = F.array(F.struct(F.lit("s01_validate").alias("stage"), F.lit("done").alias("status"), F.lit(5).cast("long").alias("ms")))
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.lit("running").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, old).otherwise(F.lit(None).cast(none)).alias("stages"))
    done = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job_id"), F.lit("s02_normalize").alias("stage"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("stage_status"), F.floor("o_totalprice").cast("long").alias("ms"))
    shown = F.array_join(F.transform("stages", lambda s: F.concat_ws("/", s["stage"], s["status"], s["ms"].cast("string"))), ",")
    return catalog.with_stage(jobs, done).select("job_id", "status", shown.alias("stages"))


def stages_batched(spark, sf):
    """Several stages of one job at once: its line items, in the order of the stages; one that failed fails the job."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("running").alias("status"), F.lit(None).cast(catalog.ENTRIES).alias("stages"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("ms"))
    done = li.select("job_id", F.format_string("s%02d", "n").alias("stage"), F.when((F.col("flag") == "R") & (F.col("n") > 2), "failed").otherwise("done").alias("stage_status"), "ms")
    shown = F.array_join(F.transform("stages", lambda s: F.concat_ws("/", s["stage"], s["status"], s["ms"].cast("string"))), ",")
    return catalog.with_stage(o, done).select("job_id", "status", shown.alias("stages"))


def edits_answered(spark, sf):
    """A batch of edits with chains, forks, unknown parents and spoilt bodies: line items that edit their order's report one after the other."""
    o = table(spark, sf, "orders").where("o_orderkey % 13 <> 5")
    reports = o.select(F.col("o_orderkey").alias("report_id"), (F.col("o_orderkey") * 100).alias("head_revision_id"), F.lit("draft").alias("status"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    e = li.withColumn("n", place).select(
        F.col("l_orderkey").alias("report_id"),
        (F.col("l_orderkey") * 100 + F.col("n")).alias("revision_id"),
        # Mostly the revision before; every seventh order: one that is two back; every eleventh: one unknown; every ninth: one that comes later.
        F.when((F.col("l_orderkey") % 7 == 0) & (F.col("n") == 3), F.col("l_orderkey") * 100 + 1)
        .when((F.col("l_orderkey") % 11 == 0) & (F.col("n") == 2), F.lit(-1))
        .when((F.col("l_orderkey") % 9 == 0) & (F.col("n") == 1), F.col("l_orderkey") * 100 + 2)
        .otherwise(F.col("l_orderkey") * 100 + F.col("n") - 1)
        .alias("parent_revision_id"),
        F.col("n").alias("created_at"),
        (~((F.col("l_orderkey") % 5 == 0) & (F.col("n") == 2))).alias("valid"),
    )
    return catalog.answered(e, reports).select("report_id", "revision_id", "code")


def roles_allowed(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    names = F.array(*map(F.lit, catalog.ROLES))
    members = c.where("c_custkey % 7 <> 0").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("role"))
    asks = c.select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"), F.element_at(names, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("minimum"))
    return catalog.allowed(asks, members).join(n.select(F.col("n_nationkey").alias("org_id"), "n_name"), "org_id").groupBy("n_name", "code").agg(F.count(F.lit(1)).alias("n"))


def revisions_saved(spark, sf):
    """Edits on the head of their report become revisions, and the head moves."""
    r = a.revisions(spark, sf)
    heads = catalog.heads(r).select("report_id", F.col("revision_id").alias("head_revision_id"), F.lit("draft").alias("status"))
    edits = r.select("report_id", (F.col("revision_id") + 1_000_000_000).alias("revision_id"), F.col("revision_id").alias("parent_revision_id"), F.timestamp_micros(F.col("revision_id")).alias("created_at"), F.lit("").alias("change_note")).where("report_id % 2 = 0")
    new, moved = catalog.saved(edits, heads)
    return moved.join(new.select("report_id", F.col("revision_id").alias("saved"), "author_type"), "report_id", "left").select("report_id", "status", "head_revision_id", F.coalesce("saved", F.lit(0).cast("long")).alias("saved"), F.coalesce("author_type", F.lit("")).alias("author_type"))


def revision_history(spark, sf):
    h = catalog.history(a.revisions(spark, sf))
    return h.select("report_id", F.array_join(F.transform("revisions", lambda r: r["revision_id"].cast("string")), ",").alias("revisions"))


def reports_exported(spark, sf):
    r = catalog.heads(a.revisions(spark, sf)).select("report_id", F.when(F.col("report_id") % 11 != 0, F.col("revision_id")).alias("head_revision_id"), F.lit("in_review").alias("status"))
    r = catalog.approved(r, r.where("report_id % 2 = 0"))
    kinds = F.array(*map(F.lit, (*catalog.FORMATS, "pdf")))
    asks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("report_id"), F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("format"))
    return catalog.exports(asks, r).groupBy("format", "code", F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def comments_listed(spark, sf):
    li = table(spark, sf, "lineitem")
    c = li.select(F.col("l_orderkey").alias("report_id"), F.col("l_shipdate").alias("created_at"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("comment_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("step_key"), F.lit(0).alias("t_ms"), F.col("l_returnflag").alias("body"), (F.col("l_linestatus") == "F").alias("resolved"))
    return catalog.comments(c).select("report_id", F.array_join(F.transform("comments", lambda x: F.concat(x["step_key"], x["body"])), ",").alias("comments"))


def steps_merged(spark, sf):
    """Steps merged with the next one by an edit."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("p"), F.min("l_discount").alias("confidence"))
    s = li.select("job_id", "idx", F.concat(F.lit("Open part "), F.col("p").cast("string"), F.lit(".")).alias("text"), "confidence", F.array(F.col("p")).alias("evidence"))
    got = catalog.edited(s, s.where("p % 2 = 0").select("job_id", "idx"))
    return got.select("job_id", "idx", "new_idx", "text", "confidence", F.array_join(F.transform("evidence", lambda e: e.cast("string")), ",").alias("evidence"))


def timeline_places(spark, sf):
    e = a.event_list(spark, sf).where("type <> 'scroll'")
    jobs = Recordings(spark, sf).jobs.select("job_id", "duration_ms")
    return e.join(jobs, "job_id").select("job_id", "seq", geometry.timeline_percent(F.col("t_start_ms"), F.nullif("duration_ms", F.lit(0))).alias("percent"), geometry.confidence_class(F.col("confidence")).alias("shade"))


def ticket_payload(spark, sf):
    """Fields of a work item, by name, with their lengths; organisation and project quoted for its address."""
    r = a.reports(spark, sf)
    fields = render.ticket_fields(F.when(F.col("job_id") % 2 == 0, "Web\\Shop"), F.when(F.col("job_id") % 3 == 0, ""))
    each = r.select("job_id", F.explode(fields).alias("f"))
    return each.groupBy(F.col("f.path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("f.path") != "/fields/Microsoft.VSTS.TCM.ReproSteps", F.length("f.value")).otherwise(0)).alias("chars"))


def urls_quoted(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", geometry.url_quoted(F.concat(F.col("p_name"), F.lit(" (100%) é/~x_*+"), F.col("p_brand"))).alias("quoted"))


QUERIES = {
    f.__name__: f
    for f in (
        events_detected, anomalies_ordered, bug_localized, report_steps, report_headers, report_scores, report_validated_steps, report_export, report_read_back, contract_rules, assembled_markdown,
        contract_violations, submit_promotion, targets_resolved, probe_validated, motion_filter, uploads_completed, jobs_created, stages_appended, stages_batched, edits_answered, roles_allowed,
        revisions_saved, revision_history, reports_exported, comments_listed, steps_merged, timeline_places, ticket_payload, urls_quoted,
    )
}

# --- SQL ------------------------------------------------------------------------

JOBS = """, jb AS (
  SELECT job_id, max(t_ms) AS duration_ms, CASE WHEN job_id % 3 = 0 THEN '' ELSE 'take ' || job_id || '.mp4' END AS filename, job_id % 4 = 0 AS tall,
         CASE WHEN job_id % 4 = 0 THEN 'mobile' ELSE 'desktop' END AS device_class, job_id % 5 AS f FROM base GROUP BY job_id
)"""
CAPS = r"regexp_matches(regexp_replace(tok, '[^\p{L}]', '', 'g'), '^(\p{Ll}*|\p{Lu}+|\p{Lu}\p{Ll}*)$')"
#: Everything that recognised text says about anomalies: after BLOCKS and BASE.
ANOMALIES = (
    EVENTS
    + BLANKS
    + ", "
    + BLOCKS
    + f""", errs AS (SELECT job_id, t_ms, least(0.85::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * confidence) AS score, left(c, 300) AS text, block_no AS ord FROM br
    WHERE confidence >= 0.45 AND quality >= 0.5 AND regexp_matches(lower(c), '(^|[^\\p{{L}}\\p{{N}}_])({ERROR_WORDS})([^\\p{{L}}\\p{{N}}_]|$)')
), la AS (SELECT job_id, max(t_end_ms) AS last_ms FROM el WHERE type <> 'scroll' GROUP BY 1
), tail AS (SELECT s.job_id, bool_and(score < 0.6) AS still, min(t_ms) AS t_ms, max(t_ms) - min(t_ms) AS static_ms FROM samples s JOIN la USING (job_id) WHERE t_ms > last_ms GROUP BY 1
), an_all AS (
  SELECT job_id, 'error_text' AS type, t_ms, round(score, 6) AS score, text, NULL::BIGINT AS static_ms, 0 AS r, ord FROM errs
  UNION ALL SELECT job_id, 'blank_screen', t_ms, 0.7::DOUBLE, NULL, NULL, 1, ord FROM blanks
  UNION ALL SELECT job_id, 'stall', t_ms, 0.5::DOUBLE, NULL, static_ms, 2, 0 FROM tail WHERE still AND static_ms > 2000
), an AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t_ms, r, ord) - 1 AS no FROM an_all)"""
)
BUGS = (
    ANOMALIES
    + JOBS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, t_ms DESC, no) AS place FROM an
), cands AS (SELECT job_id, count(*) FILTER (place BETWEEN 2 AND 6) AS n, coalesce(string_agg('Alternative failure point at ' || printf('%.1f', t_ms / 1000.0) || 's (' || type || ')', '; ' ORDER BY place) FILTER (place BETWEEN 2 AND 4), '') AS alternates FROM ranked GROUP BY 1
), bug AS (SELECT jb.job_id, r.job_id IS NOT NULL AS found, CASE r.type WHEN 'error_text' THEN 'functional' WHEN 'blank_screen' THEN 'crash' WHEN 'stall' THEN 'performance' ELSE 'unknown' END AS bug_type, r.t_ms, r.type,
    CASE r.type WHEN 'error_text' THEN 'The UI displays the error text: "' || r.text || '"' WHEN 'blank_screen' THEN 'The screen goes blank (near-black frame), suggesting a crash or render failure.'
      WHEN 'stall' THEN 'The screen remains completely unchanged for ' || printf('%.1f', r.static_ms / 1000.0) || 's after the last user action, suggesting a freeze or unresponsive state.'
      ELSE 'No clear bug manifestation was detected automatically. Review the timeline and mark the failure point manually.' END AS observed,
    coalesce(round(r.score, 2), 0.0)::DOUBLE AS confidence, coalesce(c.n, 0) AS n_candidates, coalesce(c.alternates, '') AS alternates
  FROM jb LEFT JOIN ranked r ON r.job_id = jb.job_id AND r.place = 1 LEFT JOIN cands c ON c.job_id = jb.job_id)"""
)
FRAMES = ", fr AS (SELECT conv_id AS job_id, conv_id || '-' || turn AS frame_id, turn * 1500 AS t_ms, turn AS seq, turn // 2 AS segment_idx FROM conversations)"
WEIGHTED = label_sql("bl", "lb", 80) + ", lt AS (SELECT key, label AS text FROM lb)" + quality_sql("lt", "lq") + ", wl AS (SELECT br.*, lb.label, round(lq.quality * least(length(lb.label), 8) / 8, 9) AS weight FROM br JOIN lb ON lb.key = br.key JOIN lq ON lq.key = br.key WHERE lb.label <> '')"
#: Steps of every recording (rs): the chain over events up to the bug, the entry step before them.
STEPS = (
    BUGS.replace("), el AS (", "), el_all AS (", 1).replace("FROM el WHERE type <> 'scroll' GROUP BY 1", "FROM el_all WHERE type <> 'scroll' GROUP BY 1")
    + FRAMES
    + ", cut AS (SELECT e.*, coalesce(e.t_start_ms > b.t_ms + 1500, false) AS late FROM el_all e JOIN bug b USING (job_id)), el AS (SELECT * EXCLUDE (late) FROM cut WHERE NOT late)"
    + CHAIN
    + f""", st AS (SELECT mr.*, fm.n AS merged, x / 1080.0 AS fx, y / 720.0 AS fy FROM mr JOIN (SELECT job_id, seq, n FROM mu) fm ON fm.job_id = mr.job_id AND fm.seq = mr.seq
), sf AS (SELECT st.job_id, st.seq, arg_min(fr.frame_id, (abs(fr.t_ms - st.t_start_ms), fr.seq)) AS frame_id FROM st JOIN fr ON fr.job_id = st.job_id GROUP BY 1, 2
), said AS (SELECT st.job_id, st.t_start_ms, st.t_end_ms, st.seq, type AS action_type, c_max AS confidence,
        CASE WHEN type IN ('click', 'form_submit') THEN CASE
               WHEN target <> '' AND n > 1 THEN 'Click "' || target || '" (' || n || ' times).'
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
        CASE WHEN c_max >= 0.8 THEN 'observed' ELSE 'inferred' END AS grounding, coalesce(sf.frame_id, '') AS frame_id
      FROM st LEFT JOIN sf ON sf.job_id = st.job_id AND sf.seq = st.seq
)"""
    + WEIGHTED
    + EARLY
    + f""", cand AS (SELECT wl.*, regexp_matches(string_split(label, '/')[1], '{DOMAIN}') AS addr FROM wl JOIN early USING (job_id, frame_id) WHERE confidence > 0.45 AND weight > 0
), pick AS (SELECT job_id, arg_max(label, (weight, -block_no)) FILTER (addr) AS domain, arg_max(label, (weight, -block_no)) FILTER (NOT addr AND role = 'title_bar') AS title FROM cand GROUP BY job_id
), f0 AS (SELECT job_id, arg_min(frame_id, t_ms) AS frame_id, min(t_ms) AS t_ms FROM fr GROUP BY 1
), entry AS (SELECT jb.job_id, CASE WHEN domain IS NOT NULL THEN 'Open "' || domain || '" in the browser.' WHEN title IS NOT NULL THEN 'Open the "' || title || '" app.'
      ELSE 'Open the ' || CASE WHEN device_class = 'mobile' THEN 'app' ELSE 'application' END || ' shown at the start of the recording.' END AS text,
    CASE WHEN domain IS NOT NULL OR title IS NOT NULL THEN 'observed' ELSE 'assumed' END AS grounding, (CASE WHEN domain IS NOT NULL THEN 0.85 WHEN title IS NOT NULL THEN 0.7 ELSE 0.5 END)::DOUBLE AS confidence,
    CASE WHEN domain IS NOT NULL OR title IS NOT NULL THEN '' ELSE 'the app name and URL were not readable on the first screen' END AS uncertainty_note, coalesce(f0.frame_id, '') AS frame_id, coalesce(f0.t_ms, 0) AS t_end_ms
  FROM jb LEFT JOIN pick USING (job_id) LEFT JOIN f0 USING (job_id)
), both_ AS (
  SELECT job_id, -1 AS t0, -1 AS seq, text, 'navigate' AS action_type, grounding, confidence, uncertainty_note, frame_id, 0::BIGINT AS t_start_ms, t_end_ms FROM entry
  UNION ALL SELECT job_id, t_start_ms, seq, text, action_type, grounding, confidence, uncertainty_note, frame_id, t_start_ms, t_end_ms FROM said
), rs AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t0, seq) AS idx FROM both_)"""
)
SCORES = (
    STEPS
    + f""", kf AS (SELECT frame_id, job_id FROM fr WHERE seq % 3 <> 2
), gr AS (SELECT rs.*, rs.frame_id = '' OR EXISTS (SELECT 1 FROM kf WHERE kf.job_id = rs.job_id AND kf.frame_id = rs.frame_id) AS kept FROM rs
), ocr AS (SELECT job_id, round(avg(confidence), 9) AS ocr FROM br GROUP BY 1
), prior AS (SELECT job_id, (CASE f WHEN 0 THEN 0.85 WHEN 1 THEN round(0.9::DOUBLE * 0.9::DOUBLE, 6) ELSE 1.0 END)::DOUBLE AS p FROM jb
), raw AS (SELECT gr.*, round(greatest(0.0, least(1.0, (0.5::DOUBLE * gr.confidence + 0.3::DOUBLE * CASE WHEN kept THEN coalesce(ocr, 0.0) ELSE 0.4 END::DOUBLE + (0.2::DOUBLE * 0.75::DOUBLE)) * p)), 3) AS c FROM gr JOIN prior USING (job_id) LEFT JOIN ocr USING (job_id)
), fold AS (SELECT job_id, {DAMP} AS cs FROM (SELECT job_id, idx, c AS confidence FROM raw) GROUP BY job_id
), fin AS (SELECT raw.job_id, raw.idx, CASE WHEN kept THEN grounding ELSE 'assumed' END AS grounding, fold.cs[raw.idx] AS confidence,
    CASE WHEN NOT kept AND uncertainty_note = '' THEN 'no direct frame evidence for this step' ELSE uncertainty_note END AS note, kept, t_start_ms, t_end_ms FROM raw JOIN fold ON fold.job_id = raw.job_id
), vs AS (SELECT *, CASE WHEN uncertainty_note = '' AND confidence < 0.6 THEN 'low-confidence inference; verify during review' ELSE uncertainty_note END AS shown FROM (SELECT * EXCLUDE (note), note AS uncertainty_note FROM fin)
), ends AS (SELECT job_id, median(confidence) AS mid, round(avg(confidence), 3) AS actions, max(idx) AS n FROM fin GROUP BY 1
), span AS (SELECT ends.job_id, CASE WHEN a.kept AND b.kept THEN b.t_end_ms - a.t_start_ms ELSE 0 END AS span FROM ends JOIN fin a ON a.job_id = ends.job_id AND a.idx = 1 JOIN fin b ON b.job_id = ends.job_id AND b.idx = ends.n
), chr AS (SELECT job_id, count(*) AS n FROM (SELECT job_id, idx, t_start_ms, coalesce(max(t_start_ms) OVER (PARTITION BY job_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM fin WHERE kept) WHERE t_start_ms < before - 1500 GROUP BY 1
), sc AS (SELECT jb.job_id, ends.mid, ends.actions, round(coalesce(ocr, 0.0), 3) AS ocr, round(bug.confidence, 3) AS bug_localization, CASE WHEN bug.type = 'error_text' THEN 0.5 ELSE 0.0 END::DOUBLE AS expected_result,
    CASE WHEN duration_ms <= 0 THEN 0.0 ELSE round(least(1.0, span.span / duration_ms::DOUBLE), 3) END::DOUBLE AS coverage, CASE WHEN bug.type = 'error_text' THEN 0.7 ELSE 0.5 END::DOUBLE AS basis, coalesce(chr.n, 0) AS n_notes
  FROM jb JOIN ends USING (job_id) JOIN span USING (job_id) JOIN bug USING (job_id) LEFT JOIN ocr USING (job_id) LEFT JOIN chr USING (job_id)
), scores AS (SELECT *, round(greatest(0.0, least(1.0, 0.35::DOUBLE * mid + 0.25::DOUBLE * bug_localization + 0.2::DOUBLE * coverage + 0.2::DOUBLE * basis)), 3) AS overall FROM sc)"""
)
#: Titles, summaries and notes (hd) beside bugs; the title takes labels of up to 60 characters.
HEADERS = (
    label_sql("bl", "l60")
    + ", lt60 AS (SELECT key, label AS text FROM l60)"
    + quality_sql("lt60", "q60")
    + label_sql("bl", "l150", 150)
    + """, w60 AS (SELECT br.job_id, br.block_no, l60.label, round(q60.quality * least(length(l60.label), 8) / 8, 9) AS weight FROM br JOIN l60 ON l60.key = br.key JOIN q60 ON q60.key = br.key WHERE l60.label <> '' AND role IN ('title_bar', 'url_bar') AND confidence > 0.5
), src AS (SELECT job_id, arg_max(label, (weight, -block_no)) AS source FROM w60 WHERE weight > 0 GROUP BY 1
), pre AS (SELECT br.job_id, arg_min(l150.label, br.block_no) AS label FROM br JOIN early USING (job_id, frame_id) JOIN l150 ON l150.key = br.key AND l150.label <> '' WHERE br.role IN ('url_bar', 'title_bar') AND br.confidence > 0.4 GROUP BY 1
), bars AS (SELECT job_id, bool_or(role = 'url_bar') AS bar FROM br GROUP BY 1
), th AS (SELECT job_id, CASE WHEN list_sort(list(lum))[count(*) // 2 + 1] < 90 THEN 'dark' ELSE 'light' END AS theme FROM samples GROUP BY 1
), act_jobs AS (SELECT DISTINCT job_id FROM el_all WHERE type <> 'scroll'
), om AS (SELECT job_id, min(t_start_ms) AS a, arg_max(t_end_ms, (t_start_ms, seq)) AS b, count(*) AS n FROM cut WHERE late GROUP BY 1
), bf AS (SELECT bug.job_id, arg_min(fr.frame_id, (abs(fr.t_ms - bug.t_ms), fr.seq)) AS frame_id FROM bug JOIN fr ON fr.job_id = bug.job_id WHERE found GROUP BY 1
), hd AS (SELECT jb.job_id,
    left(upper(left(CASE WHEN found THEN bug_type ELSE 'issue' END, 1)) || substr(CASE WHEN found THEN bug_type ELSE 'issue' END, 2) || CASE WHEN coalesce(source, '') <> '' THEN ' in ' || source ELSE ' reproduced from recording ' || CASE WHEN filename = '' THEN left(jb.job_id::VARCHAR, 8) ELSE filename END END, 200) AS title,
    'Reproduction extracted from a ' || printf('%.0f', duration_ms / 1000.0) || 's ' || device_class || ' recording. ' || CASE WHEN found THEN 'Bug manifestation detected automatically.' ELSE 'No bug manifestation auto-detected.' END AS summary,
    bug_type, CASE WHEN pre.label IS NULL THEN 'Start on the screen visible at the beginning of the recording; prior setup steps are unknown.' ELSE 'Start on "' || pre.label || '" (visible when the recording begins; any prior setup is unknown).' END AS preconditions,
    concat_ws('|', CASE WHEN coalesce(bar, false) THEN 'browser (URL bar visible)' ELSE '' END, device_class, CASE WHEN tall THEN '720x1600' ELSE '1280x720' END, theme) AS environment,
    CASE WHEN coalesce(bar, false) THEN 0.7 ELSE 0.0 END::DOUBLE AS browser_confidence,
    CASE WHEN bug.type = 'error_text' THEN 'The action completes without the error shown, or the UI explains clearly which input must change.' ELSE '' END AS expected, bug.alternates,
    array_to_string(list_filter([CASE WHEN aj.job_id IS NULL THEN 'No user actions could be detected; the recording may be static, heavily degraded, or show only the failure state.' END,
      CASE WHEN f = 1 THEN 'No cursor or touch indicator was visible; click positions are inferred from screen transitions.' END, CASE WHEN f = 0 THEN 'The recording is blurry; extracted text may be incomplete.' END,
      CASE WHEN NOT found THEN 'The bug manifestation point was not detected automatically and must be marked during review.' END], lambda x: x IS NOT NULL), '; ') AS ambiguity,
    (aj.job_id IS NULL)::INT + (f = 1)::INT + (f = 0)::INT + (NOT found)::INT AS n_ambiguity, found, coalesce(bar, false) AS bar, om.n IS NOT NULL AS late,
    coalesce(om.a || '-' || om.b || ' ' || om.n || ' action(s) after the bug manifestation are not needed to reproduce', '') AS omitted, CASE WHEN found THEN bug.confidence ELSE 0.2 END::DOUBLE AS observed_confidence, coalesce(bf.frame_id, '') AS frame_id
  FROM jb JOIN bug USING (job_id) LEFT JOIN src USING (job_id) LEFT JOIN pre USING (job_id) LEFT JOIN bars USING (job_id) LEFT JOIN th USING (job_id) LEFT JOIN act_jobs aj USING (job_id) LEFT JOIN om USING (job_id) LEFT JOIN bf USING (job_id))"""
)
DETECTED = (
    LEFT
    + ", "
    + LABELLED
    + FRAMES
    + label_sql("bl", "l80", 80)
    + """, sc_w AS (SELECT job_id, t_ms, seq, dy, CASE WHEN t_ms - lag(t_ms) OVER w > 600 OR (dy > 0) <> (lag(dy) OVER w > 0) OR lag(t_ms) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM motions WHERE abs(dy) >= 3 WINDOW w AS (PARTITION BY job_id ORDER BY t_ms, seq)
), sc_g AS (SELECT *, sum(f) OVER (PARTITION BY job_id ORDER BY t_ms, seq) AS isl FROM sc_w
), cl_f AS (SELECT job_id, """
    + FOLD.format(rec="{'t': t_start_ms, 'l': led_to_segment, 'e': t_end_ms, 'x': x, 'y': y, 'c': confidence}", order="t_start_ms, led_to_segment", step="CASE WHEN x[1].t - acc[len(acc)].t >= 800 THEN list_concat(acc, x) WHEN x[1].c > acc[len(acc)].c THEN list_concat(acc[:-2], x) ELSE acc END")
    + f""" AS kept FROM clicks GROUP BY job_id
), caps AS (SELECT key, bool_and({CAPS}) AS regular FROM bq_k GROUP BY key
), fp AS (SELECT job_id, frame_id AS a, t_ms AS a_ms, segment_idx AS s, lead(frame_id) OVER w AS b, lead(t_ms) OVER w AS b_ms, lead(segment_idx) OVER w AS s2 FROM fr WINDOW w AS (PARTITION BY job_id ORDER BY t_ms, seq)
), ty AS (SELECT fp.job_id, fp.a_ms, fp.b_ms, c.block_no, c.x + c.w // 2 AS x, c.y + c.h // 2 AS y FROM fp JOIN br p ON p.frame_id = fp.a JOIN br c ON c.frame_id = fp.b LEFT JOIN caps ON caps.key = c.key
  WHERE fp.s = fp.s2 AND c.confidence >= 0.5 AND c.role <> 'status_bar' AND length(c.c) - length(p.c) >= 3 AND (p.c = '' OR length(p.c) >= 2) AND starts_with(lower(c.c), lower(left(p.c, 3)))
    AND greatest(0, least(p.x + p.w, c.x + c.w) - greatest(p.x, c.x)) * greatest(0, least(p.y + p.h, c.y + c.h) - greatest(p.y, c.y)) >= 0.3 * (p.w * p.h + c.w * c.h - greatest(0, least(p.x + p.w, c.x + c.w) - greatest(p.x, c.x)) * greatest(0, least(p.y + p.h, c.y + c.h) - greatest(p.y, c.y)))
    AND length(c.c) >= 3 AND NOT regexp_matches(c.c, '{TIME_INSIDE}') AND ((length(regexp_replace(c.c, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(c.c, '[^\\p{{L}}]', '', 'g')) = 0 AND length(c.c) <= 20) OR (length(regexp_replace(c.c, '[^\\p{{L}}]', '', 'g')) >= 3 AND coalesce(caps.regular, true) AND c.quality >= 0.65))
), ff AS (SELECT job_id, segment_idx AS idx, arg_min(frame_id, (t_ms, seq)) AS frame_id FROM fr GROUP BY 1, 2
), tg AS (SELECT ff.job_id, ff.idx, arg_min(l80.label, br.block_no) AS target FROM ff JOIN br ON br.frame_id = ff.frame_id AND br.role IN ('url_bar', 'title_bar') AND br.confidence > 0.45 JOIN l80 ON l80.key = br.key AND l80.label <> '' GROUP BY 1, 2
), found AS (
  SELECT job_id, 'scroll' AS type, min(t_ms) AS t_start_ms, max(t_ms) AS t_end_ms, NULL::BIGINT AS x, NULL::BIGINT AS y, '' AS target, 0.92::DOUBLE AS confidence, 'global_motion' AS signals, 0 AS r, 0::BIGINT AS o FROM sc_g GROUP BY job_id, isl
  UNION ALL SELECT job_id, 'click', u.b.t, u.b.e, u.b.x, u.b.y, '', u.b.c, CASE WHEN u.b.x IS NULL THEN 'transition_only' ELSE 'cursor_dwell,transition' END, 1, u.b.l FROM cl_f, unnest(kept) AS u(b)
  UNION ALL SELECT job_id, 'type', a_ms, b_ms, x, y, '', 0.85, 'ocr_text_growth', 2, block_no FROM ty
  UNION ALL SELECT s.job_id, CASE WHEN transition_type = 'nav' THEN 'navigate' ELSE 'dialog_open' END, start_ms, start_ms + 300, NULL, NULL, CASE WHEN transition_type = 'nav' THEN coalesce(tg.target, '') ELSE '' END,
    CASE WHEN transition_type = 'nav' THEN 0.8 ELSE 0.7 END, CASE WHEN transition_type = 'nav' THEN 'segment_transition' ELSE 'localized_overlay' END, 3, s.idx FROM segs s LEFT JOIN tg ON tg.job_id = s.job_id AND tg.idx = s.idx WHERE s.idx > 0 AND transition_type IN ('nav', 'dialog')
), num AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t_start_ms, r, o, t_end_ms) - 1 AS seq FROM found
), nl AS (SELECT num.job_id, num.seq, lb.label, br.block_no, round((1 - sqrt(pow(num.x - (br.x + br.w / 2), 2) + pow(num.y - (br.y + br.h / 2), 2)) / 151) + 0.3::DOUBLE + 0.15::DOUBLE * lq.quality - CASE WHEN length(lb.label) > 40 THEN 0.1 ELSE 0.0 END::DOUBLE, 9) AS score
    FROM num JOIN br ON br.job_id = num.job_id AND abs(br.t_ms - num.t_start_ms) <= 3000 AND br.role = 'button_like' AND br.confidence >= 0.45 JOIN lb ON lb.key = br.key AND lb.label <> '' JOIN lq ON lq.key = br.key
    WHERE num.type = 'click' AND num.x IS NOT NULL AND sqrt(pow(num.x - (br.x + br.w / 2), 2) + pow(num.y - (br.y + br.h / 2), 2)) <= 150
), btn AS (SELECT job_id, seq, arg_max(label, (score, -block_no)) AS label FROM nl WHERE score > 0 GROUP BY 1, 2)"""
)
SUBMITS = "'submit', 'save', 'apply', 'continue', 'confirm', 'ok', 'sign in', 'log in', 'login', 'register', 'send', 'next', 'checkout', 'pay', 'add', 'create', 'update', 'delete'"
REV = """n AS (SELECT l_orderkey AS report_id, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS revision_id, l_shipdate AS created_at FROM lineitem
), h AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY created_at DESC, revision_id DESC) = 1)"""
ROLE_LIST = "['viewer', 'reviewer', 'editor', 'admin', 'owner']"

ORACLE_SQL = {
    "events_detected": f"""WITH {DETECTED}, pr AS (SELECT num.*, coalesce(lower(btn.label) IN ({SUBMITS}), false) AS sends, btn.label FROM num LEFT JOIN btn ON btn.job_id = num.job_id AND btn.seq = num.seq)
      SELECT job_id, seq, CASE WHEN sends THEN 'form_submit' ELSE type END AS type, t_start_ms, t_end_ms, coalesce(x, -1)::BIGINT AS x, coalesce(y, -1)::BIGINT AS y, target, confidence::DOUBLE AS confidence, signals, CASE WHEN sends THEN label ELSE '' END AS button FROM pr""",
    "anomalies_ordered": f"WITH {ANOMALIES} SELECT job_id, no AS ord, type, t_ms, score::DOUBLE AS score, coalesce(text, '') AS text, coalesce(static_ms, 0)::BIGINT AS static_ms FROM an",
    "bug_localized": f"WITH {BUGS} SELECT job_id, found, bug_type, coalesce(t_ms, -1)::BIGINT AS t_ms, observed, confidence, n_candidates::BIGINT AS n_candidates, alternates FROM bug",
    "report_steps": f"WITH {STEPS} SELECT job_id, idx, 's' || idx AS key, text, action_type, grounding, confidence::DOUBLE AS confidence, uncertainty_note, frame_id, t_start_ms::BIGINT AS t_start_ms, t_end_ms::BIGINT AS t_end_ms FROM rs",
    "report_headers": f"WITH {STEPS} {HEADERS} SELECT job_id, title, summary, bug_type, preconditions, environment, browser_confidence, expected, alternates, ambiguity, omitted, observed_confidence, frame_id FROM hd",
    "report_scores": f"WITH {SCORES} SELECT job_id, overall, actions, ocr, bug_localization, expected_result, coverage, n_notes::BIGINT AS n_notes FROM scores",
    "report_validated_steps": f"WITH {SCORES} SELECT job_id, idx, grounding, confidence, shown AS uncertainty_note, kept::BIGINT AS n_evidence FROM vs",
    "report_export": f"""WITH {SCORES} {HEADERS} SELECT hd.job_id, title, bug_type, ends.n::BIGINT AS n_steps, overall, rs.text AS first_step, (n_ambiguity + n_notes)::BIGINT AS n_ambiguity
      FROM hd JOIN scores USING (job_id) JOIN ends USING (job_id) JOIN rs ON rs.job_id = hd.job_id AND rs.idx = 1""",
    "report_read_back": f"""WITH {SCORES} {HEADERS} SELECT hd.job_id, 0::BIGINT AS n_broken, '1.0' AS schema_version, summary, preconditions AS precondition, CASE WHEN preconditions LIKE 'Start on "%' THEN 'observed' ELSE 'assumed' END AS precondition_grounding,
      environment, browser_confidence, 's1' AS first_key, rs.action_type AS first_action, '' AS first_state, expected, CASE WHEN expected <> '' THEN 'visible_convention' ELSE '' END AS basis, observed_confidence, hd.frame_id, bug.found AS manifest, hd.alternates, omitted,
      actions, ocr, bug_localization, expected_result AS expected_confidence, scores.coverage
      FROM hd JOIN scores USING (job_id) JOIN bug ON bug.job_id = hd.job_id JOIN rs ON rs.job_id = hd.job_id AND rs.idx = 1""",
    "contract_rules": "WITH w(k, path, rule) AS (VALUES "
    + ", ".join(f"({k}, '{path if path is not None else '-'}', '{rule or '-'}')" for k, (_, _, path, rule) in enumerate(SPOILT))
    + f") SELECT o_orderkey AS job_id, path, rule, CASE WHEN rule = '-' THEN 'Crash in shop' ELSE '' END AS title FROM orders JOIN w ON k = o_orderkey % {len(SPOILT)}",
    "assembled_markdown": f"""WITH {SCORES} {HEADERS} SELECT hd.job_id, '# ' || title AS title, ends.n::BIGINT AS n_steps, (5 + found::INT + (n_ambiguity + n_notes > 0)::INT + late::INT)::BIGINT AS n_sections
      FROM hd JOIN scores USING (job_id) JOIN ends USING (job_id)""",
    "contract_violations": """WITH s AS (SELECT l_orderkey AS job_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
      SELECT job_id, 'steps[' || (n - 1) || '].text' AS path, 'must not be empty' AS rule FROM s WHERE job_id % 5 = 1 AND n = 2
      UNION ALL SELECT job_id, 'steps[' || (n - 1) || '].confidence', 'outside of 0 to 1' FROM s WHERE job_id % 5 = 2 AND n = 1
      UNION ALL SELECT job_id, 'steps[' || (n - 1) || '].grounding', 'unknown value' FROM s WHERE job_id % 5 = 3 AND n = 1
      UNION ALL SELECT DISTINCT job_id, 'bug_type', 'unknown value' FROM s WHERE job_id % 5 = 4""",
    "submit_promotion": f"""WITH c AS (SELECT conv_id AS job_id, conv_id || '-' || turn AS event_id, turn FROM conversations
      ), b AS (SELECT conv_id AS job_id, turn, ['Save', 'Sign in', 'Cancel', 'next', 'Help'][(turn + conv_id) % 5 + 1] AS label, abs(turn % 3 * 20) AS d FROM conversations WHERE turn % 4 <> 3
      ), m AS (SELECT c.job_id, c.event_id, b.label, b.turn AS block_no, round((1 - b.d / 151.0::DOUBLE) + 0.3::DOUBLE + 0.15::DOUBLE * 1.0::DOUBLE, 9) AS score FROM c JOIN b ON b.job_id = c.job_id AND abs(b.turn - c.turn) <= 2
      ), p AS (SELECT job_id, event_id, arg_max(label, (score, -block_no)) AS label FROM m GROUP BY 1, 2)
      SELECT c.job_id, c.event_id, CASE WHEN lower(p.label) IN ({SUBMITS}) THEN 'form_submit' ELSE 'click' END AS type, CASE WHEN lower(p.label) IN ({SUBMITS}) THEN p.label ELSE '' END AS button FROM c LEFT JOIN p USING (job_id, event_id)""",
    "targets_resolved": f"""WITH {EVENTS}, {LABELLED}, ce AS (SELECT job_id, job_id || '-' || seq AS event_id, seq, t_start_ms AS t, x, y FROM el WHERE type IN ('click', 'form_submit')
      ), m AS (SELECT ce.job_id, ce.event_id, br.block_no, br.role, lb.label, lq.quality, sqrt(pow(ce.x - (br.x + br.w / 2), 2) + pow(ce.y - (br.y + br.h / 2), 2)) AS d
        FROM ce JOIN br ON br.job_id = ce.job_id AND abs(br.t_ms - ce.t) <= 3000 AND br.role IN ('button_like', 'body') AND br.confidence >= 0.45 JOIN lb ON lb.key = br.key AND lb.label <> '' JOIN lq ON lq.key = br.key WHERE ce.x IS NOT NULL
      ), s AS (SELECT *, round((1 - d / 151) + CASE WHEN role = 'button_like' THEN 0.3 ELSE 0.0 END::DOUBLE + 0.15::DOUBLE * quality - CASE WHEN length(label) > 40 THEN 0.1 ELSE 0.0 END::DOUBLE, 9) AS score FROM m WHERE d <= 150
      ), near AS (SELECT job_id, event_id, arg_max(label, (score, -block_no)) AS label FROM s WHERE score > 0 GROUP BY 1, 2
      ), ln AS (SELECT ce.*, n, ['Open cart', 'wll ull', 'Checkout now', 'Help'][(seq + n) % 4 + 1] AS text FROM ce, (VALUES (1), (2)) AS v(n) WHERE x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM near WHERE near.job_id = ce.job_id AND near.event_id = ce.event_id)
      ), lr AS (SELECT *, round(1 - least(sqrt(pow(x - greatest(0, least(x - 230, 620)) - (n * 120 + 50), 2) + pow(y - greatest(0, least(y - 110, 500)) - 105, 2)), 300) / 301 + 0.3::DOUBLE * 1.0::DOUBLE, 9) AS score FROM ln WHERE text <> 'wll ull'
      ), cr AS (SELECT job_id, event_id, arg_max(text, (score, -n)) AS label FROM lr GROUP BY 1, 2
      ), t AS (SELECT * FROM near UNION ALL SELECT * FROM cr)
      SELECT ce.job_id, ce.event_id, coalesce(t.label, '') AS target, coalesce(t.label, '(none)') AS target_desc FROM ce LEFT JOIN t USING (job_id, event_id)""",
    "probe_validated": """WITH p AS (SELECT p_partkey AS n, p_size AS s, p_partkey % 11 = 0 AS mute FROM part
      ), d AS (SELECT *, CASE WHEN n % 7 IN (0, 1) THEN CASE WHEN mute THEN 0 ELSE s * 30 END ELSE s * 60 + 0.5 END::DOUBLE AS own FROM p
      ), e AS (SELECT *, CASE WHEN own <= 0.5 THEN CASE WHEN n % 14 = 0 THEN 12.5 ELSE 0 END ELSE own END::DOUBLE AS duration_s FROM d)
      SELECT n::VARCHAR AS path, 'mov,mp4' AS container, CASE WHEN mute THEN '' ELSE 'h264' END AS codec, round(duration_s, 3) AS duration_s, CASE WHEN mute OR n % 9 = 0 THEN 0.0 ELSE round(s * 1000 / 1001.0::DOUBLE, 4) END AS fps,
        (CASE WHEN mute THEN 0 ELSE s * 40 END)::BIGINT AS width, (CASE WHEN mute THEN 0 ELSE n % 50 * 40 END)::BIGINT AS height, CASE WHEN NOT mute AND n % 50 * 40 > 1.2 * s * 40 THEN 'mobile' ELSE 'desktop' END AS device_class, mute OR n % 2 = 0 AS has_audio,
        CASE WHEN mute THEN 'file contains no video stream' WHEN duration_s <= 0.5 THEN 'video is empty or unreadably short' WHEN duration_s > 2700 THEN 'video is ' || printf('%.0f', duration_s) || 's; max is 2700s' ELSE '' END AS error FROM e""",
    "motion_filter": f"WITH {BASE}, s AS (SELECT job_id, i, (k - 50) / 30.0::DOUBLE AS dx, value / 100.0::DOUBLE AS dy FROM base) SELECT job_id, i, round(dx, 2) AS dx, round(dy, 2) AS dy FROM s WHERE abs(dx) > 1.5 OR abs(dy) > 1.5",
    "uploads_completed": "SELECT c_custkey AS video_id, CASE WHEN c_custkey % 3 <> 0 THEN 200 ELSE 409 END::INT AS code, CASE WHEN c_custkey % 3 <> 0 THEN 'uploaded' ELSE 'uploading' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 1000 ELSE 0 END::BIGINT AS byte_size FROM customer",
    "jobs_created": """SELECT o_orderkey AS request_id, CASE WHEN c_custkey IS NULL OR c_custkey % 10 = 0 THEN 404 WHEN c_custkey % 5 IN (1, 3, 4) THEN 202 ELSE 409 END::INT AS code, coalesce(c_custkey % 10 <> 0 AND c_custkey % 5 IN (1, 3, 4), false) AS runs
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "stages_appended": """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'running' END AS status,
      array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 's01_validate/done/5' END, CASE o_orderstatus WHEN 'F' THEN 's02_normalize/failed/' || floor(o_totalprice)::BIGINT WHEN 'O' THEN 's02_normalize/done/' || floor(o_totalprice)::BIGINT END], lambda x: x IS NOT NULL), ',') AS stages FROM orders""",
    "stages_batched": """WITH li AS (SELECT l_orderkey AS job_id, l_linenumber AS n, CASE WHEN max(l_returnflag) = 'R' AND l_linenumber > 2 THEN 'failed' ELSE 'done' END AS s, max(l_partkey) AS ms FROM lineitem GROUP BY 1, 2)
      SELECT o_orderkey AS job_id, CASE WHEN bool_or(s = 'failed') THEN 'failed' ELSE 'running' END AS status, coalesce(string_agg(printf('s%02d', n) || '/' || s || '/' || ms, ',' ORDER BY n), '') AS stages FROM orders LEFT JOIN li ON job_id = o_orderkey GROUP BY 1""",
    # One edit of every report at a time, against the head that the one before has left.
    "edits_answered": """WITH RECURSIVE e AS (SELECT k, n, k * 100 + n AS rev, CASE WHEN k % 7 = 0 AND n = 3 THEN k * 100 + 1 WHEN k % 11 = 0 AND n = 2 THEN -1 WHEN k % 9 = 0 AND n = 1 THEN k * 100 + 2 ELSE k * 100 + n - 1 END AS parent, k % 5 = 0 AND n = 2 AS bad
        FROM (SELECT DISTINCT l_orderkey AS k, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem)
      ), w AS (
        SELECT o_orderkey AS k, 0::BIGINT AS n, o_orderkey * 100 AS head, NULL::BIGINT AS rev, 0 AS code FROM orders WHERE o_orderkey % 13 <> 5
        UNION ALL SELECT w.k, e.n, CASE WHEN e.parent = w.head AND NOT e.bad THEN e.rev ELSE w.head END, e.rev, CASE WHEN e.parent <> w.head THEN 409 WHEN e.bad THEN 422 ELSE 200 END FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1
      )
      SELECT k AS report_id, rev AS revision_id, code FROM w WHERE rev IS NOT NULL
      UNION ALL SELECT k, rev, 404 FROM e WHERE k % 13 = 5 OR k NOT IN (SELECT o_orderkey FROM orders)""",
    "roles_allowed": f"""WITH m AS (SELECT n_name, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 END AS r, c_nationkey % 5 AS least FROM customer JOIN nation ON n_nationkey = c_nationkey)
      SELECT n_name, CASE WHEN r IS NULL THEN 404 WHEN list_position({ROLE_LIST}, {ROLE_LIST}[r + 1]) < least + 1 THEN 403 ELSE 200 END::INT AS code, count(*) AS n FROM m GROUP BY 1, 2""",
    "revisions_saved": f"""WITH {REV} SELECT report_id, CASE WHEN report_id % 2 = 0 THEN 'in_review' ELSE 'draft' END AS status, revision_id + CASE WHEN report_id % 2 = 0 THEN 1000000000 ELSE 0 END AS head_revision_id,
      CASE WHEN report_id % 2 = 0 THEN revision_id + 1000000000 ELSE 0 END AS saved, CASE WHEN report_id % 2 = 0 THEN 'human' ELSE '' END AS author_type FROM h""",
    "revision_history": f"WITH {REV} SELECT report_id, string_agg(revision_id::VARCHAR, ',' ORDER BY created_at DESC, revision_id DESC) AS revisions FROM n GROUP BY 1",
    "reports_exported": f"""WITH {REV}, r AS (SELECT o_orderkey AS id, ['json', 'markdown', 'text', 'github', 'ado', 'pdf'][o_orderkey % 6 + 1] AS format, h.report_id FROM orders LEFT JOIN h ON h.report_id = o_orderkey
      ), c AS (SELECT *, CASE WHEN report_id IS NULL THEN 404 WHEN id % 11 = 0 THEN 409 WHEN format = 'pdf' THEN 400 ELSE 201 END::INT AS code FROM r)
      SELECT format, code, CASE WHEN report_id IS NULL THEN '' WHEN id % 2 = 1 THEN 'in_review' WHEN code = 201 THEN 'exported' ELSE 'approved' END AS status, count(*) AS n FROM c GROUP BY 1, 2, 3""",
    "comments_listed": "SELECT l_orderkey AS report_id, string_agg('s' || l_linenumber || l_returnflag, ',' ORDER BY l_shipdate, l_partkey * 10 + l_linenumber, 's' || l_linenumber, l_returnflag) AS comments FROM lineitem GROUP BY 1",
    "steps_merged": """WITH li AS (SELECT l_orderkey AS job_id, l_linenumber AS idx, min(l_partkey) AS p, min(l_discount) AS c FROM lineitem GROUP BY 1, 2
      ), l AS (SELECT job_id, list({'i': idx, 'p': p, 'c': c} ORDER BY idx) AS r FROM li GROUP BY 1
      ), f AS (SELECT job_id, list_reduce(list_transform(r, lambda x: [{'i': x.i, 'a': x, 'b': NULL::STRUCT(i BIGINT, p BIGINT, c DOUBLE), 'open': x.p % 2 = 0}]),
          lambda acc, x: CASE WHEN acc[len(acc)].open THEN list_concat(acc[:-2], [{'i': acc[len(acc)].i, 'a': acc[len(acc)].a, 'b': x[1].a, 'open': false}]) ELSE list_concat(acc, x) END) AS kept FROM l
      ), u AS (SELECT job_id, u.k.i AS idx, row_number() OVER (PARTITION BY job_id ORDER BY u.k.i) AS new_idx, u.k.a AS a, u.k.b AS b FROM f, unnest(kept) AS u(k))
      SELECT job_id, idx, new_idx, CASE WHEN b IS NULL THEN 'Open part ' || a.p || '.' ELSE 'Open part ' || a.p || ', then open part ' || b.p || '.' END AS text, least(a.c, coalesce(b.c, a.c)) AS confidence, CASE WHEN b IS NULL THEN a.p::VARCHAR ELSE a.p || ',' || b.p END AS evidence FROM u""",
    "timeline_places": f"""WITH {EVENTS} {JOBS} SELECT el.job_id, el.seq, CASE WHEN duration_ms > 0 THEN round(100.0::DOUBLE * t_start_ms / duration_ms, 4) END AS percent, CASE WHEN confidence >= 0.8 THEN 'ok' WHEN confidence >= 0.6 THEN 'warn' ELSE 'bad' END AS shade
      FROM el JOIN jb USING (job_id) WHERE type <> 'scroll'""",
    "ticket_payload": r"""WITH rep AS (SELECT o_orderkey AS id, 'Issue in ' || substr(o_orderpriority, 3) AS title, CASE o_orderstatus WHEN 'F' THEN 'crash' WHEN 'O' THEN 'functional' ELSE 'unknown' END AS t FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
      ), f AS (SELECT '/fields/System.Title' AS path, length(title) AS n FROM rep UNION ALL SELECT '/fields/Microsoft.VSTS.TCM.ReproSteps', 0 FROM rep
        UNION ALL SELECT '/fields/Microsoft.VSTS.Common.Severity', length(CASE t WHEN 'crash' THEN '1 - Critical' WHEN 'functional' THEN '2 - High' ELSE '3 - Medium' END) FROM rep
        UNION ALL SELECT '/fields/System.Tags', length('recording; ' || t) FROM rep UNION ALL SELECT '/fields/System.AreaPath', length('Web\Shop') FROM rep WHERE id % 2 = 0)
      SELECT path, count(*) AS n, sum(n)::BIGINT AS chars FROM f GROUP BY 1""",
    "urls_quoted": "SELECT p_partkey, replace(url_encode(p_name || ' (100%) é/~x_*+' || p_brand), '%2F', '/') AS quoted FROM part",
}
