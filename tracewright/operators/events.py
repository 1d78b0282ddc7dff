"""Detectors of user events and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import geometry, text
from tracewright.operators.sequence import better_within, fold, in_bins, islands, spaced
from tracewright.operators.settings import Settings

DEFAULT = Settings()

# Words that point at an error, and words that send a form.
ERROR_WORDS = "error|failed|failure|exception|crash|undefined|null|nan|oops|something went wrong|not found|cannot|unable to|invalid"
ERROR = r"(^|[^\p{L}\p{N}_])(" + ERROR_WORDS + r")([^\p{L}\p{N}_]|$)"
SUBMIT = ("submit", "save", "apply", "continue", "confirm", "ok", "sign in", "log in", "login", "register", "send", "next", "checkout", "pay", "add", "create", "update", "delete")


def scrolls(motions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Runs of vertical motion in one direction without a long gap."""
    strong = motions.where(F.abs("dy") >= s.scroll_px)
    runs = islands(strong, ["job_id"], ["t_ms", "seq"], lambda before: (F.col("t_ms") - before("t_ms") > s.scroll_gap_ms) | ((F.col("dy") > 0) != (before("dy") > 0)))
    total = F.sum("dy")
    return runs.groupBy("job_id", "island").agg(
        F.min("t_ms").alias("t_start_ms"),
        F.max("t_ms").alias("t_end_ms"),
        F.when(total < 0, "down").otherwise("up").alias("direction"),
        F.round(F.abs(total), 1).alias("magnitude_px"),
        F.lit(0.92).alias("confidence"),
        F.lit("scroll").alias("type"),
        F.array(F.lit("global_motion")).alias("signals"),
    )


def unexplained(segs: DataFrame, motions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """nav and dialog segments that no scroll around their start explains (interval anti join)."""
    width = s.scroll_before_ms + s.scroll_after_ms
    m = motions.where(F.abs("dy") >= s.scroll_px).select(F.col("job_id").alias("_job"), F.col("t_ms").alias("_t"))
    m = in_bins(m, F.col("_t") - s.scroll_after_ms, F.col("_t") + s.scroll_before_ms, width)
    changes = segs.where(F.col("transition_type").isin("nav", "dialog"))
    near = (F.col("job_id") == F.col("_job")) & (F.floor(F.col("start_ms") / width) == F.col("_bin")) & F.col("_t").between(F.col("start_ms") - s.scroll_before_ms, F.col("start_ms") + s.scroll_after_ms)
    return changes.join(m, near, "left_anti")


def raw_clicks(segs: DataFrame, cursor: DataFrame, motions: DataFrame, scale: float = 1.0, s: Settings = DEFAULT) -> DataFrame:
    """Clicks before deduplication: the last cursor sample before a change, or the change alone."""
    left = unexplained(segs, motions, s)
    width = s.click_before_ms + s.click_after_ms
    c = cursor.select(F.col("job_id").alias("_job"), F.col("t_ms").alias("_t"), F.col("seq").alias("_s"), "x", "y")
    c = in_bins(c, F.col("_t") - s.click_after_ms, F.col("_t") + s.click_before_ms, width)
    seen = (F.col("job_id") == F.col("_job")) & (F.floor(F.col("start_ms") / width) == F.col("_bin")) & F.col("_t").between(F.col("start_ms") - s.click_before_ms, F.col("start_ms") + s.click_after_ms)
    hit = F.when(F.col("_t").isNotNull(), F.struct("_t", "_s", "x", "y"))
    hits = left.join(c, seen, "left").groupBy("job_id", "idx", "start_ms", "transition_type").agg(F.max(hit).alias("hit"))
    both = hits.where(F.col("hit").isNotNull() | (F.col("transition_type") == "nav"))
    anchored = F.col("hit").isNotNull()
    return both.select(
        "job_id",
        F.col("idx").alias("led_to_segment"),
        F.when(anchored, F.col("hit._t")).otherwise(F.greatest(F.lit(0), F.col("start_ms") - 400)).cast("long").alias("t_start_ms"),
        F.col("start_ms").alias("t_end_ms"),
        F.when(anchored, (F.col("hit.x") * scale).cast("long")).alias("x"),
        F.when(anchored, (F.col("hit.y") * scale).cast("long")).alias("y"),
        F.when(anchored, 0.75).otherwise(0.55).alias("confidence"),
        F.when(anchored, F.array(F.lit("cursor_dwell"), F.lit("transition"))).otherwise(F.array(F.lit("transition_only"))).alias("signals"),
    )


def deduped(clicks: DataFrame, order: str, s: Settings = DEFAULT) -> DataFrame:
    """Of clicks in quick succession the most certain one stays and becomes the anchor."""
    keep = [c for c in clicks.columns if c != "job_id"]
    return fold(clicks, ["job_id"], ["t_start_ms", order], keep, better_within("t_start_ms", s.click_dedupe_ms, "confidence"), "t_start_ms", s.click_dedupe_ms)


def clicks(segs: DataFrame, cursor: DataFrame, motions: DataFrame, scale: float = 1.0, device: str = "desktop", s: Settings = DEFAULT) -> DataFrame:
    out = deduped(raw_clicks(segs, cursor, motions, scale, s), "led_to_segment", s)
    return out.withColumn("type", F.lit("tap" if device == "mobile" else "click"))


def typing(blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """Text that grows in one box between neighbouring keyframes of a segment."""
    w = Window.partitionBy("job_id").orderBy("t_ms", "seq")
    pairs = frames.select("job_id", "t_ms", F.col("frame_id").alias("from_id"), F.lead("frame_id").over(w).alias("to_id"), F.lead("t_ms").over(w).alias("to_ms"), "segment_idx", F.lead("segment_idx").over(w).alias("_next"))
    pairs = pairs.where(F.col("segment_idx") == F.col("_next"))
    box = F.struct("x", "y", "w", "h")
    shown = text.computed(blocks, "q_clean", text.clean(F.col("text")))
    before = shown.select("job_id", F.col("frame_id").alias("from_id"), box.alias("p_box"), F.col("q_clean").alias("p"))
    after = shown.where((F.col("confidence") >= 0.5) & (F.col("role") != "status_bar")).select("job_id", F.col("frame_id").alias("to_id"), F.col("block_no"), box.alias("c_box"), F.col("q_clean").alias("c"))
    grown = F.length("c") - F.length("p") >= 3
    begins = F.lower("c").startswith(F.lower(F.left(F.col("p"), F.lit(3))))
    met = pairs.join(before, ["job_id", "from_id"]).join(after, ["job_id", "to_id"]).where(grown & ((F.length("p") == 0) | (F.length("p") >= 2)) & begins)
    met = met.where(geometry.iou(F.col("p_box"), F.col("c_box")) >= 0.3)
    # Only text that grew is rated.
    met = text.with_quality(met, "c").where(text.typed_ok(F.col("c"), F.col("q_tokens"), F.col("q_quality")))
    return met.select("job_id", F.col("t_ms").alias("t_start_ms"), F.col("to_ms").alias("t_end_ms"), F.left(F.col("c"), F.lit(200)).alias("final_text"), F.floor(F.col("c_box.x") + F.col("c_box.w") / 2).alias("x"), F.floor(F.col("c_box.y") + F.col("c_box.h") / 2).alias("y"), F.lit(0.85).alias("confidence"), "block_no", F.lit("type").alias("type"), F.array(F.lit("ocr_text_growth")).alias("signals"))


def navigations(segs: DataFrame, blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """Dialogs and navigations, the latter with the first usable chrome text of their first frame."""
    first = frames.groupBy("job_id", "segment_idx").agg(F.min_by("frame_id", F.struct("t_ms", "seq")).alias("frame_id"))
    chrome = text.with_label(blocks.where(F.col("role").isin("url_bar", "title_bar") & (F.col("confidence") > 0.45)), "text", "label", 80).where(F.col("label") != "")
    named = first.join(chrome, ["job_id", "frame_id"]).groupBy("job_id", F.col("segment_idx").alias("idx")).agg(F.min_by("label", "block_no").alias("target"))
    moved = segs.where((F.col("idx") > 0) & F.col("transition_type").isin("nav", "dialog")).join(named, ["job_id", "idx"], "left")
    nav = F.col("transition_type") == "nav"
    return moved.select(
        "job_id",
        "idx",
        F.when(nav, "navigate").otherwise("dialog_open").alias("type"),
        F.col("start_ms").alias("t_start_ms"),
        (F.col("start_ms") + 300).alias("t_end_ms"),
        F.when(nav, F.coalesce("target", F.lit(""))).otherwise("").alias("target"),
        F.when(nav, 0.8).otherwise(0.7).alias("confidence"),
        F.when(nav, F.array(F.lit("segment_transition"))).otherwise(F.array(F.lit("localized_overlay"))).alias("signals"),
    )


def nearest_labels(events: DataFrame, blocks: DataFrame, roles: tuple[str, ...] = ("button_like", "body"), s: Settings = DEFAULT) -> DataFrame:
    """(job_id, event_id, label): the best text near each event in place and time."""
    usable = text.with_label(blocks.where(F.col("role").isin(*roles) & (F.col("confidence") >= 0.45)), "text").where(F.col("label") != "")
    rated = text.with_quality(usable, "label").select("job_id", "block_no", F.col("t_ms").alias("b_ms"), F.struct("x", "y", "w", "h").alias("box"), "role", "label", F.col("q_quality").alias("quality"))
    at = events.where(F.col("x").isNotNull()).select("job_id", "event_id", F.col("t_start_ms"), F.col("x").alias("px"), F.col("y").alias("py"))
    at = in_bins(at, F.col("t_start_ms") - s.label_ms, F.col("t_start_ms") + s.label_ms, 2 * s.label_ms)
    rated = rated.withColumn("_bin", F.floor(F.col("b_ms") / (2 * s.label_ms)))
    met = at.join(rated, ["job_id", "_bin"]).where(F.abs(F.col("b_ms") - F.col("t_start_ms")) <= s.label_ms)
    met = met.withColumn("d", geometry.distance(F.col("px"), F.col("py"), F.col("box"))).where(F.col("d") <= s.label_px)
    score = (1 - F.col("d") / (s.label_px + 1)) + F.when(F.col("role") == "button_like", 0.3).otherwise(0.0) + 0.15 * F.col("quality") - F.when(F.length("label") > 40, 0.1).otherwise(0.0)
    met = met.withColumn("score", F.round(score, 9)).where(F.col("score") > 0)
    return met.groupBy("job_id", "event_id").agg(F.max_by("label", F.struct("score", -F.col("block_no"))).alias("label"))


def promoted(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Clicks on a button whose label sends a form become form_submit."""
    joined = events.join(labels, ["job_id", "event_id"], "left")
    sends = F.col("type").isin("click", "tap") & F.lower("label").isin(*SUBMIT)
    return joined.withColumn("button", F.when(sends, F.col("label"))).withColumn("type", F.when(sends, "form_submit").otherwise(F.col("type"))).drop("label")


def submits(events: DataFrame, blocks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Events with clicks promoted by the nearest text that looks like a button."""
    clicks_at = events.where(F.col("type").isin("click", "tap"))
    return promoted(events, nearest_labels(clicks_at, blocks, ("button_like",), s))


#: Columns of an event beside job_id, seq and event_id, with their types.
EVENT = {"type": "string", "t_start_ms": "long", "t_end_ms": "long", "x": "long", "y": "long", "target": "string", "direction": "string", "magnitude_px": "double", "final_text": "string", "led_to_segment": "long", "confidence": "double", "signals": "array<string>"}


def ordered(*detectors: DataFrame) -> DataFrame:
    """Union of what detectors found, numbered by start; ties in the order of the detectors, then of their own rows.

    A detector's rows need job_id, type, t_start_ms, t_end_ms, confidence and
    signals; ``ord`` (or led_to_segment, idx, block_no) is their own order.
    """
    found = None
    for rank, df in enumerate(detectors):
        own = next((c for c in ("ord", "led_to_segment", "idx", "block_no") if c in df.columns), None)
        cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EVENT.items()]
        rows = df.select("job_id", *cols, F.lit(rank).alias("_rank"), (F.col(own) if own else F.lit(0)).cast("long").alias("_ord"))
        found = rows if found is None else found.unionByName(rows)
    w = Window.partitionBy("job_id").orderBy("t_start_ms", "_rank", "_ord", "t_end_ms")
    numbered = found.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("target", F.coalesce("target", F.lit("")))
    return numbered.withColumn("event_id", F.concat_ws("-", "job_id", "seq")).drop("_rank", "_ord")


def detected(segs: DataFrame, motions: DataFrame, cursor: DataFrame, blocks: DataFrame, frames: DataFrame, scale: float = 1.0, device: str = "desktop", s: Settings = DEFAULT) -> DataFrame:
    """All events of every recording, in order, clicks on submit buttons promoted."""
    found = ordered(scrolls(motions, s), clicks(segs, cursor, motions, scale, device, s), typing(blocks, frames), navigations(segs, blocks, frames))
    return submits(found, blocks, s)


def error_texts(blocks: DataFrame) -> DataFrame:
    """Readable text that names an error."""
    rated = text.with_quality(blocks.where(F.col("confidence") >= 0.45), "text")
    bad = rated.where((F.col("q_quality") >= 0.5) & F.lower("q_clean").rlike(ERROR))
    return bad.select("job_id", "t_ms", F.lit("error_text").alias("type"), F.left(F.col("q_clean"), F.lit(300)).alias("text"), F.round(F.least(F.lit(0.85), 0.5 + 0.4 * F.col("confidence")), 6).alias("score"), F.col("block_no").alias("ord"))


def blanks(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Near-black samples, one per ``blank_gap_ms``."""
    dark = samples.where(F.coalesce("lum", F.lit(100.0)) < s.blank_lum)
    kept = fold(dark, ["job_id"], ["t_ms", "i"], ["lum"], spaced("t_ms", s.blank_gap_ms), "t_ms", s.blank_gap_ms)
    return kept.select("job_id", "t_ms", F.lit("blank_screen").alias("type"), "lum", F.lit(0.7).alias("score"), F.col("i").alias("ord"))


def stalls(samples: DataFrame, last_actions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Jobs in which nothing moves any more after the last action, for long enough."""
    tail = samples.join(last_actions.select("job_id", "last_ms"), "job_id").where(F.col("t_ms") > F.col("last_ms"))
    still = tail.groupBy("job_id").agg(F.bool_and(F.col("score") < s.stall_score).alias("still"), F.min("t_ms").alias("t_ms"), (F.max("t_ms") - F.min("t_ms")).alias("static_ms"))
    return still.where(F.col("still") & (F.col("static_ms") > s.stall_ms)).select("job_id", "t_ms", F.lit("stall").alias("type"), "static_ms", F.lit(0.5).alias("score"))


def last_actions(events: DataFrame) -> DataFrame:
    """(job_id, last_ms): when the last event of each job ended."""
    return events.groupBy("job_id").agg(F.max("t_end_ms").alias("last_ms"))


def anomalies(blocks: DataFrame, samples: DataFrame, events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Union of the three detectors in order of time: job_id, ord, type, t_ms, score, text, lum, static_ms."""
    kinds = {"type": "string", "t_ms": "long", "score": "double", "text": "string", "lum": "double", "static_ms": "long"}
    found = None
    for rank, df in enumerate((error_texts(blocks), blanks(samples, s), stalls(samples, last_actions(events), s))):
        cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        rows = df.select("job_id", *cols, F.lit(rank).alias("_rank"), (F.col("ord") if "ord" in df.columns else F.lit(0)).cast("long").alias("_ord"))
        found = rows if found is None else found.unionByName(rows)
    w = Window.partitionBy("job_id").orderBy("t_ms", "_rank", "_ord")
    return found.withColumn("ord", (F.row_number().over(w) - 1).cast("long")).drop("_rank", "_ord")


def ranked(anomalies: DataFrame, most: int = 6) -> DataFrame:
    """Candidates of each job by score, then by time, later first; ties by order of detection."""
    w = Window.partitionBy("job_id").orderBy(F.col("score").desc(), F.col("t_ms").desc(), "ord")
    kinds = F.create_map(*[F.lit(x) for pair in BUG_TYPES.items() for x in pair])
    out = anomalies.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return out.withColumn("bug_type", F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("unknown")))


# What a report says about each kind of anomaly.
OBSERVED = {
    "error_text": ('The UI displays the error text: "', '"'),
    "blank_screen": ("The screen goes blank (near-black frame), suggesting a crash or render failure.",),
    "stall": ("The screen remains completely unchanged for ", "s after the last user action, suggesting a freeze or unresponsive state."),
    "other": ("An unexpected UI state is visible.",),
    "none": ("No clear bug manifestation was detected automatically. Review the timeline and mark the failure point manually.",),
}


def observed_text(kind: Column, said: Column, static_ms: Column) -> Column:
    """Sentence about an anomaly of a kind (null: about none)."""
    around = lambda k, middle: F.concat(F.lit(OBSERVED[k][0]), middle, F.lit(OBSERVED[k][1]))
    return (
        F.when(kind.isNull(), OBSERVED["none"][0])
        .when(kind == "error_text", around("error_text", F.coalesce(said, F.lit(""))))
        .when(kind == "blank_screen", OBSERVED["blank_screen"][0])
        .when(kind == "stall", around("stall", geometry.one_place(F.coalesce(static_ms, F.lit(0)) / 1000)))
        .otherwise(OBSERVED["other"][0])
    )


def localized(jobs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Where each recording shows its bug: one row per job, also without any anomaly.

    found, bug_type, t_ms, type, observed, confidence, and the next five
    candidates in order (t_ms, type, score).
    """
    best = ranked(anomalies, 6)
    first = F.struct("t_ms", "type", "score", "text", "static_ms", "bug_type")
    candidate = F.when(F.col("place") > 1, F.struct("place", "t_ms", "type", "score"))
    per_job = best.groupBy("job_id").agg(F.min_by(first, "place").alias("b"), F.array_sort(F.collect_list(candidate)).alias("candidates"))
    found = F.col("b").isNotNull()
    return jobs.select("job_id").join(per_job, "job_id", "left").select(
        "job_id",
        found.alias("found"),
        F.coalesce("b.bug_type", F.lit("unknown")).alias("bug_type"),
        F.col("b.t_ms").alias("t_ms"),
        F.col("b.type").alias("type"),
        observed_text(F.col("b.type"), F.col("b.text"), F.col("b.static_ms")).alias("observed"),
        F.when(found, F.round(F.col("b.score"), 2)).otherwise(0.0).alias("confidence"),
        F.coalesce("candidates", F.array().cast("array<struct<place:int,t_ms:bigint,type:string,score:double>>")).alias("candidates"),
    )


# Bug types by kind of anomaly.
BUG_TYPES = {"error_text": "functional", "blank_screen": "crash", "crash_dialog": "crash", "stall": "performance", "app_exit": "crash", "layout_shift": "rendering"}
