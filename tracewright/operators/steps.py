"""Events to reproduction steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import geometry, text
from tracewright.operators.sequence import islands, nearest
from tracewright.operators.settings import Settings

DEFAULT = Settings()
ACTIVATIONS = ("click", "tap", "form_submit")


def post_bug_cut(events: DataFrame, bugs: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Events up to shortly after the bug, and one omitted span per job for the others."""
    joined = events.join(bugs.select("job_id", F.col("t_ms").alias("bug_ms")), "job_id", "left")
    late = F.coalesce(F.col("t_start_ms") > F.col("bug_ms") + s.after_bug_ms, F.lit(False))
    after = joined.where(late)
    spans = after.groupBy("job_id").agg(F.min_by("t_start_ms", F.struct("t_start_ms", "seq")).alias("t_start_ms"), F.max_by("t_end_ms", F.struct("t_start_ms", "seq")).alias("t_end_ms"), F.count(F.lit(1)).alias("n"))
    return joined.where(~late).drop("bug_ms"), spans


def _judged(events: DataFrame, s: Settings) -> DataFrame:
    """Events with ``_effect``: a navigation or dialog that an activation of the same recording brought about.

    Starts of events and ends of activations are sorted together; each event
    looks at the last end before it, and at the last and the next start or end
    of an activation, so no event meets the activations.
    """
    act = F.col("type").isin(*ACTIVATIONS)

    def point(time: str, own: bool) -> Column:
        return F.struct(F.col(time).alias("t"), F.lit(own).alias("own"), act.alias("act"))

    points = events.withColumn("_p", F.explode(F.when(act, F.array(point("t_start_ms", True), point("t_end_ms", False))).otherwise(F.array(point("t_start_ms", True)))))
    t = F.col("_p.t")
    upto = lambda order: Window.partitionBy("job_id").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of_act = F.when(F.col("_p.act"), t)
    seen = points.withColumn("_end", F.max(F.when(~F.col("_p.own"), t)).over(upto(t))).withColumn("_before", F.max(of_act).over(upto(t))).withColumn("_after", F.min(of_act).over(upto(t.desc())))
    near = lambda gap, most: F.coalesce(gap <= most, F.lit(False))
    same = (F.col("type") == "navigate") & (near(t - F.col("_before"), s.boundary_ms) | near(F.col("_after") - t, s.boundary_ms))
    effect = F.col("type").isin("navigate", "dialog_open") & (near(t - F.col("_end"), s.effect_ms) | same)
    return seen.where("_p.own").select(*events.columns, effect.alias("_effect"))


def suppressed(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Navigations and dialogs that an activation brought about."""
    return _judged(events, s).where("_effect").drop("_effect")


def unsuppressed(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """All other events."""
    return _judged(events, s).where("NOT _effect").drop("_effect")


def merged_scrolls(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Neighbouring scrolls in one direction become one, their magnitudes summed."""

    def breaks(before) -> Column:
        same = (F.col("type") == "scroll") & (before("type") == "scroll") & (F.col("direction") == before("direction"))
        return ~F.coalesce(same & (F.col("t_start_ms") - before("t_end_ms") < s.scroll_merge_ms), F.lit(False))

    return _merge(islands(events, ["job_id"], ["t_start_ms", "seq"], breaks), magnitude=True)


def merged_unlabeled(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Runs of clicks without place and target become one, with the least confidence."""
    blind = F.col("type").isin("click", "tap") & F.col("x").isNull() & (F.col("target") == "")
    marked = events.withColumn("_blind", blind)

    def breaks(before) -> Column:
        return ~F.coalesce(F.col("_blind") & before("_blind") & (F.col("t_start_ms") - before("t_end_ms") <= s.run_gap_ms), F.lit(False))

    return _merge(islands(marked, ["job_id"], ["t_start_ms", "seq"], breaks), count="merged_count", lowest=True)


def merged_repeated(events: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Repeated activations of one target become one, with the highest confidence."""
    named = events.withColumn("_named", F.col("type").isin(*ACTIVATIONS) & (F.col("target") != ""))

    def breaks(before) -> Column:
        same = F.col("_named") & before("_named") & (F.col("type") == before("type")) & (F.col("target") == before("target"))
        return ~F.coalesce(same & (F.col("t_start_ms") - before("t_end_ms") <= s.run_gap_ms), F.lit(False))

    return _merge(islands(named, ["job_id"], ["t_start_ms", "seq"], breaks), count="repeat_count")


def _merge(runs: DataFrame, magnitude: bool = False, count: str | None = None, lowest: bool = False) -> DataFrame:
    """One row per island: the first row's values, the last row's end."""
    place = F.struct("t_start_ms", "seq")
    special = {"job_id", "island", "t_end_ms", "confidence", "_blind", "_named", *([count] if count else []), *(["magnitude_px"] if magnitude else [])}
    first = [F.min_by(c, place).alias(c) for c in runs.columns if c not in special]
    size = F.count(F.lit(1))
    aggs = [*first, F.max_by("t_end_ms", place).alias("t_end_ms")]
    if magnitude:
        aggs += [F.round(F.sum("magnitude_px"), 1).alias("magnitude_px"), F.min_by("confidence", place).alias("confidence")]
    else:
        aggs += [(F.min if lowest else F.max)("confidence").alias("confidence")]
    if count:
        aggs.append(size.alias(count))
    # min_by and max_by need the sort keys only; the keys themselves come from the first row.
    renamed = runs.withColumnRenamed("island", "_island")
    return renamed.groupBy("job_id", "_island").agg(*aggs).drop("_island")


# Fixed values in sentence() and note(): the wording of steps, by kind of action and by what could be read.


def sentence(width: Column, height: Column) -> Column:
    """Plain text of a step from type, target, repeat_count, merged_count, x, y, final_text, direction."""
    verb = F.when(F.col("type") == "tap", "Tap").otherwise("Click")
    quoted = F.concat(verb, F.lit(' "'), F.col("target"), F.lit('"'))
    act = (
        F.when((F.col("target") != "") & (F.col("repeat_count") > 1), F.concat(quoted, F.lit(" ("), F.col("repeat_count").cast("string"), F.lit(" times).")))
        .when(F.col("target") != "", F.concat(quoted, F.lit(".")))
        .when(F.col("merged_count") > 1, F.concat(verb, F.lit(" through the next "), F.col("merged_count").cast("string"), F.lit(" screens (the exact controls could not be read from the video).")))
        .when(F.col("x").isNotNull(), F.concat(verb, F.lit(" the control at the "), geometry.region(F.col("x"), F.col("y"), width, height), F.lit(".")))
        .otherwise(F.concat(verb, F.lit(" the control that opens the next screen.")))
    )
    return (
        F.when(F.col("type").isin(*ACTIVATIONS), act)
        .when(F.col("type") == "type", F.concat(F.lit('Type "'), F.coalesce("final_text", F.lit("")), F.lit('" into the field.')))
        .when(F.col("type") == "scroll", F.concat(F.lit("Scroll "), F.coalesce("direction", F.lit("down")), F.lit(" the page.")))
        .when((F.col("type") == "navigate") & (F.col("target") != ""), F.concat(F.lit('Go to "'), F.col("target"), F.lit('".')))
        .when(F.col("type") == "navigate", "Go to the next screen.")
        .when(F.col("type") == "dialog_open", "A dialog or overlay opens.")
        .otherwise("Perform the next visible interaction.")
    )


def note() -> Column:
    """What is uncertain about a step."""
    act = F.col("type").isin(*ACTIVATIONS) & (F.col("target") == "")
    return (
        F.when(act & (F.col("merged_count") > 1), "several screen changes in a row; individual targets were not readable")
        .when(act & F.col("x").isNotNull(), "target text could not be read; location is from the cursor track")
        .when(act, "activation inferred from the screen transition only; the cursor/touch indicator was not visible")
        .when((F.col("type") == "navigate") & (F.col("target") == ""), "destination title/URL was not readable")
        .when(F.col("type").isin("click", "tap", "form_submit", "type", "scroll", "navigate", "dialog_open"), "")
        .otherwise("action type could not be classified")
    )


def numbered(steps: DataFrame) -> DataFrame:
    """Steps with ``idx`` from 1 in order of (t_start_ms, seq)."""
    w = Window.partitionBy("job_id").orderBy("t_start_ms", "seq")
    return steps.withColumn("idx", F.row_number().over(w).cast("long"))


def synthesized(events: DataFrame, width: int, height: int, s: Settings = DEFAULT) -> DataFrame:
    """The chain from events: suppress effects, merge, phrase, number."""
    kept = merged_scrolls(unsuppressed(events, s), s)
    kept = merged_repeated(merged_unlabeled(kept, s), s)
    said = kept.withColumn("text", sentence(F.lit(width), F.lit(height))).withColumn("uncertainty_note", note())
    return numbered(said.withColumn("grounding", F.when(F.col("confidence") >= 0.8, "observed").otherwise("inferred")))


def with_evidence(steps: DataFrame, frames: DataFrame) -> DataFrame:
    """Steps with the nearest keyframe: ``evidence`` (frame_id, '' where the recording has none, t_start_ms, t_end_ms)."""
    near = nearest(steps, frames, "job_id", "t_start_ms", "t_ms", "seq", "frame_id", "_frame")
    link = F.struct(F.coalesce("_frame", F.lit("")).alias("frame_id"), F.col("t_start_ms").alias("t_start_ms"), F.col("t_end_ms").alias("t_end_ms"))
    return near.withColumn("evidence", F.array(link)).drop("_frame")


STEP = ("job_id", "idx", "text", "action_type", "grounding", "confidence", "uncertainty_note", "evidence")


def reproduction(events: DataFrame, frames: DataFrame, bugs: DataFrame, width: int, height: int, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Steps of every recording up to its bug with their evidence, and the spans left out."""
    usable, spans = post_bug_cut(events, bugs, s)
    made = with_evidence(synthesized(usable, width, height, s), frames).withColumn("action_type", F.col("type"))
    reason = F.concat(F.col("n").cast("string"), F.lit(" action(s) after the bug manifestation are not needed to reproduce"))
    return made.select(*STEP), spans.select("job_id", "t_start_ms", "t_end_ms", reason.alias("reason"))


def with_entry(steps: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry steps first, all numbered anew from 1, with ``key``."""
    both = entries.withColumn("idx", F.lit(0).cast("long")).select(*STEP).unionByName(steps.select(*STEP))
    w = Window.partitionBy("job_id").orderBy("idx")
    return both.withColumn("idx", F.row_number().over(w).cast("long")).withColumn("key", F.concat(F.lit("s"), F.col("idx").cast("string")))


def opening_frames(frames: DataFrame, n: int = 2) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("t_ms", "seq")
    return frames.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def _weighted(df: DataFrame) -> DataFrame:
    rated = text.with_quality(df, "label")
    return text.computed(rated, "weight", F.round(F.col("q_quality") * F.least(F.length("label"), F.lit(8)) / 8, 9))


def entry_steps(jobs: DataFrame, blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """Where each recording begins: an address, an app, or what can be seen."""
    early = opening_frames(frames).select("job_id", "frame_id")
    labelled = text.with_label(blocks.where(F.col("confidence") > 0.45).join(early, ["job_id", "frame_id"], "left_semi"), "text", "label", 80).where(F.col("label") != "")
    rated = _weighted(labelled)
    address = F.split("label", "/")[0].rlike(text.DOMAIN)
    rank = lambda cond: F.max_by("label", F.when(cond & (F.col("weight") > 0), F.struct("weight", -F.col("block_no"))))
    picked = rated.groupBy("job_id").agg(rank(address).alias("domain"), rank(~address & (F.col("role") == "title_bar")).alias("title"))
    opens = frames.groupBy("job_id").agg(F.min_by(F.struct("frame_id", "t_ms"), F.struct("t_ms", "seq")).alias("f"))
    out = jobs.join(picked, "job_id", "left").join(opens, "job_id", "left")
    kind = F.when(F.col("device_class") == "mobile", "app").otherwise("application")
    return out.select(
        "job_id",
        F.when(F.col("domain").isNotNull(), F.concat(F.lit('Open "'), F.col("domain"), F.lit('" in the browser.')))
        .when(F.col("title").isNotNull(), F.concat(F.lit('Open the "'), F.col("title"), F.lit('" app.')))
        .otherwise(F.concat(F.lit("Open the "), kind, F.lit(" shown at the start of the recording.")))
        .alias("text"),
        F.when(F.col("domain").isNotNull() | F.col("title").isNotNull(), "observed").otherwise("assumed").alias("grounding"),
        F.when(F.col("domain").isNotNull(), 0.85).when(F.col("title").isNotNull(), 0.7).otherwise(0.5).alias("confidence"),
        F.when(F.col("domain").isNotNull() | F.col("title").isNotNull(), "").otherwise("the app name and URL were not readable on the first screen").alias("uncertainty_note"),
        F.lit("navigate").alias("action_type"),
        F.array(F.struct(F.coalesce("f.frame_id", F.lit("")).alias("frame_id"), F.lit(0).cast("long").alias("t_start_ms"), F.coalesce("f.t_ms", F.lit(0)).cast("long").alias("t_end_ms"))).alias("evidence"),
    )


def title_sources(blocks: DataFrame) -> DataFrame:
    """(job_id, title): the best chrome text, by quality and length."""
    chrome = blocks.where(F.col("role").isin("title_bar", "url_bar") & (F.col("confidence") > 0.5))
    rated = _weighted(text.with_label(chrome, "text").where(F.col("label") != "")).where(F.col("weight") > 0)
    return rated.groupBy("job_id").agg(F.max_by("label", F.struct("weight", -F.col("block_no"))).alias("title"))


def preconditions(jobs: DataFrame, blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """The first readable address or title of the opening frames, or an assumption."""
    early = opening_frames(frames).select("job_id", "frame_id")
    chrome = blocks.where(F.col("role").isin("url_bar", "title_bar") & (F.col("confidence") > 0.4)).join(early, ["job_id", "frame_id"], "left_semi")
    first = text.with_label(chrome, "text", "label", 150).where(F.col("label") != "").groupBy("job_id").agg(F.min(F.struct("block_no", "label", "confidence")).alias("b"))
    known = F.col("b").isNotNull()
    return jobs.select("job_id").join(first, "job_id", "left").select(
        "job_id",
        F.when(known, F.concat(F.lit('Start on "'), F.col("b.label"), F.lit('" (visible when the recording begins; any prior setup is unknown).'))).otherwise("Start on the screen visible at the beginning of the recording; prior setup steps are unknown.").alias("text"),
        F.when(known, "observed").otherwise("assumed").alias("grounding"),
        F.when(known, F.round(F.col("b.confidence"), 2)).otherwise(0.4).alias("confidence"),
    )
