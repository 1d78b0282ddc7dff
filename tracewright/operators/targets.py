"""Names of the controls that clicks hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry, text
from tracewright.operators.events import nearest_labels
from tracewright.operators.settings import Settings
from tracewright.operators.steps import ACTIVATIONS

DEFAULT = Settings()
CROP_W, CROP_H = 460, 220
#: A crop is taken a little before the click, while the control is still there.
BEFORE_MS = 120


def crops(events: DataFrame, targets: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """Windows to be read for clicks that no keyframe named (anti join before the costly step)."""
    open_ = events.where(F.col("type").isin(*ACTIVATIONS) & F.col("x").isNotNull()).join(targets.select("job_id", "event_id"), ["job_id", "event_id"], "left_anti")
    window = geometry.crop(F.col("x"), F.col("y"), F.lit(frame_w), F.lit(frame_h), CROP_W, CROP_H)
    return open_.select("job_id", "event_id", F.greatest(F.lit(0), F.col("t_start_ms") - BEFORE_MS).alias("t_ms"), "x", "y", window.alias("crop"))


def crop_labels(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """(job_id, event_id, label): the best line read in each crop; ``lines`` has line_no, text, confidence and a box in the crop."""
    usable = text.with_label(lines.where(F.col("confidence") >= 0.45), "text").where(F.col("label") != "")
    rated = text.with_quality(usable, "label").join(windows.select("job_id", "event_id", "x", "y", "crop"), ["job_id", "event_id"])
    box = F.struct(*[F.col(c).alias(c[4:]) for c in ("box_x", "box_y", "box_w", "box_h")])
    far = geometry.distance(F.col("x") - F.col("crop.x0"), F.col("y") - F.col("crop.y0"), box)
    score = 1 - F.least(far, F.lit(300.0)) / 301 + 0.3 * F.col("q_quality") - F.when(F.length("label") > 40, 0.1).otherwise(0.0)
    met = rated.withColumn("score", F.round(score, 9)).where("score > 0")
    return met.groupBy("job_id", "event_id").agg(F.max_by("label", F.struct("score", -F.col("line_no"))).alias("label"))


def resolved(events: DataFrame, blocks: DataFrame, lines: DataFrame | None = None, frame_w: int = 1080, frame_h: int = 720, s: Settings = DEFAULT) -> DataFrame:
    """(job_id, event_id, label) of all activations that can be named: from keyframes, else from a crop."""
    acts = events.where(F.col("type").isin(*ACTIVATIONS))
    named = nearest_labels(acts, blocks, s=s)
    if lines is None:
        return named
    return named.unionByName(crop_labels(crops(acts, named, frame_w, frame_h), lines))


def with_targets(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events with ``target``, '' where there is none."""
    return events.drop("target").join(targets.select("job_id", "event_id", F.col("label").alias("target")), ["job_id", "event_id"], "left").withColumn("target", F.coalesce("target", F.lit("")))


def updated_actions(actions: DataFrame, targets: DataFrame, most: int = 500) -> DataFrame:
    """Stored actions with ``target_desc`` replaced where there is a new label."""
    new = targets.select("job_id", "event_id", F.nullif(F.left("label", F.lit(most)), F.lit("")).alias("_new"))
    return actions.join(new, ["job_id", "event_id"], "left").withColumn("target_desc", F.coalesce("_new", "target_desc")).drop("_new")
