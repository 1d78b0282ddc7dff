"""Change samples to segments and keyframe times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.sequence import BITS, bursts, cut, greedy, rank_blocks, spaced, upper_median
from tracewright.operators.settings import Settings

DEFAULT = Settings()


def _threshold(s: Settings, over: Window | None = None) -> Column:
    mean, deviation = F.avg("score"), F.stddev_pop("score")
    if over is not None:
        mean, deviation = mean.over(over), deviation.over(over)
    return F.round(F.greatest(F.lit(s.score_floor), mean + s.score_sigmas * deviation), 6)


def thresholds(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(job_id, threshold): mean and population deviation of the scores, with a floor."""
    return samples.groupBy("job_id").agg(_threshold(s).alias("threshold"))


def _bursts(samples: DataFrame, s: Settings) -> DataFrame:
    """One row per burst of samples over the threshold, with the quieter samples behind it.

    ``rows`` are its samples in order, ``marks`` the boundaries among them.  The
    exchange by job_id serves everything below.
    """
    job = Window.partitionBy("job_id")
    timed = samples.select(
        "job_id",
        "i",
        "t_ms",
        "score",
        "change_frac",
        _threshold(s, job).alias("threshold"),
        (F.max("t_ms").over(job) - F.min("t_ms").over(job)).alias("span"),
        (F.max("t_ms").over(job) + s.sample_ms).alias("end"),
        F.count(F.lit(1)).over(job).alias("samples"),
        F.min("i").over(job).alias("first_i"),
    )
    over = timed.withColumn("over", (F.col("i") == F.col("first_i")) | (F.col("score") >= F.col("threshold")))
    runs = bursts(over, ["job_id"], ["i"], "t_ms", s.least_segment_ms, F.col("over"))
    rows = F.array_sort(F.collect_list(F.struct("i", "t_ms", "score", "change_frac", "over")))
    return runs.groupBy("job_id", "_run", "span", "end", "samples").agg(rows.alias("rows")).withColumn("marks", greedy(cut(F.filter("rows", lambda r: r["over"])), spaced("t_ms", s.least_segment_ms)))


def boundaries(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """First sample of each job, then every sample over the threshold that is far enough from the last one taken."""
    return _bursts(samples, s).select("job_id", F.explode("marks").alias("b")).select("job_id", "b.i", "b.t_ms", "b.score", "b.change_frac")


def _profiled(samples: DataFrame, s: Settings) -> DataFrame:
    """(job_id, b, end, n, rate_per_min, spread) of each boundary b.

    Samples and the two ends of each boundary's score band are sorted together
    once: ranks of the ends give the count.  Ranks are dealt into blocks of 1,
    8, 64, ... with their earliest and latest time, and a band reads at most 14
    blocks a level, so no boundary meets the samples.
    """
    marked = _bursts(samples, s)
    none = F.lit(None)

    def entry(value: Column, kind: int, t: Column, b: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), F.lit(kind).alias("kind"), t.cast("long").alias("t"), b.alias("b"))

    empty = F.struct(*[none.cast(t).alias(c) for c, t in (("i", "long"), ("t_ms", "long"), ("score", "double"), ("change_frac", "double"))])
    short = lambda m: F.struct(m["i"].cast("long").alias("i"), m["t_ms"].cast("long").alias("t_ms"), m["score"].cast("double").alias("score"), m["change_frac"].cast("double").alias("change_frac"))
    seen = F.transform("rows", lambda r: entry(r["score"], 1, r["t_ms"], F.when(F.lit(False), empty)))
    low = F.transform("marks", lambda m: entry(s.ambient_low * m["score"], 0, none, short(m)))
    high = F.transform("marks", lambda m: entry(s.ambient_high * m["score"], 2, none, short(m)))
    rows = marked.select("job_id", "span", "end", "samples", F.explode(F.concat(seen, low, high)).alias("e")).select("job_id", "span", "end", "samples", "e.*")
    by_score = Window.partitionBy("job_id").orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("rank", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(by_score))
    # The two ends of a boundary meet; a sample is its own group.
    id_of = F.when(F.col("kind") == 1, -F.col("rank")).otherwise(F.col("b.i"))
    joined = ranked.groupBy("job_id", (F.col("kind") == 1).alias("sample"), id_of.alias("id"), "span", "end", "samples").agg(
        F.first("b").alias("b"), F.max("t").alias("t"), F.min("rank").alias("first"), F.max("rank").alias("behind")
    )
    joined = joined.withColumn("n", F.when(~F.col("sample"), F.when(F.col("b.score") > 0, F.col("behind") - F.col("first")).otherwise(0)))
    levels = F.ceil(F.log2(F.col("samples").cast("double")) / BITS).cast("int")
    own = F.transform(F.sequence(F.lit(0), levels), lambda v: F.struct(v.alias("level"), F.floor((F.col("first") - 1) / F.pow(F.lit(2.0**BITS), v)).cast("long").alias("block")))
    asked = F.when(F.col("n") > 0, rank_blocks(F.col("first"), F.col("behind"), levels)).otherwise(F.array(F.struct(F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("block"))))
    dealt = joined.select("job_id", "span", "end", "sample", "b", "n", "t", F.explode(F.when(F.col("sample"), own).otherwise(asked)).alias("at"))
    block = Window.partitionBy("job_id", "at")
    times = dealt.withColumn("from", F.min("t").over(block)).withColumn("to", F.max("t").over(block)).where(~F.col("sample"))
    width = F.max("to") - F.min("from")
    counted = times.groupBy("job_id", "b", "span", "end", "n").agg(width.alias("width"))
    return counted.select(
        "job_id",
        "b",
        "end",
        "n",
        F.round(F.col("n") / F.greatest(F.col("span") / 60000.0, F.lit(1.0 / 60)), 4).alias("rate_per_min"),
        F.round(F.when(F.col("span") > 0, F.coalesce("width", F.lit(0)) / F.col("span")).otherwise(0.0), 4).alias("spread"),
    )


def ambient(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per boundary: how many samples of the job score like it, how often and how far spread."""
    return _profiled(samples, s).select("job_id", "b.i", "n", "rate_per_min", "spread")


def segments(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(job_id, idx, start_ms, end_ms, transition_type) covering every job's timeline."""
    placed = _profiled(samples, s).select("*", "b.i", "b.t_ms", "b.change_frac")
    w = Window.partitionBy("job_id").orderBy("i")
    steady = (F.col("n") >= s.ambient_samples) & (F.col("spread") >= s.ambient_spread)
    busy = lambda rate: steady & (F.col("rate_per_min") > rate)
    kind = (
        F.when(F.col("idx") == 0, "start")
        .when(F.col("change_frac") >= s.nav_change, F.when(busy(s.nav_rate), "minor").otherwise("nav"))
        .when(F.col("change_frac") >= s.dialog_change, F.when(busy(s.dialog_rate), "minor").otherwise("dialog"))
        .otherwise("minor")
    )
    out = placed.withColumn("idx", F.row_number().over(w) - 1).withColumn("end_ms", F.coalesce(F.lead("t_ms").over(w), F.col("end")))
    return out.select("job_id", F.col("idx").cast("long").alias("idx"), F.col("t_ms").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), kind.alias("transition_type"))


def keyframe_times(segs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One time after each segment's start, one more before the end of long ones."""
    early = F.least(F.col("start_ms") + s.keyframe_after_ms, F.col("end_ms") - 1)
    late = F.when(F.col("end_ms") - F.col("start_ms") > s.keyframe_long_ms, F.col("end_ms") - s.keyframe_before_end_ms)
    times = segs.select("job_id", F.col("idx").alias("segment_idx"), F.posexplode(F.array_compact(F.array(early, late))).alias("part", "t_ms"))
    return times.select("job_id", "segment_idx", F.col("part").cast("long").alias("part"), F.col("t_ms").cast("long").alias("t_ms"))


def themes(samples: DataFrame) -> DataFrame:
    """dark or light by the upper median of luminance."""
    # From the top, the value that half of the samples reach: the upper one of an even number's middle two.
    mid = samples.groupBy("job_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY lum DESC)").alias("median_lum"))
    return mid.withColumn("theme", F.when(F.coalesce("median_lum", F.lit(128.0)) < 90, "dark").otherwise("light"))


def blur_medians(samples: DataFrame, value: str = "blur", most: int = 10) -> DataFrame:
    """(job_id, blur): upper median of the first ``most`` samples of each recording."""
    w = Window.partitionBy("job_id").orderBy("i")
    first = samples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return first.groupBy("job_id").agg(upper_median(F.collect_list(value)).alias("blur"))
