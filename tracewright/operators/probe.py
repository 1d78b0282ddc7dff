"""Container metadata: JSON of a media probe to validated recordings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is read of a probe's JSON.
STREAMS = "array<struct<codec_type:string,codec_name:string,duration:string,avg_frame_rate:string,width:int,height:int>>"
PROBE = f"format struct<duration:string, format_name:string>, streams {STREAMS}"
LEAST_S, MOST_S = 0.5, 2700


def fps(rate: Column) -> Column:
    """Of num/den; 0 where either is missing or den is 0."""
    pieces = F.split(F.coalesce(F.nullif(rate, F.lit("")), F.lit("0/1")), "/")
    number = lambda i: F.get(pieces, F.lit(i)).try_cast("double")
    return F.coalesce(F.try_divide(number(0), F.coalesce(number(1), F.lit(1.0))), F.lit(0.0))


def device_class(width: Column, height: Column) -> Column:
    return F.when(height > 1.2 * width, "mobile").otherwise("desktop")


def parsed(files: DataFrame, probe: str = "probe") -> DataFrame:
    """Files with ``meta``, the parsed probe (null where it is no JSON)."""
    return files.withColumn("meta", F.from_json(probe, PROBE))


def probed(blobs: DataFrame, tool: Callable[[str], str]) -> DataFrame:
    """Blobs (path) with ``probe``, the JSON that ``tool`` gives for a path; null where it fails."""

    def kernel(batches):
        import pyarrow as pa

        def one(path: str) -> str | None:
            try:
                return tool(path)
            except Exception:  # noqa: BLE001 - an unreadable file is no reason to fail the others
                return None

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(one, batch.column(0).to_pylist())), pa.string())], names=["path", "probe"])

    return blobs.select("path").mapInArrow(kernel, "path string, probe string")


def validated(files: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """Files with duration, rate, size, device and ``error``, the first rule that fails (null: none).

    ``files`` has path and meta; ``packets`` gives (path, duration_s) for media
    whose header has no duration.
    """
    kind = lambda k: F.filter("meta.streams", lambda s: s["codec_type"] == k)
    v = F.get(F.col("_video"), F.lit(0))
    seconds = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    out = files.withColumn("_video", F.coalesce(kind("video"), F.array().cast(STREAMS)))
    out = out.withColumn("_own", F.coalesce(seconds(F.col("meta.format.duration")), seconds(v["duration"]), F.lit(0.0)))
    if packets is None:
        out = out.withColumn("_packets", F.lit(None).cast("double"))
    else:
        out = out.join(packets.select("path", F.col("duration_s").alias("_packets")), "path", "left")
    duration = F.when(F.col("_own") <= LEAST_S, F.coalesce("_packets", F.lit(0.0))).otherwise(F.col("_own"))
    out = out.withColumn("duration_s", duration)
    error = (
        F.when(F.size("_video") == 0, "file contains no video stream")
        .when(F.col("duration_s") <= LEAST_S, "video is empty or unreadably short")
        .when(F.col("duration_s") > MOST_S, F.concat(F.lit("video is "), F.call_function("format_number", F.col("duration_s"), F.lit("0")), F.lit(f"s; max is {MOST_S}s")))
    )
    width, height = F.coalesce(v["width"], F.lit(0)), F.coalesce(v["height"], F.lit(0))
    return out.select(
        *[c for c in files.columns if c not in ("meta",)],
        F.left(F.coalesce("meta.format.format_name", F.lit("")), F.lit(40)).alias("container"),
        F.left(F.coalesce(v["codec_name"], F.lit("")), F.lit(40)).alias("codec"),
        "duration_s",
        fps(v["avg_frame_rate"]).alias("fps"),
        width.alias("width"),
        height.alias("height"),
        device_class(width, height).alias("device_class"),
        (F.size(F.coalesce(kind("audio"), F.array().cast(STREAMS))) > 0).alias("has_audio"),
        error.alias("error"),
    )


def moving(shifts: DataFrame, least: float = 1.5) -> DataFrame:
    """Shifts between frames (dx, dy) that are motion, to two places."""
    return shifts.where((F.abs("dx") > least) | (F.abs("dy") > least)).withColumn("dx", F.round("dx", 2)).withColumn("dy", F.round("dy", 2))
