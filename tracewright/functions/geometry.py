"""Geometry, time and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x, y, w, h), 0 where they are empty."""
    wide = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = wide * high
    either = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def distance(px: Column, py: Column, box: Column) -> Column:
    """From a point to the centre of a box."""
    return F.sqrt(F.pow(px - (box["x"] + box["w"] / 2), 2) + F.pow(py - (box["y"] + box["h"] / 2), 2))


def region(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Name of a place on a 3x3 grid."""
    fx, fy = F.try_divide(x, width), F.try_divide(y, height)
    row = F.when(fy < 0.25, "top").when(fy > 0.75, "bottom").otherwise("middle")
    col = F.when(fx < 0.33, "left").when(fx > 0.66, "right").otherwise("center")
    return (
        F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), "screen")
        .when((row == "middle") & (col == "center"), "center of the screen")
        .when(row == "middle", F.concat(col, F.lit(" side of the screen")))
        .when(col == "center", F.concat(row, F.lit(" of the screen")))
        .otherwise(F.concat(row, F.lit(" "), col, F.lit(" of the screen")))
    )


def viewport(width: Column, height: Column, most: int = 1080) -> tuple[Column, Column]:
    """Size after scaling the longer side to ``most``, the other one to an even number."""
    none = (F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0)
    nw, nh = F.least(F.lit(most), width), F.least(F.lit(most), height)
    even = lambda a, b, c: (F.bround(a * b / c / 2) * 2).cast("int")
    wide = width >= height
    return (
        F.when(none, 0).when(wide, nw).otherwise(even(width, nh, height)).cast("int"),
        F.when(none, 0).when(wide, even(height, nw, width)).otherwise(nh).cast("int"),
    )


def crop(x: Column, y: Column, frame_w: Column, frame_h: Column, w: int = 460, h: int = 220) -> Column:
    """Window around a point, clamped to the frame."""
    x0 = F.greatest(F.lit(0), F.least(x - w // 2, frame_w - w))
    y0 = F.greatest(F.lit(0), F.least(y - h // 2, frame_h - h))
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), F.least(frame_w, x0 + w).cast("int").alias("x1"), F.least(frame_h, y0 + h).cast("int").alias("y1"))


def stamp(ms: Column) -> Column:
    """m:ss"""
    return F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"))


def two_places(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.00"))


def no_place(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0"))


def one_place(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0"))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def upper_first(text: Column) -> Column:
    """First letter upper-case, the others lower-case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def url_quoted(text: Column) -> Column:
    """Percent-encoding of a path segment: a slash and unreserved characters stay."""
    out = F.url_encode(text)
    for encoded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def timeline_percent(t_ms: Column, duration_ms: Column) -> Column:
    """Place on a timeline in percent of its length, null without a length."""
    return F.round(F.try_divide(100.0 * t_ms, duration_ms), 4)


def confidence_class(confidence: Column) -> Column:
    """ok, warn or bad."""
    return F.when(confidence >= 0.8, "ok").when(confidence >= 0.6, "warn").otherwise("bad")
