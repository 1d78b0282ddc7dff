"""Recordings as files: many tasks for one medium, read by path and by range.

Spark moves paths, frame numbers and offsets; pixels are read where they are
needed, by the file system that the path names, and never become a column.
``ranges`` cuts every file into stretches of whole samples.  ``sampled``
measures each stretch on its own; it starts one sample early, so that the first
difference of a stretch is the one that a single pass would have made.
``recognised`` deals windows by stretch and sorts them by frame, so that one
forward read serves all windows of a stretch.

A format says how to find and read frames in an open file.  ``Pgm`` (binary,
concatenated) reads headers and skips pixels; other formats bring a class with
the same two methods.

Edge cases: an empty or unreadable file has no frames; trailing bytes that are
no whole frame are ignored; frames of one file may differ in size (a change of
size starts anew, as a first frame does); a window behind the end of its file
gives a row that says so; an engine that fails gives a row that names the error
and hands over to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.media import MEASURED, measured

#: Frames of a stretch: some seconds of work.
STRETCH = 2_000
#: Bytes of a header that are read at first.
HEAD = 64


def opened(path: str):
    """A file of any file system that the workers know, for random access."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(at)


class Pgm:
    """Concatenated gray pictures of eight bits."""

    def head(self, f: BinaryIO, at: int) -> tuple[int, int, int] | None:
        """(width, height, where the pixels start) of the frame at an offset."""
        f.seek(at)
        raw = f.read(HEAD)
        if raw[:2] != b"P5":
            return None
        fields, pos = [], 2
        while len(fields) < 3:
            while raw[pos : pos + 1].isspace():
                pos += 1
            end = pos
            while raw[end : end + 1].isdigit():
                end += 1
            if end == pos:
                return None
            fields.append(int(raw[pos:end]))
            pos = end
        return fields[0], fields[1], at + pos + 1

    def index(self, f: BinaryIO, size: int) -> Iterator[int]:
        """Offsets of the whole frames; pixels are skipped."""
        at = 0
        while at < size and (head := self.head(f, at)) is not None:
            behind = head[2] + head[0] * head[1]
            if behind > size:
                return
            yield at
            at = behind

    def frame(self, f: BinaryIO, at: int) -> tuple[np.ndarray, int]:
        """The frame at an offset, and the offset behind it."""
        w, h, pixels = self.head(f, at)
        f.seek(pixels)
        return np.frombuffer(f.read(w * h), np.uint8).reshape(h, w), pixels + w * h


RANGE = "path string, stretch long, first long, behind long, start long, at long"


def ranges(files: DataFrame, step: int = 1, per_task: int = STRETCH, form: Pgm | None = None) -> DataFrame:
    """Stretches of files (a column ``path``): frames [first, behind), and the offset ``at`` of frame ``start``.

    Stretches begin at multiples of ``step``; ``start`` is one step earlier.
    """
    form, length = form or Pgm(), max(1, per_task // step) * step

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with opened(path) as f:
                    offsets: dict[int, int] = {}
                    n = 0
                    for n, at in enumerate(form.index(f, f.size()), 1):
                        i = n - 1
                        if i % length in (0, length - step) or i == 0:
                            offsets[i] = at
                for first in range(0, n, length):
                    start = max(0, first - step)
                    rows.append((path, first // length, first, min(n, first + length), start, offsets[start]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in RANGE.split(", ")])

    return files.select("path").mapInArrow(kernel, RANGE)


def sampled(stretches: DataFrame, fps: float, sample_fps: float = 5.0, most_side: int = 0, form: Pgm | None = None) -> DataFrame:
    """What ``media.frames_of`` gives for whole files, from ``ranges(files, step)`` with the step of these rates."""
    form, step = form or Pgm(), step_of(fps, sample_fps)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as f:

                    def frames() -> Iterator[tuple[int, np.ndarray]]:
                        at = r["at"]
                        for i in range(r["start"], r["behind"]):
                            if i % step:
                                w, h, pixels = form.head(f, at)
                                at = pixels + w * h
                            else:
                                frame, at = form.frame(f, at)
                                yield i, frame

                    yield from measured(r["path"], frames(), fps, most_side, r["first"])

    # A row is a file to read: dealt out one by one.
    n = stretches.sparkSession.sparkContext.defaultParallelism
    return stretches.repartition(max(n, 200), "path", "stretch").mapInArrow(kernel, MEASURED)


def step_of(fps: float, sample_fps: float) -> int:
    return max(1, round(fps / sample_fps))


@dataclass(frozen=True)
class Engine:
    """A recogniser: (text, confidence, x, y, w, h) of the lines of a picture."""

    name: str
    lines: Callable[[np.ndarray], list[tuple]]
    #: Pictures whose longer side is below this are doubled, and their boxes halved.
    double_below: int = 0


def read_by(engine: Engine, picture: np.ndarray) -> list[tuple]:
    if max(picture.shape) >= engine.double_below:
        return [tuple(x) for x in engine.lines(picture)]
    large = picture.repeat(2, 0).repeat(2, 1)
    return [(text, conf, *(int(v / 2) for v in box)) for text, conf, *box in engine.lines(large)]


RECOGNISED = "job_id string, event_id string, line_no long, text string, confidence double, box_x long, box_y long, box_w long, box_h long, engine string, failure string"
KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4, pa.string(), pa.string()]


def recognised(windows: DataFrame, stretches: DataFrame, fps: float, engines: list[Engine], per_task: int = STRETCH, form: Pgm | None = None) -> DataFrame:
    """Lines in windows (job_id, event_id, path, t_ms, crop) of files cut by ``ranges(files, 1, per_task)``.

    Engines are tried in turn until one does not fail.  Rows without ``failure``
    are lines; the others say which engine failed of what, or ``no frame``.
    """
    form = form or Pgm()
    frame = F.floor(F.col("t_ms") * fps / 1000 + 1e-9).cast("long")
    asked = windows.select(F.col("job_id").cast("string").alias("job_id"), F.col("event_id").cast("string").alias("event_id"), "path", frame.alias("frame"), "crop").withColumn("stretch", F.floor(F.col("frame") / per_task).cast("long"))
    met = asked.join(stretches.select("path", "stretch", "first", "behind", F.col("at").alias("_at"), "start"), ["path", "stretch"], "left")
    dealt = met.repartition("path", "stretch").sortWithinPartitions("path", "stretch", "frame")

    def lines_of(r: dict, picture: np.ndarray | None) -> list[tuple]:
        ids = (r["job_id"], r["event_id"])
        if picture is None or not picture.size:
            return [(*ids, *[None] * 8, "no frame")]
        out = []
        for engine in engines:
            try:
                found = read_by(engine, picture)
            except Exception as error:  # noqa: BLE001 - unreadable text degrades a report; the row counts it
                out.append((*ids, *[None] * 7, engine.name, type(error).__name__))
                continue
            return out + [(*ids, n, *line, engine.name, None) for n, line in enumerate(found)]
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, place, i, at, shown = None, None, 0, 0, None
        try:
            for batch in batches:
                rows: list[tuple] = []
                for r in batch.to_pylist():
                    if r["behind"] is None or not r["first"] <= r["frame"] < r["behind"]:
                        rows += lines_of(r, None)
                        continue
                    if place != (r["path"], r["stretch"]):
                        if f is not None:
                            f.close()
                        f, place, i, at, shown = opened(r["path"]), (r["path"], r["stretch"]), r["start"], r["_at"], None
                    while i <= r["frame"]:  # forward only; frames between windows are skipped by their headers
                        if i == r["frame"]:
                            shown, at = form.frame(f, at)
                        else:
                            w, h, pixels = form.head(f, at)
                            at = pixels + w * h
                        i += 1
                    c = r["crop"]
                    rows += lines_of(r, shown[c["y0"] : c["y1"], c["x0"] : c["x1"]])
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(KINDS)], names=[c.split()[0] for c in RECOGNISED.split(", ")])
        finally:
            if f is not None:
                f.close()

    return dealt.mapInArrow(kernel, RECOGNISED)


def failures(rows: DataFrame) -> DataFrame:
    """(engine, failure, n): what went wrong, and how often."""
    return rows.where(F.col("failure").isNotNull()).groupBy(F.coalesce("engine", F.lit("")).alias("engine"), "failure").agg(F.count(F.lit(1)).alias("n"))


def written(frames: DataFrame, folder: str) -> DataFrame:
    """Write frames (name, frame, width, height, pixels) as one file for each name; returns its paths.

    A file is written by one task, frame by frame, aside and then renamed, so an attempt that is lost leaves no part of a file.
    """
    from uuid import uuid4

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out, aside = None, None, ""

        def closed() -> pa.RecordBatch:
            out.close()
            system.move(aside, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["name"] != name:
                    if out is not None:
                        yield closed()
                    name, aside = r["name"], f"{root}/.{uuid4().hex}"
                    out = system.open_output_stream(aside)
                out.write(f"P5\n{r['width']} {r['height']}\n255\n".encode() + r["pixels"])
        if out is not None:
            yield closed()

    return frames.select("name", "frame", "width", "height", "pixels").repartition("name").sortWithinPartitions("name", "frame").mapInArrow(kernel, "path string")
