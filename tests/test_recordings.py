"""Media read by range, recognition with engines in turn, and blobs of pixels."""

import numpy as np
import pytest

from tracewright.operators import media, recordings
from tracewright.operators.recordings import Engine


def slow_largest(mask):
    left = set(zip(*map(np.ndarray.tolist, np.nonzero(mask))))
    best = []
    for seed in sorted(left):
        if seed not in left:
            continue
        left.remove(seed)
        front, blob = [seed], [seed]
        while front:
            y, x = front.pop()
            for at in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if at in left:
                    left.remove(at)
                    front.append(at)
                    blob.append(at)
        if len(blob) > len(best):
            best = blob
    return sorted(best)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.2, 0.4, 0.6, 0.95, 1.0])
def test_largest_blob_equals_a_pixel_walk(share):
    draw = np.random.default_rng(int(share * 100))
    for shape in ((1, 1), (1, 40), (40, 1), (13, 17), (30, 30)):
        for _ in range(6):
            mask = draw.random(shape) < share
            got, want = media._largest(mask), slow_largest(mask)
            assert (got is None and not want) or sorted(map(tuple, got.tolist())) == want
    spiral = np.zeros((41, 41), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    assert len(media._largest(spiral)) == spiral.sum()


def pictures(n, seed=0, h=12, w=16):
    draw = np.random.default_rng(seed)
    out = [draw.integers(0, 256, (h, w)).astype(np.uint8)]
    for _ in range(n - 1):
        out.append(np.where(draw.random((h, w)) < 0.2, draw.integers(0, 256, (h, w)), out[-1]).astype(np.uint8))
    return out


def pgm(frames):
    return b"".join(f"P5\n{f.shape[1]} {f.shape[0]}\n255\n".encode() + f.tobytes() for f in frames)


@pytest.mark.parametrize("per_task", [1, 7, 10, 1000])
def test_stretches_of_a_file_equal_one_pass(spark, tmp_path, per_task):
    files = {"a": pgm(pictures(53)), "b": pgm(pictures(9, 1)) + b"P5\n16 12\n255\ncut off", "mixed": pgm([*pictures(4, 2), *pictures(5, 3, 6, 8)]), "empty": b"", "none": b"GIF89a"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "path string")
    step = recordings.step_of(10, 5)
    cut = recordings.ranges(paths, step, per_task)
    got = recordings.sampled(cut, 10, 5)
    whole = spark.createDataFrame([(f"file://{tmp_path}/{n}", bytearray(c[: c.rindex(b"P5")] if n == "b" else c)) for n, c in files.items()], "path string, content binary")
    want = media.frames_of(whole, 10, 5)
    key = lambda r: (r["path"], r["t_ms"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    stretches = cut.collect()
    assert sum(r["behind"] - r["first"] for r in stretches) == 53 + 9 + 9 and (per_task != 7 or len(stretches) > 9)


def test_engines_in_turn_doubling_and_failures(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    frames = [np.full((40, 60), i, np.uint8) for i in range(30)]
    (tmp_path / "r").write_bytes(pgm(frames))
    crop = (10, 5, 30, 25)
    rows = [("j", f"e{i}", path, t, crop) for i, t in enumerate([2900, 0, 100, 100, 1500, 3000, 700])] + [("j", "gone", f"file://{tmp_path}/r", 99_999, crop), ("j", "flat", path, 0, (5, 5, 5, 5)), ("k", "other", "file:///not/there", 0, crop)]
    windows = spark.createDataFrame(rows, "job_id string, event_id string, path string, t_ms long, crop struct<x0:int,y0:int,x1:int,y1:int>")

    def first(picture):
        if picture[0, 0] == 15:
            raise ValueError("unreadable")
        return [(f"frame {picture[0, 0]}", 0.9, 4, 6, *picture.shape[::-1])] if picture[0, 0] != 7 else 1 / 0

    def second(picture):
        return [("two", 0.5, 0, 0, *picture.shape)] if picture[0, 0] != 7 else {}["x"]

    stretches = recordings.ranges(spark.createDataFrame([(path,)], "path string"), 1, 8)
    got = recordings.recognised(windows, stretches, 10, [Engine("first", first, 1200), Engine("second", second)], 8)
    rows = {(r["event_id"], r["engine"]): r for r in got.collect()}
    for event, n in (("e0", 29), ("e1", 0), ("e2", 1), ("e3", 1)):
        r = rows[event, "first"]
        assert (r["text"], r["box_x"], r["box_y"], r["box_w"], r["box_h"], r["failure"]) == (f"frame {n}", 2, 3, 20, 20, None)
    assert rows["e4", "first"]["failure"] == "ValueError" and rows["e4", "second"]["text"] == "two" and rows["e4", "second"]["box_w"] == 20
    assert rows["e6", "first"]["failure"] == "ZeroDivisionError" and rows["e6", "second"]["failure"] == "KeyError"
    counted = {(r["engine"], r["failure"]): r["n"] for r in recordings.failures(got).collect()}
    assert counted == {("", "no frame"): 4, ("first", "ValueError"): 1, ("first", "ZeroDivisionError"): 1, ("second", "KeyError"): 1}
    assert recordings.recognised(windows.limit(0), stretches, 10, []).count() == 0
