"""Renderers, catalogue, sources, media kernels and the progress stream."""

import json

import numpy as np
from pyspark.sql import functions as F

from tracewright.functions import geometry
from tracewright.operators import catalog, media, render
from tracewright.sources import tables
from tracewright.streaming import progress

SCHEMA = """job_id string, title string, summary string, bug_type string, overall_confidence double, preconditions array<string>,
  steps array<struct<index:int,text:string,confidence:double,uncertainty_note:string,t_start_ms:long>>, observed struct<text:string,t_ms:long>,
  expected struct<text:string,basis:string,confidence:double>, environment struct<os:string,browser:string,app:string,device_class:string,resolution:string,theme:string>,
  manifestation struct<t_ms:long,confidence:double>, ambiguity array<string>, omitted array<struct<t_start_ms:long,t_end_ms:long,reason:string>>"""


def report(**changes):
    row = {
        "job_id": "j", "title": "Crash in shop", "summary": "Seen <twice>.", "bug_type": "crash", "overall_confidence": 0.55, "preconditions": ["Signed in"],
        "steps": [(1, 'Click "Save".', 0.9, "", 65_000), (12, "Wait.", 0.5, "hard to see", None)], "observed": ("It stops.", 65_000), "expected": None,
        "environment": ("unknown", "", None, "desktop", "1080x720", "dark"), "manifestation": (65_000, 0.7), "ambiguity": ["Blurry."], "omitted": [(61_000, 125_000, "2 actions")],
    } | changes
    return tuple(row.values())


def test_renderings(spark):
    df = spark.createDataFrame([report()], SCHEMA)
    md, txt, html, payload = df.select(render.markdown(), render.plain_text(), render.html(), render.issue_payload()).first()
    assert md.startswith("# Crash in shop\n\nSeen <twice>.\n\nBug type: crash | Overall confidence: 0.55\n\n## Preconditions\n\n- Signed in\n\n")
    assert '1. [1:05] Click "Save".\n12. Wait. (low confidence)\n   - Note: hard to see\n\n## Observed Result\n\nIt stops.\n(evidence at 1:05)' in md
    assert "- 1:01-2:05: 2 actions" in md and "At 1:05 (confidence 0.70)" in md
    assert ' 1. Click "Save". [1:05]\n12. Wait. (low confidence)\n    Note: hard to see' in txt and txt.isascii()
    assert "<p>Seen &lt;twice&gt;.</p>" in html and "Click &quot;Save&quot;. [1:05]</li>" in html and "theme" not in html.lower()
    assert json.loads(payload)["labels"] == ["bug", "recording:crash", "needs-verification"]


def test_renderings_without_optional_parts(spark):
    df = spark.createDataFrame([report(summary="", preconditions=[], steps=[], observed=("Nothing.", None), expected=("Fine.", "ui_text", 0.125), manifestation=None, ambiguity=[], omitted=[], overall_confidence=0.6)], SCHEMA)
    md, txt, labels = df.select(render.markdown(), render.plain_text(), render.issue_labels()).first()
    assert "Preconditions" not in md and "Manifestation" not in md and "Omitted" not in md
    assert "Fine.\n(basis: ui_text, confidence 0.12)" in md and "evidence at" not in txt
    assert labels == ["bug", "recording:crash"]


def test_small_expressions(spark):
    row = spark.range(1).select(
        geometry.stamp(F.lit(3_725_000)), render.severity(F.lit("crash")), render.severity(F.lit("odd")), geometry.upper_first(F.lit("cRASH now")), render.setting(F.lit(""), F.lit(None), F.lit("x")), geometry.region(F.lit(0), F.lit(0), F.lit(0), F.lit(9))
    ).first()
    assert tuple(row) == ("62:05", "1 - Critical", "3 - Medium", "Crash now", "x", "screen")
    sizes = spark.createDataFrame([(1920, 1080), (1080, 1920), (0, 5), (640, 427)], "w int, h int")
    assert [tuple(r) for r in sizes.select(*geometry.viewport(F.col("w"), F.col("h"))).collect()] == [(1080, 608), (608, 1080), (0, 0), (640, 428)]


def test_admission_and_lock(spark):
    up = spark.createDataFrame([(1, 1, "video/mp4", 10, "a"), (2, 1, "text/plain", 10, "b"), (3, 1, "video/mp4", 3 * 1024**3, "c"), (4, 9, "video/mp4", 1, "d" * 600)], "id int, project_id int, content_type string, byte_size long, filename string")
    got = {r["id"]: (r["status"], len(r["filename"])) for r in catalog.admitted(up, spark.createDataFrame([(1,)], "project_id int")).collect()}
    assert got == {1: (200, 1), 2: (415, 1), 3: (413, 1), 4: (404, 500)}
    revs = spark.createDataFrame([("r", 1, 10), ("r", 2, 20)], "report_id string, revision_id int, created_at int")
    edits = spark.createDataFrame([("r", 1, "late"), ("r", 2, "fine")], "report_id string, parent_revision_id int, who string")
    assert [r["who"] for r in catalog.accepted_edits(edits, catalog.heads(revs)).collect()] == ["fine"]


def test_artifacts_are_replaced_per_job(spark, tmp_path):
    root = str(tmp_path / "artifacts")
    frame = lambda rows: spark.createDataFrame(rows, "t_ms long, score double, change_frac double, lum double, org_id string, job_id string, stage string")
    tables.write_artifacts(frame([(1, 0.1, 0.0, 9.0, "o", "a", "s03"), (2, 0.1, 0.0, 9.0, "o", "b", "s03")]), root)
    tables.write_artifacts(frame([(7, 0.1, 0.0, 9.0, "o", "a", "s03")]), root)
    got = tables.artifacts(spark, root, tables.SAMPLE)
    assert sorted(tuple(r) for r in got.select("job_id", "t_ms").collect()) == [("a", 7), ("b", 2)]
    assert "PartitionFilters: [" in got.where("job_id = 'a'")._jdf.queryExecution().toString()
    (tmp_path / "x.bin").write_bytes(b"abc")
    blob = tables.blobs(spark, str(tmp_path), "*.bin").first()
    assert blob["length"] == 3 and blob["sha256"].startswith("ba7816bf")
    packets = spark.createDataFrame([("p", "1.5", "N/A"), ("p", "x", "2.25"), ("q", None, "bad")], "path string, pts_time string, dts_time string")
    assert {r["path"]: r["duration_s"] for r in tables.packet_duration(packets).collect()} == {"p": 2.25, "q": 0.0}


def test_pixel_kernels():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (48, 64)).astype(np.uint8)
    dx, dy = media.shift(image, np.roll(image, (3, -5), (0, 1)))
    assert (round(dx), round(dy)) == (-5, 3)
    assert media.blur(np.full((9, 9), 7, np.uint8)) == 0 and media.blur(image) > 100
    still = np.full((80, 80), 40, np.uint8)
    moved = still.copy()
    moved[30:33, 50:53] = 255
    x, y, conf = media.mover(still, moved)
    assert (x, y) == (51, 31) and 0.5 <= conf <= 0.9
    assert media.mover(still, still) is None and media.mover(still, 255 - still) is None
    assert media.region_change(still, moved, 51, 31, 2) > 0.5 and media.region_change(still, moved, 500, 500) == 0.0


def test_frames_are_sampled(spark):
    frame = b"P5\n8 6\n255\n" + bytes([9] * 48)
    df = spark.createDataFrame([("p", frame * 7), ("empty", b"")], "path string, content binary")
    got = media.frames_of(df, fps=10, sample_fps=5).orderBy("t_ms").collect()
    assert [(r["path"], r["t_ms"], r["lum"]) for r in got] == [("p", 0, 9.0), ("p", 200, 9.0), ("p", 400, 9.0), ("p", 600, 9.0)]


def test_vector_deltas(spark):
    df = spark.createDataFrame([("s", 1, [1.0, 2.0, 3.0]), ("s", 2, [1.0, 2.0, 3.0]), ("s", 3, [3.0, 2.0, 1.0]), ("t", 1, [0.0, 0.0, 0.0])], "k string, i int, v array<double>")
    got = {(r["k"], r["i"]): (r["score"], r["change_frac"]) for r in media.series_deltas(df, "k", "i", "v", 0.5).collect()}
    assert got == {("s", 1): (0.0, 0.0), ("s", 2): (0.0, 0.0), ("s", 3): (round(0.6 * 2 + 0.4 * 2 / 3, 4), round(2 / 3, 4)), ("t", 1): (0.0, 0.0)}


def test_progress_stream_keeps_the_newest_state(spark, tmp_path):
    rows = [("a", "s01_validate", "running", 0.0, "2024-01-01 00:00:01"), ("a", "s12_finalize", "awaiting_review", 0.9, "2024-01-01 00:00:09"), ("b", "s02_normalize", "running", 0.1, "2024-01-01 00:00:05")]
    spark.createDataFrame(rows, "job_id string, stage string, status string, pct double, at string").write.json(str(tmp_path / "in"))
    out = progress.run_to_end(progress.messages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {r["job_id"]: (r["status"], r["ended"]) for r in out.collect()} == {"a": ("awaiting_review", True), "b": ("running", False)}
    s = spark.range(1).select(progress.next_stage(F.lit("s07_targets")), progress.next_stage(F.lit("s12_finalize")), progress.stage_percent(F.lit("s03_segment"))).first()
    assert tuple(s) == ("s09_bug", None, round(2 / 11, 4))
