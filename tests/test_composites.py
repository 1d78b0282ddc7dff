"""Union of detectors, bug localisation, steps with evidence, scores, contract, catalogue writes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import geometry, text
from tracewright.operators import catalog, media, probe, report, scoring, sequence, steps, targets
from tracewright.operators import events as ev
from tracewright.sources import tables

BLOCK = "job_id string, frame_id string, block_no long, t_ms long, text string, x long, y long, w long, h long, confidence double, role string"
FRAME = "job_id string, frame_id string, t_ms long, segment_idx long, seq long"
SEG = "job_id string, idx long, start_ms long, end_ms long, transition_type string"
MOTION = "job_id string, seq long, t_ms long, dx double, dy double"
CURSOR = "job_id string, seq long, t_ms long, x double, y double"
SAMPLE = "job_id string, i long, t_ms long, score double, change_frac double, lum double"


def test_double_quotes_stay(spark):
    df = spark.createDataFrame([('Save "draft" now',), ("‘Save’ “draft”",)], "t string")
    assert [r[0] for r in df.select(text.clean(F.col("t"))).collect()] == ['Save "draft" now', "Save draft"]


def test_detectors_are_united_in_order(spark):
    segs = spark.createDataFrame([("j", 0, 0, 5000, "start"), ("j", 1, 5000, 9000, "nav"), ("j", 2, 9000, 12000, "dialog")], SEG)
    motions = spark.createDataFrame([("j", 0, 4900, 0.0, 0.5), ("j", 1, 7000, 0.0, 9.0)], MOTION)
    cursor = spark.createDataFrame([("j", 0, 4700, 100.0, 100.0)], CURSOR)
    frames = spark.createDataFrame([("j", "f0", 350, 0, 0), ("j", "f1", 5350, 1, 1), ("j", "f2", 9350, 2, 2)], FRAME)
    blocks = spark.createDataFrame([("j", "f0", 0, 350, "Old", 0, 0, 9, 9, 0.9, "body"), ("j", "f1", 1, 5350, "shop.example.com", 0, 10, 90, 20, 0.9, "url_bar"), ("j", "f1", 2, 4800, "Log in", 60, 90, 80, 20, 0.9, "button_like")], BLOCK)
    got = ev.detected(segs, motions, cursor, blocks, frames).orderBy("seq").collect()
    assert [(r["seq"], r["type"], r["t_start_ms"], r["target"], r["signals"]) for r in got] == [
        (0, "form_submit", 4700, "", ["cursor_dwell", "transition"]),
        (1, "navigate", 5000, "shop.example.com", ["segment_transition"]),
        (2, "scroll", 7000, "", ["global_motion"]),
        (3, "dialog_open", 9000, "", ["localized_overlay"]),
    ]
    assert got[0]["button"] == "Log in"


def test_anomalies_in_order_and_the_bug_of_each_job(spark):
    samples = spark.createDataFrame([("j", i, 200 * i, 0.001, 0.0, 3.0 if i == 5 else 99.0) for i in range(80)], SAMPLE)
    events = spark.createDataFrame([("j", 900, 1000), ("j", 100, 1200)], "job_id string, t_start_ms long, t_end_ms long")
    blocks = spark.createDataFrame([("j", "f", 0, 1000, "Payment failed today", 0, 0, 9, 9, 0.5, "body")], BLOCK)
    found = ev.anomalies(blocks, samples, events)
    assert [(r["type"], r["t_ms"]) for r in found.orderBy("ord").collect()] == [("error_text", 1000), ("blank_screen", 1000), ("stall", 1400)]
    jobs = spark.createDataFrame([("j",), ("calm",)], "job_id string")
    got = {r["job_id"]: r for r in ev.localized(jobs, found).collect()}
    assert (got["j"]["found"], got["j"]["bug_type"], got["j"]["observed"], got["j"]["confidence"]) == (True, "functional", 'The UI displays the error text: "Payment failed today"', 0.7)
    assert [c["type"] for c in got["j"]["candidates"]] == ["blank_screen", "stall"]
    assert (got["calm"]["found"], got["calm"]["bug_type"], got["calm"]["confidence"], got["calm"]["candidates"]) == (False, "unknown", 0.0, [])
    said = spark.range(1).select(ev.observed_text(F.lit("stall"), F.lit(None), F.lit(14400)), ev.observed_text(F.lit("odd"), F.lit(None), F.lit(None))).first()
    assert said[0].startswith("The screen remains completely unchanged for 14.4s") and said[1] == "An unexpected UI state is visible."


def test_nearest_is_the_earliest_of_equals(spark):
    left = spark.createDataFrame([("j", 0, 100), ("j", 1, 150), ("j", 2, 900), ("none", 3, 5)], "job_id string, n int, t long")
    right = spark.createDataFrame([("j", 0, 200, "b"), ("j", 1, 100, "c"), ("j", 2, 100, "d"), ("j", 3, 800, "e"), ("j", 4, 1000, "f")], "job_id string, seq int, t_ms long, name string")
    got = {r["n"]: r["hit"] for r in sequence.nearest(left, right, "job_id", "t", "t_ms", "seq", "name", "hit").collect()}
    # 150 is as far from 100 as from 200: the smaller seq; 900 likewise from 800 and 1000
    assert got == {0: "c", 1: "b", 2: "e", 3: None}


EVENT = "job_id string, seq long, type string, t_start_ms long, t_end_ms long, x long, y long, target string, direction string, magnitude_px double, final_text string, confidence double"


def test_reproduction_ends_at_the_bug_and_starts_with_an_entry(spark):
    rows = [("j", 0, "click", 100, 200, 10, 10, "Save", None, None, None, 0.85), ("j", 1, "type", 2000, 2100, None, None, "", None, None, "hello", 0.85), ("j", 2, "navigate", 2500, 2800, None, None, "shop.example.com", None, None, None, 0.8), ("j", 3, "swirl", 2900, 3000, None, None, "", None, None, None, 0.5), ("j", 4, "click", 9000, 9100, None, None, "Late", None, None, None, 0.9), ("j", 5, "click", 9500, 9700, None, None, "Later", None, None, None, 0.9)]
    events = spark.createDataFrame(rows, EVENT)
    frames = spark.createDataFrame([("j", "f0", 350, 0, 0), ("j", "f1", 2400, 1, 1)], FRAME)
    bugs = spark.createDataFrame([("j", 3000)], "job_id string, t_ms long")
    made, omitted = steps.reproduction(events, frames, bugs, 1080, 720)
    assert [(r["t_start_ms"], r["t_end_ms"], r["reason"]) for r in omitted.collect()] == [(9000, 9700, "2 action(s) after the bug manifestation are not needed to reproduce")]
    blocks = spark.createDataFrame([], BLOCK)
    jobs = spark.createDataFrame([("j", "mobile"), ("empty", "desktop")], "job_id string, device_class string")
    got = steps.with_entry(made, steps.entry_steps(jobs, blocks, frames)).orderBy("job_id", "idx").collect()
    assert [(r["job_id"], r["key"], r["text"]) for r in got] == [
        ("empty", "s1", "Open the application shown at the start of the recording."),
        ("j", "s1", "Open the app shown at the start of the recording."),
        ("j", "s2", 'Click "Save".'),
        ("j", "s3", 'Type "hello" into the field.'),
        ("j", "s4", 'Go to "shop.example.com".'),
        ("j", "s5", "Perform the next visible interaction."),
    ]
    assert [r["evidence"][0]["frame_id"] for r in got] == ["", "f0", "f0", "f1", "f1", "f1"]
    assert got[5]["uncertainty_note"] == "action type could not be classified"


def test_scores_of_validated_steps(spark):
    link = "array<struct<frame_id:string,t_start_ms:bigint,t_end_ms:bigint>>"
    rows = [("j", 1, "s1", "observed", 0.8, "", [("f0", 0, 350)]), ("j", 2, "s2", "observed", 0.9, "", [("lost", 5000, 5100)]), ("j", 3, "s3", "inferred", 0.7, "", [("", 1000, 9000)])]
    made = spark.createDataFrame([(*r[:3], "Do it.", "click", *r[3:]) for r in rows], f"job_id string, idx long, key string, text string, action_type string, grounding string, confidence double, uncertainty_note string, evidence {link}")
    frames = spark.createDataFrame([("j", "f0", 350, 0, 0)], FRAME)
    blocks = spark.createDataFrame([("j", "f0", 0, 350, "t", 0, 0, 9, 9, 0.8, "body"), ("j", "f0", 1, 350, "t", 0, 0, 9, 9, 0.6, "body")], BLOCK)
    jobs = spark.createDataFrame([("j", ["blurry"], 0.7, "visible_convention", 0.5, 18000)], "job_id string, flags array<string>, bug double, basis string, expected_confidence double, duration_ms long")
    final, scores = scoring.scored(made, frames, blocks, jobs)
    got = final.orderBy("idx").collect()
    want, before = [], None
    for c, seen in ((0.8, 0.7), (0.9, 0.4), (0.7, 0.7)):
        raw = round(min(1.0, (0.5 * c + 0.3 * seen + 0.2 * 0.75) * 0.85), 3)
        before = raw if before is None else round(raw * (0.8 + 0.2 * before), 3)
        want.append(before)
    assert [r["confidence"] for r in got] == want
    assert (got[1]["grounding"], got[1]["evidence"], got[1]["uncertainty_note"]) == ("assumed", [], "no direct frame evidence for this step")
    s = scores.first()
    assert s["coverage"] == 0.5 and s["ocr"] == 0.7 and s["expected_result"] == 0.5 and s["chronology"] == []
    assert s["overall"] == round(0.35 * sorted(want)[1] + 0.25 * 0.7 + 0.2 * 0.5 + 0.2 * 0.7, 3)


def test_contract_rules(spark):
    schema = "job_id string, title string, bug_type string, overall_confidence double, steps array<struct<index:int,text:string,confidence:double,grounding:string>>, observed struct<text:string>, expected struct<text:string,basis:string,confidence:double>"
    good = spark.createDataFrame([("j", "Crash in shop", "crash", 0.5, [(1, "Click.", 0.9, "inferred")], ("It stops.",), None)], schema)
    names, made = good.columns, good
    assert report.violations(made).count() == 0
    bad = made.withColumn("title", F.lit(None).cast("string")).withColumn("steps", F.transform("steps", lambda s: s.withField("text", F.lit(" ")).withField("confidence", F.lit(1.5))))
    rules = {(r["path"], r["rule"]) for r in report.violations(bad).collect()}
    assert {("title", "required"), ("steps[0].text", "must not be empty"), ("steps[0].confidence", "outside of 0 to 1")} <= rules
    out = json.loads(report.exported(good.select(*names)).first()["body"])
    assert out["schema_version"] == "1.0" and out["title"] == good.first()["title"]


def test_targets_from_a_crop(spark):
    events = spark.createDataFrame([("j", "e1", "click", 1000, 500, 300), ("j", "e2", "click", 1000, None, None), ("j", "e3", "tap", 50, 5, 5)], "job_id string, event_id string, type string, t_start_ms long, x long, y long")
    none = spark.createDataFrame([], BLOCK)
    lines = spark.createDataFrame([("j", "e1", 0, "wll ull", 0.9, 200, 100, 20, 20), ("j", "e1", 1, "Buy now", 0.9, 200, 100, 60, 20), ("j", "e1", 2, "Help", 0.3, 220, 100, 20, 20)], "job_id string, event_id string, line_no long, text string, confidence double, box_x long, box_y long, box_w long, box_h long")
    got = targets.resolved(events, none, lines)
    assert [tuple(r) for r in got.collect()] == [("j", "e1", "Buy now")]
    asked = {r["event_id"]: r for r in targets.crops(events, got.where("false"), 1080, 720).collect()}
    assert set(asked) == {"e1", "e3"} and asked["e3"]["t_ms"] == 0 and asked["e1"]["t_ms"] == 880
    assert tuple(asked["e1"]["crop"]) == (270, 190, 730, 410)
    assert {r["event_id"]: r["target"] for r in targets.with_targets(events, got).collect()} == {"e1": "Buy now", "e2": "", "e3": ""}


def test_probe_rules(spark):
    def one(streams, **fmt):
        return json.dumps({"format": fmt, "streams": streams})

    v = {"codec_type": "video", "codec_name": "h264", "avg_frame_rate": "30000/1001", "width": 720, "height": 1600}
    rows = [("ok", one([v], duration="12.5", format_name="mov")), ("mute", one([{"codec_type": "audio"}], duration="3")), ("short", one([v], duration="0.2")), ("packets", one([v])), ("long", one([v], duration="2701.4")), ("junk", "no json")]
    packets = spark.createDataFrame([("packets", 7.5)], "path string, duration_s double")
    got = {r["path"]: r for r in probe.validated(probe.parsed(spark.createDataFrame(rows, "path string, probe string")), packets).collect()}
    assert (got["ok"]["error"], got["ok"]["device_class"], round(got["ok"]["fps"], 2), got["ok"]["duration_s"]) == (None, "mobile", 29.97, 12.5)
    assert got["mute"]["error"] == got["junk"]["error"] == "file contains no video stream"
    assert got["short"]["error"] == "video is empty or unreadably short" and got["long"]["error"] == "video is 2701s; max is 2700s"
    assert got["packets"]["error"] is None and got["packets"]["duration_s"] == 7.5
    tool = {"a": one([v], duration="5")}.__getitem__
    read = probe.probed(spark.createDataFrame([("a",), ("gone",)], "path string"), tool).collect()
    assert {r["path"]: r["probe"] is None for r in read} == {"a": False, "gone": True}


def test_edits_of_steps(spark):
    s = spark.createDataFrame([("j", i, f"Step {i}.", 0.9 - i / 10, [i]) for i in (1, 2, 3, 4)], "job_id string, idx long, text string, confidence double, evidence array<int>")
    merge = lambda *idx: [(r["new_idx"], r["text"], r["evidence"]) for r in catalog.edited(s, spark.createDataFrame([("j", i) for i in idx], "job_id string, idx long")).orderBy("new_idx").collect()]
    assert merge(2) == [(1, "Step 1.", [1]), (2, "Step 2, then step 3.", [2, 3]), (3, "Step 4.", [4])]
    assert merge(1, 2, 3) == [(1, "Step 1, then step 2.", [1, 2]), (2, "Step 3, then step 4.", [3, 4])]
    assert len(merge(4)) == 4


def test_reports_are_saved_once_a_head(spark):
    reports = spark.createDataFrame([("r", "v1", "draft"), ("q", "w1", "draft")], "report_id string, head_revision_id string, status string")
    edits = spark.createDataFrame([("r", "v2", "v1", 1, ""), ("r", "v3", "v1", 2, ""), ("q", "w2", "w0", 1, "")], "report_id string, revision_id string, parent_revision_id string, created_at long, change_note string")
    new, moved = catalog.saved(edits, reports)
    assert [r["revision_id"] for r in new.collect()] == ["v2"]
    assert {tuple(r) for r in moved.select("report_id", "head_revision_id", "status").collect()} == {("r", "v2", "in_review"), ("q", "w1", "draft")}


def test_roles(spark):
    asks = spark.createDataFrame([("o", "a", "editor"), ("o", "b", "editor"), ("o", "c", "viewer")], "org_id string, user_id string, minimum string")
    members = spark.createDataFrame([("o", "a", "admin"), ("o", "b", "viewer")], "org_id string, user_id string, role string")
    assert {r["user_id"]: r["code"] for r in catalog.allowed(asks, members).collect()} == {"a": 200, "b": 403, "c": 404}


def test_row_sink_replaces_only_its_jobs(spark, tmp_path):
    path = str(tmp_path / "rows")
    tables.replace_jobs(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "job_id string, v int"), path, 2)
    tables.replace_jobs(spark.createDataFrame([("b", 9)], "job_id string, v int"), path, 2)
    tables.replace_jobs(spark.createDataFrame([("c", 4)], "job_id string, v int"), path, 2)
    assert sorted((r["job_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9), ("c", 4)]
    tables.append_rows(spark.createDataFrame([(1,)], "v int"), str(tmp_path / "log"))
    tables.append_rows(spark.createDataFrame([(2,)], "v int"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 and tables.listing(spark, str(tmp_path / "log"), "*.parquet").where("length > 0").count() >= 2


def test_pictures():
    gray = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert np.array_equal(media.shrunk(gray, 0), gray) and media.shrunk(gray, 4).shape == (4, 4)
    assert media.shrunk(gray, 4)[0, 0] == round((0 + 1 + 8 + 9) / 4)
    assert media.shrunk(np.full((9, 6), 7, np.uint8), 4).tolist() == [[7] * 3] * 4
    assert media.change_score(gray, gray) == (0.0, 0.0)
    score, share = media.change_score(np.zeros((4, 4), np.uint8), np.full((4, 4), 255, np.uint8))
    assert share == 1.0 and score > 0.9
    content = b"P5\n2 2\n255\n" + bytes(4) + b"P5\n2 2\n255\n" + bytes([9] * 4)
    assert media.frame_at(media.pgm_frames, content, 10, 100)[0, 0] == 9 and media.frame_at(media.pgm_frames, content, 10, 900) is None


def test_recognition_failures_give_no_lines(spark):
    content = b"P5\n4 4\n255\n" + bytes(16)
    blobs = spark.createDataFrame([("p", bytearray(content))], "path string, content binary")
    windows = spark.createDataFrame([("j", "e", "p", 0, (0, 0, 2, 2)), ("j", "late", "p", 9000, (0, 0, 2, 2))], "job_id string, event_id string, path string, t_ms long, crop struct<x0:int,y0:int,x1:int,y1:int>")
    good = media.recognised(windows, blobs, 10, lambda g: [("seen", 0.9, 0, 0, *g.shape)]).collect()
    assert [(r["event_id"], r["text"], r["box_w"]) for r in good] == [("e", "seen", 2)]
    assert media.recognised(windows, blobs, 10, lambda g: 1 / 0).count() == 0 and media.recognised(windows, blobs, 10, None).count() == 0
    box = spark.range(1).select(F.array(F.struct(F.lit(5).alias("x"), F.lit(9).alias("y")), F.struct(F.lit(1).alias("x"), F.lit(30).alias("y"))).alias("p")).select(media.polygon_box(F.col("p"))).first()[0]
    assert tuple(box) == (1, 9, 4, 21)


@pytest.mark.parametrize(("plain", "quoted"), [("a b/c", "a%20b/c"), ("100%~*+", "100%25~%2A%2B"), ("é", "%C3%A9")])
def test_url_quoting(spark, plain, quoted):
    assert spark.range(1).select(geometry.url_quoted(F.lit(plain))).first()[0] == quoted
