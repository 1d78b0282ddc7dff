"""Detectors, steps and scores over small recordings."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import events as ev
from tracewright.operators import scoring, segmentation, steps


def samples(spark, rows):
    return spark.createDataFrame([("j", i, *r) for i, r in enumerate(rows)], "job_id string, i long, t_ms long, score double, change_frac double, lum double")


def quiet(n=300):
    return [[200 * i, 0.001, 0.0, 120.0] for i in range(n)]


def test_threshold_has_a_floor_and_adapts(spark):
    assert segmentation.thresholds(samples(spark, [[200 * i, 0.0, 0.0, 1.0] for i in range(9)])).first()["threshold"] == 0.08
    assert segmentation.thresholds(samples(spark, [[200 * i, 0.5 * (i % 2), 0.0, 1.0] for i in range(50)])).first()["threshold"] > 0.5


def test_boundaries_compare_with_the_last_accepted(spark):
    rows = quiet()
    for i in (50, 53, 56, 150):
        rows[i][1] = 0.9
    got = [r["i"] for r in segmentation.boundaries(samples(spark, rows)).orderBy("i").collect()]
    assert got == [0, 50, 56, 150]  # 53 is too near to 50, 56 is not


def test_segments_cover_the_timeline(spark):
    rows = quiet()
    rows[100][1:3] = [0.9, 0.8]
    rows[200][1:3] = [0.9, 0.2]
    got = segmentation.segments(samples(spark, rows)).orderBy("idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["transition_type"]) for r in got] == [(0, 20000, "start"), (20000, 40000, "nav"), (40000, 60000, "dialog")]


def test_dense_playback_is_minor(spark):
    rows = [[200 * i, 0.5 if i % 4 else 0.95, 0.7, 120.0] for i in range(300)]
    kinds = {r["transition_type"] for r in segmentation.segments(samples(spark, rows)).collect()}
    assert kinds <= {"start", "minor"}


def motions(spark, rows):
    return spark.createDataFrame([("j", i, t, 0.0, float(dy)) for i, (t, dy) in enumerate(rows)], "job_id string, seq long, t_ms long, dx double, dy double")


def test_scrolls_split_on_gap_and_direction(spark):
    got = ev.scrolls(motions(spark, [(0, 5), (600, 5), (1201, 5), (1300, -9), (1400, 2)])).orderBy("t_start_ms").collect()
    assert [(r["t_start_ms"], r["t_end_ms"], r["direction"], r["magnitude_px"]) for r in got] == [(0, 600, "up", 10.0), (1201, 1201, "up", 5.0), (1300, 1300, "down", 9.0)]


def segs(spark, rows):
    return spark.createDataFrame([("j", *r) for r in rows], "job_id string, idx long, start_ms long, end_ms long, transition_type string")


def test_clicks_by_cursor_transition_and_scroll(spark):
    s = segs(spark, [(0, 0, 5000, "start"), (1, 5000, 9000, "nav"), (2, 9000, 12000, "dialog"), (3, 12000, 15000, "nav"), (4, 15000, 16000, "minor"), (5, 20000, 22000, "nav")])
    cursor = spark.createDataFrame([("j", 0, 4000, 10.0, 20.0), ("j", 1, 4900, 11.0, 21.0)], "job_id string, seq long, t_ms long, x double, y double")
    got = ev.clicks(s, cursor, motions(spark, [(11900, 50)]), scale=2.0, device="mobile").orderBy("t_start_ms").collect()
    assert [(r["type"], r["t_start_ms"], r["x"], r["confidence"]) for r in got] == [("tap", 4900, 22, 0.75), ("tap", 19600, None, 0.55)]


def test_the_better_click_of_a_burst_is_the_anchor(spark):
    rows = [("j", 0, 0, 0.5), ("j", 1, 700, 0.7), ("j", 2, 1400, 0.6), ("j", 3, 1600, 0.7)]
    df = spark.createDataFrame(rows, "job_id string, seq long, t_start_ms long, confidence double")
    assert [r["seq"] for r in ev.deduped(df, "seq").orderBy("seq").collect()] == [1, 3]


BLOCK = "job_id string, frame_id string, block_no long, t_ms long, text string, x long, y long, w long, h long, confidence double, role string"


def test_typing_needs_growth_in_one_box(spark):
    frames = spark.createDataFrame([("j", "a", 0, 0, 0), ("j", "b", 1000, 0, 1), ("j", "c", 2000, 1, 2)], "job_id string, frame_id string, t_ms long, segment_idx int, seq int")
    rows = [("j", "a", 0, 0, "hello", 10, 10, 100, 20, 0.9, "body"), ("j", "b", 1, 1000, "hello there", 10, 10, 100, 20, 0.9, "body"), ("j", "b", 2, 1000, "hello elsewhere", 500, 500, 100, 20, 0.9, "body"), ("j", "c", 3, 2000, "hello there again", 10, 10, 100, 20, 0.9, "body")]
    got = ev.typing(spark.createDataFrame(rows, BLOCK), frames).collect()
    assert [(r["final_text"], r["x"], r["y"]) for r in got] == [("hello there", 60, 20)]


def test_nearest_label_and_promotion(spark):
    rows = [("j", "a", 0, 900, "wll ull", 100, 100, 10, 10, 0.9, "body"), ("j", "a", 1, 900, "Save", 110, 100, 40, 20, 0.9, "button_like"), ("j", "a", 2, 900, "A wall of text", 100, 100, 40, 20, 0.9, "body"), ("j", "a", 3, 9000, "Later", 100, 100, 10, 10, 0.9, "body"), ("j", "a", 4, 900, "Vague", 100, 100, 10, 10, 0.3, "body")]
    events = spark.createDataFrame([("j", "e1", "click", 1000, 105, 105), ("j", "e2", "click", 1000, 900, 900)], "job_id string, event_id string, type string, t_start_ms long, x long, y long")
    labels = ev.nearest_labels(events, spark.createDataFrame(rows, BLOCK))
    assert [tuple(r) for r in labels.collect()] == [("j", "e1", "Save")]
    got = {r["event_id"]: (r["type"], r["button"]) for r in ev.promoted(events, labels).collect()}
    assert got == {"e1": ("form_submit", "Save"), "e2": ("click", None)}


def test_anomalies(spark):
    rows = [("j", "a", 0, 10, "Payment failed today", 0, 0, 1, 1, 0.9, "body"), ("j", "a", 1, 10, "terror everywhere", 0, 0, 1, 1, 0.9, "body"), ("j", "a", 2, 10, "Error page", 0, 0, 1, 1, 0.4, "body")]
    assert [r["text"] for r in ev.error_texts(spark.createDataFrame(rows, BLOCK)).collect()] == ["Payment failed today"]
    dark = [[t, 0.0, 0.0, lum] for t, lum in [(0, 1.0), (1900, 1.0), (2000, 1.0), (3000, 50.0), (3500, 2.0), (4000, 2.0)]]
    assert [r["t_ms"] for r in ev.blanks(samples(spark, dark)).orderBy("t_ms").collect()] == [0, 2000, 4000]
    last = spark.createDataFrame([("j", 1000)], "job_id string, last_ms long")
    still = samples(spark, [[t, 0.001, 0.0, 99.0] for t in range(0, 12000, 200)])
    assert ev.stalls(still, last).first()["static_ms"] == 10600
    assert ev.stalls(samples(spark, [[t, 0.001 if t < 11000 else 0.5, 0.0, 99.0] for t in range(0, 12000, 200)]), last).count() == 0


EVENT = "job_id string, seq long, type string, t_start_ms long, t_end_ms long, x long, y long, target string, direction string, magnitude_px double, final_text string, confidence double"


def events(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"target": "", "confidence": 0.75} | r
        full.append(("j", i, d["type"], d["t"], d.get("end", d["t"] + 100), d.get("x"), d.get("y"), d["target"], d.get("direction"), d.get("px"), d.get("text"), d["confidence"]))
    return spark.createDataFrame(full, EVENT)


def test_effects_are_suppressed(spark):
    e = events(spark, [{"type": "click", "t": 1000, "x": 1, "y": 1}, {"type": "navigate", "t": 3000}, {"type": "navigate", "t": 3200}, {"type": "dialog_open", "t": 900}, {"type": "navigate", "t": 700}])
    assert sorted(r["t_start_ms"] for r in steps.suppressed(e).collect()) == [700, 3000]
    assert sorted(r["t_start_ms"] for r in steps.unsuppressed(e).collect()) == [900, 1000, 3200]


def test_scrolls_merge_across_a_suppressed_navigation(spark):
    e = events(spark, [{"type": "click", "t": 0, "x": 1, "y": 1}, {"type": "scroll", "t": 1000, "direction": "down", "px": 4.0}, {"type": "navigate", "t": 1500}, {"type": "scroll", "t": 3000, "direction": "down", "px": 5.0}, {"type": "scroll", "t": 6000, "direction": "down", "px": 1.0}])
    got = steps.merged_scrolls(steps.unsuppressed(e)).where("type = 'scroll'").orderBy("t_start_ms").collect()
    assert [(r["t_start_ms"], r["t_end_ms"], r["magnitude_px"]) for r in got] == [(1000, 3100, 9.0), (6000, 6100, 1.0)]


def test_sentences(spark):
    e = events(
        spark,
        [
            {"type": "click", "t": 0, "target": "Save"},
            {"type": "click", "t": 1000, "target": "Save"},
            {"type": "click", "t": 10000},
            {"type": "click", "t": 12000},
            {"type": "click", "t": 20000, "x": 1000, "y": 10},
            {"type": "type", "t": 30000, "text": "abc"},
            {"type": "scroll", "t": 40000, "direction": "up", "px": 9.0},
            {"type": "navigate", "t": 50000, "target": "shop.example.com"},
            {"type": "dialog_open", "t": 60000},
            {"type": "tap", "t": 70000},
        ],
    )
    got = steps.synthesized(e, 1080, 720).orderBy("idx").collect()
    assert [r["text"] for r in got] == [
        'Click "Save" (2 times).',
        "Click through the next 2 screens (the exact controls could not be read from the video).",
        "Click the control at the top right of the screen.",
        'Type "abc" into the field.',
        "Scroll up the page.",
        'Go to "shop.example.com".',
        "A dialog or overlay opens.",
        "Tap the control that opens the next screen.",
    ]
    assert [bool(r["uncertainty_note"]) for r in got] == [False, True, True, False, False, False, False, True]


def test_cut_after_the_bug(spark):
    e = events(spark, [{"type": "click", "t": t} for t in (0, 2500, 2501, 9000)])
    usable, spans = steps.post_bug_cut(e, spark.createDataFrame([("j", 1000)], "job_id string, t_ms long"))
    assert usable.count() == 2
    assert [tuple(r) for r in spans.collect()] == [("j", 2501, 9100, 2)]
    usable, spans = steps.post_bug_cut(e, spark.createDataFrame([], "job_id string, t_ms long"))
    assert (usable.count(), spans.count()) == (4, 0)


@pytest.mark.parametrize(("flags", "prior"), [([], 1.0), (["blurry"], 0.85), (["blurry", "low_fps", "cursor_invisible", "camera_capture"], 0.6), (["other"], 1.0)])
def test_quality_prior(spark, flags, prior):
    df = spark.createDataFrame([(flags,)], "f array<string>")
    assert df.select(scoring.quality_prior(F.col("f"))).first()[0] == pytest.approx(prior)


def test_confidence(spark):
    df = spark.createDataFrame([("j", i, c) for i, c in enumerate([0.5, 0.8, 0.9])], "job_id string, idx long, confidence double")
    got = [r["confidence"] for r in scoring.propagated(df).orderBy("idx").collect()]
    assert got == pytest.approx([0.5, 0.72, 0.85], abs=1e-3)
    jobs = spark.createDataFrame([("j", 0.9, 1.0, None), ("none", 0.0, 0.0, "assumed")], "job_id string, bug double, coverage double, basis string")
    over = {r["job_id"]: r["overall"] for r in scoring.overall(df, jobs).collect()}
    assert over == {"j": pytest.approx(0.35 * 0.8 + 0.25 * 0.9 + 0.2 + 0.1), "none": pytest.approx(0.06)}
    assert spark.range(1).select(scoring.coverage(F.lit(5), F.lit(0)), scoring.coverage(F.lit(50), F.lit(20))).first()[:] == (0.0, 1.0)


def test_chronology(spark):
    df = spark.createDataFrame([("j", i, t) for i, t in enumerate([1000, 5000, 3500, 3499, None, 9000])], "job_id string, idx long, t_ms long")
    assert [r["idx"] for r in scoring.violations(df).collect()] == [3]


def test_effects_equal_all_pairs(spark):
    import random

    from tracewright.operators.settings import Settings

    s, draw = Settings(), random.Random(12)
    rows = []
    for job in range(5):
        for seq in range(60 * job):
            t = draw.randint(0, 60_000)
            rows.append((f"j{job}", seq, draw.choice(["click", "tap", "form_submit", "navigate", "navigate", "dialog_open", "scroll"]), t, t + draw.choice([0, 50, 400, 1500])))
    df = spark.createDataFrame(rows, "job_id string, seq int, type string, t_start_ms long, t_end_ms long")

    def effect(r):
        for a in rows:
            if a[0] == r[0] and a[2] in steps.ACTIVATIONS:
                if 0 <= r[3] - a[4] <= s.effect_ms or (r[2] == "navigate" and (abs(r[3] - a[3]) <= s.boundary_ms or abs(r[3] - a[4]) <= s.boundary_ms)):
                    return True
        return False

    want = {(r[0], r[1]) for r in rows if r[2] in ("navigate", "dialog_open") and effect(r)}
    assert {(r["job_id"], r["seq"]) for r in steps.suppressed(df).collect()} == want
    assert {(r["job_id"], r["seq"]) for r in steps.unsuppressed(df).collect()} == {(r[0], r[1]) for r in rows} - want and 20 < len(want) < 250
