"""Greedy folds, bursts and score bands against plain walks, on short and on long recordings."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracewright.operators import segmentation, sequence
from tracewright.operators.settings import Settings

ROW = "job_id string, t long, i long, score double"


def plain_spaced(rows, gap):
    kept = []
    for r in rows:
        if not kept or r[1] - kept[-1][1] >= gap:
            kept.append(r)
    return kept


def plain_better(rows, gap):
    kept = []
    for r in rows:
        if not kept or r[1] - kept[-1][1] >= gap:
            kept.append(r)
        elif r[3] > kept[-1][3]:
            kept[-1] = r
    return kept


@pytest.mark.parametrize(("rule", "plain"), [(lambda: sequence.spaced("t", 700), plain_spaced), (lambda: sequence.better_within("t", 700, "score"), plain_better)])
@pytest.mark.parametrize("piece", [3, 256])
def test_folds_equal_a_plain_walk(spark, monkeypatch, rule, plain, piece):
    monkeypatch.setattr(sequence, "PIECE", piece)
    draw = random.Random(4)
    rows, want = [], []
    for job in range(6):
        t, own = 0, []
        for i in range(0 if job == 5 else 1 + 80 * job):
            t += draw.choice([0, 0, 50, 200, 400, 699, 700, 701, 1500] if job % 2 else [0, 100, 200])
            own.append((f"j{job}", t, i, draw.choice([0.1, 0.2, 0.3])))
        want += plain(own, 700)
        draw.shuffle(own)
        rows += own
    got = sequence.fold(spark.createDataFrame(rows, ROW), ["job_id"], ["t", "i"], ["score"], rule(), "t", 700)
    assert sorted(tuple(r[c] for c in ("job_id", "t", "i", "score")) for r in got.collect()) == sorted(want)


def test_one_burst_of_a_million_rows(spark):
    rows = spark.range(1_000_000).select(F.lit("j").alias("job_id"), (F.col("id") * 200).alias("t"), F.col("id").alias("i"), F.lit(0.5).alias("score"))
    got = sequence.fold(rows, ["job_id"], ["t", "i"], ["score"], sequence.spaced("t", 700), "t", 700)
    assert tuple(got.agg(F.count("*"), F.min("i"), F.max("i"), F.sum(F.col("i") % 4)).first()) == (250_000, 0, 999_996, 0)


@pytest.mark.parametrize(("first", "behind", "n"), [(0, 1, 1), (0, 9, 9), (3, 70, 100), (8, 64, 64), (5, 6, 600), (1, 599, 600), (0, 512, 512), (7, 9, 4000), (511, 3585, 4000)])
def test_blocks_cover_a_range_once(spark, first, behind, n):
    levels = 0
    while 8**levels < n:
        levels += 1
    blocks = spark.range(1).select(sequence.rank_blocks(F.lit(first), F.lit(behind), F.lit(levels)).alias("b")).first()["b"]
    ranks = [r for b in blocks for r in range(b["block"] * 8 ** b["level"], (b["block"] + 1) * 8 ** b["level"])]
    assert sorted(ranks) == list(range(first, behind)) and len(blocks) <= 14 * (levels + 1)


def test_ambient_counts_equal_all_pairs(spark):
    draw = random.Random(9)
    rows = []
    for job in range(4):
        t = 0
        for i in range([0, 1, 40, 900][job]):
            t += draw.choice([100, 200, 900])
            rows.append((f"j{job}", i, t, draw.choice([0.0, 0.05, 0.1, 0.16, round(draw.random(), 4), 0.9]), 0.3, 1.0))
    samples = spark.createDataFrame(rows, "job_id string, i long, t_ms long, score double, change_frac double, lum double")
    s = replace(Settings(), score_sigmas=0.0)
    got = {(r["job_id"], r["i"]): (r["n"], r["spread"]) for r in segmentation.ambient(samples, s).collect()}
    marks = {(r["job_id"], r["i"]): r["score"] for r in segmentation.boundaries(samples, s).collect()}
    assert got.keys() == marks.keys() and len(got) > 100
    for (job, i), score in marks.items():
        own = [r for r in rows if r[0] == job]
        span = own[-1][2] - own[0][2]
        near = [r[2] for r in own if score > 0 and s.ambient_low * score <= r[3] <= s.ambient_high * score]
        assert got[job, i] == (len(near), round((max(near) - min(near)) / span, 4) if near and span else 0.0)


def test_segments_of_a_long_recording(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000
    rows = spark.range(200_000).select(F.lit("j").alias("job_id"), F.col("id").alias("i"), (F.col("id") * 200).alias("t_ms"), F.round(noise * F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)) == 0, 1.0).otherwise(0.2), 4).alias("score"), F.lit(0.3).alias("change_frac"))
    got = segmentation.segments(rows).agg(F.count("*"), F.min("start_ms"), F.max("end_ms"), F.sum(F.col("end_ms") - F.col("start_ms"))).first()
    assert got[0] > 1000 and tuple(got[1:]) == (0, 200_000 * 200, 200_000 * 200)
