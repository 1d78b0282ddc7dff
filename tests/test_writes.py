"""Snapshots, edit chains, stage entries, and the progress table across batches."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import catalog
from tracewright.sources import snapshots
from tracewright.streaming import progress

ROW = "job_id string, v int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def held(spark, path, version=None):
    return sorted(map(tuple, snapshots.read(spark, path, rows(spark).schema, version).collect()))


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert held(spark, path) == []
    snapshots.replace_jobs(rows(spark, ("a", 1), ("b", 2), ("b", 3)), path, buckets=2)
    before = held(spark, path)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            snapshots.replace_jobs(rows(spark, ("a", 9), ("b", 9)), path)
    assert held(spark, path) == before == [("a", 1), ("b", 2), ("b", 3)]
    snapshots.replace_jobs(rows(spark, ("b", 9)), path)
    assert held(spark, path) == [("a", 1), ("b", 9)]
    snapshots.append(rows(spark, ("a", 7), ("c", 4)), path)
    assert held(spark, path) == [("a", 1), ("a", 7), ("b", 9), ("c", 4)]
    assert held(spark, path, 1) == before


def test_of_two_writers_one_starts_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.append(rows(spark, ("a", 1)), path, buckets=2)
    late = snapshots.manifest(spark, path) | {"version": 2}
    snapshots.append(rows(spark, ("b", 1)), path)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, late)
    assert held(spark, path) == [("a", 1), ("b", 1)] and snapshots.versions(spark, path) == [1, 2]


def test_a_numbered_write_counts_once_and_old_files_go(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (0, 0, 1, 1, 0):
        snapshots.append(rows(spark, ("a", n)), path, number=n, buckets=2)
    assert held(spark, path) == [("a", 0), ("a", 1)]
    for n in range(2, 8):
        snapshots.replace_jobs(rows(spark, ("a", n)), path, number=n)
        snapshots.vacuum(spark, path)
    assert held(spark, path) == [("a", 7)] and len(snapshots.versions(spark, path)) == 2
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    snapshots.replace_jobs(rows(spark), path, number=9)
    assert held(spark, path) == [("a", 7)]


def plain_answers(edits, heads):
    """One edit after the other."""
    heads, out = dict(heads), {}
    for report, rev, parent, _, valid in sorted(edits, key=lambda e: (e[3], e[1])):
        if report not in heads:
            out[rev] = 404
        elif heads[report] is None or parent != heads[report]:
            out[rev] = 409
        elif not valid:
            out[rev] = 422
        else:
            out[rev], heads[report] = 200, rev
    return out, heads


EDIT = "report_id string, revision_id long, parent_revision_id long, created_at long, valid boolean"


def test_edits_in_chains_forks_and_on_unknown_parents(spark):
    draw = random.Random(2)
    heads = [("r", 10), ("q", 20), ("none", None)]
    edits, rev = [], 100
    for report in ("r", "q", "none", "gone"):
        known = [10 if report == "r" else 20]
        for k in range(60):
            rev += 1
            parent = draw.choice([*known[-3:], known[-1], 7, None, rev + 1])
            edits.append((report, rev, parent, k + draw.randint(0, 2), draw.random() < 0.8))
            known.append(rev)
    # A chain of a hundred on one report, in order.
    edits += [("long", 1000 + i, 999 + i, i, True) for i in range(100)]
    heads.append(("long", 999))
    got = catalog.answered(spark.createDataFrame(edits, EDIT), spark.createDataFrame(heads, "report_id string, head_revision_id long"))
    want, after = plain_answers(edits, heads)
    assert {r["revision_id"]: r["code"] for r in got.collect()} == want and set(want.values()) == {200, 404, 409, 422}
    new, moved = catalog.saved(spark.createDataFrame(edits, EDIT), spark.createDataFrame([(*h, "draft") for h in heads], "report_id string, head_revision_id long, status string"))
    assert {r["report_id"]: r["head_revision_id"] for r in moved.collect()} == after
    assert {r["revision_id"] for r in new.collect()} == {k for k, v in want.items() if v == 200}


def test_several_stages_of_one_job(spark):
    jobs = spark.createDataFrame([("a", "running", None), ("b", "running", [("s01", "done", 1)]), ("c", "running", None)], f"job_id string, status string, stages {catalog.ENTRIES}")
    done = spark.createDataFrame([("a", "s02", "failed", 4), ("a", "s01", "done", 3), ("b", "s02", "done", 5)], "job_id string, stage string, stage_status string, ms int")
    got = {r["job_id"]: (r["status"], [tuple(s) for s in r["stages"]]) for r in catalog.with_stage(jobs, done).collect()}
    assert got == {"a": ("failed", [("s01", "done", 3), ("s02", "failed", 4)]), "b": ("running", [("s01", "done", 1), ("s02", "done", 5)]), "c": ("running", [])}


def message(job, stage, status, at):
    return job, stage, status, 0.5, at


def batch(spark, *messages):
    raw = spark.createDataFrame(list(messages), "job_id string, stage string, status string, pct double, at string")
    return progress.updates(raw.withColumn("at", F.to_timestamp("at")))


def test_progress_state_follows_open_jobs(spark, tmp_path):
    table = f"file://{tmp_path}/state"
    first = batch(spark, message("a", "s01_validate", "running", "2024-01-01 00:00:01"), message("b", "s01_validate", "running", "2024-01-01 00:00:02"), message("old", "s01_validate", "running", "2023-01-01 00:00:00"))
    second = batch(spark, message("a", "s12_finalize", "completed", "2024-01-01 00:00:09"), message("b", "s02_normalize", "running", "2024-01-01 00:00:05"))
    progress.fold_batch(first, 0, table)
    version = snapshots.versions(spark, table)
    progress.fold_batch(first, 0, table)  # once more
    assert snapshots.versions(spark, table) == version
    progress.fold_batch(second, 1, table)
    progress.fold_batch(batch(spark, message("a", "s03_segment", "running", "2024-01-01 00:00:03")), 2, table)
    got = {r["job_id"]: (r["stage"], r["ended"]) for r in progress.states(spark, table).collect()}
    assert got == {"a": ("s12_finalize", True), "b": ("s02_normalize", False), "old": ("s01_validate", False)}
    for n in range(3, 9):
        progress.fold_batch(batch(spark, message(f"j{n}", "s12_finalize", "failed", "2024-01-02 00:00:00")), n, table)
    open_jobs = {r["job_id"] for r in snapshots.read(spark, table, progress.STATE).collect()}
    assert "b" in open_jobs and not any(j.startswith("j") for j in open_jobs) and "old" not in open_jobs
    assert len(snapshots.versions(spark, table)) == 2 and progress.states(spark, table).count() == 9
