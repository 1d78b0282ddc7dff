"""The contract on documents: every rule, defaults, round trips, broken documents."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import contract
from tracewright.plans.report import SPOILT, spoilt


def docs(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "n int, body string")


def test_every_rule(spark):
    got = contract.checked(docs(spark, [spoilt(*s[:2]) for s in SPOILT])).orderBy("n").collect()
    for row, (part, value, path, rule) in zip(got, SPOILT):
        assert [tuple(b) for b in row["broken"]] == ([] if rule is None else [(path, rule)]), (part, value)
        assert (row["report"] is None) == (rule is not None)


def test_defaults_are_filled_in(spark):
    row = contract.checked(docs(spark, [contract.sample()])).first()
    r = row["report"].asDict(recursive=True)
    assert row["broken"] == []
    assert (r["schema_version"], r["bug_type"], r["overall_confidence"], r["steps"], r["expected_result"]) == ("1.0", "unknown", 0.5, [], None)
    assert r["environment"]["device_class"] == "unknown" and r["environment"]["field_confidence"] == {}
    assert r["confidence_breakdown"] == {"actions": 0.5, "ocr": 0.5, "bug_localization": 0.5, "expected_result": 0.0, "coverage": 0.5}
    assert r["observed_result"] == {"text": "x", "evidence": [], "confidence": 0.5}


def test_several_faults_of_one_document_and_documents_that_are_none(spark):
    bad = {"title": None, "steps": [{"key": "a", "index": 1, "text": "", "confidence": 7}], "observed_result": {}}
    bodies = [json.dumps(bad), "", None, "[]", "3", "null", "{}"]
    rows = contract.violations(docs(spark, bodies)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["n"], []).append((r["path"], r["rule"]))
    assert by[0] == [("title", "required"), ("steps[0].text", "must not be empty"), ("steps[0].confidence", "outside of 0 to 1"), ("observed_result.text", "required")]
    assert by[1] == by[2] == [("", "not JSON")]
    assert by[3] == by[4] == [("", "not an object")]
    assert {p for p, _ in by[6]} == {"title", "observed_result"}
    assert contract.violations(docs(spark, [])).count() == 0


def test_round_trip_keeps_every_field(spark):
    evidence = [{"frame_id": "f", "t_start_ms": 1, "t_end_ms": 2, "note": "n"}]
    full = {
        "schema_version": "1.0", "title": "t", "summary": "s", "bug_type": "ui",
        "preconditions": [{"text": "p", "grounding": "observed", "confidence": 0.7}],
        "environment": {"os": "o", "browser": "b", "app": "a", "device_class": "mobile", "resolution": "1x2", "locale": "en", "theme": "dark", "field_confidence": {"os": 0.5}},
        "steps": [{"key": "k", "index": 1, "text": "x", "action_type": "tap", "grounding": "assumed", "confidence": 0.25, "uncertainty_note": "u", "evidence": evidence, "screen_state": "z", "compressed_from": {"a": [1, {"b": None}]}}],
        "observed_result": {"text": "o", "evidence": evidence, "confidence": 0.1},
        "expected_result": {"text": "e", "basis": "narration", "confidence": 0.9},
        "bug_manifestation": {"t_ms": 5, "evidence": evidence, "confidence": 2.5},
        "alternate_interpretations": ["i"], "ambiguity_notes": ["m"], "omitted_activity": [{"t_start_ms": 1, "t_end_ms": 2, "reason": "r"}],
        "overall_confidence": 1.0, "confidence_breakdown": {"actions": 0.1, "ocr": 0.2, "bug_localization": 0.3, "expected_result": 0.4, "coverage": 0.6},
    }
    once = contract.checked(docs(spark, [json.dumps(full)]))
    r = once.first()["report"].asDict(recursive=True)
    r["steps"][0]["compressed_from"] = json.loads(r["steps"][0]["compressed_from"])
    assert r == full
    flat = once.select("report.*")
    again = contract.checked(flat.select(contract.body(flat).alias("body"))).first()
    assert again["broken"] == [] and again["report"] == once.first()["report"]
    assert len(contract.names()) == len(set(contract.names())) == 54


@pytest.mark.parametrize("value", [True, "12", 3.0])
def test_numbers_that_pass(spark, value):
    doc = json.loads(contract.sample())
    doc["bug_manifestation"] = {"t_ms": value}
    assert contract.checked(docs(spark, [json.dumps(doc)])).first()["report"]["bug_manifestation"]["t_ms"] == int(float(value))
