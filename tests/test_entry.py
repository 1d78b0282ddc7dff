"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"job_id", "idx", "text", "confidence"} <= set(df.columns)


def test_without_the_training_data_operators(monkeypatch):
    """Only the engine's queries are there, and they are all there, when the subpackage is gone."""
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("tracewright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tracewright.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    try:
        assert not [q for q in alone.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"]
        assert set(alone.queries()) == set(alone.plans.QUERIES) and set(alone.oracle_sql()) == set(alone.plans.ORACLE_SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
