"""Physical plans of every engine query: nothing that breaks at scale."""

import os
import re

import pytest

from tracewright import plans

SF = "/root/testdata/sf0.001"


#: Queries whose kernels are numpy on pixels: they leave the JVM by Arrow, and no other does.
PIXELS = {"media_frames", "media_change", "media_moves", "media_texts"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n != "progress_stream"])
def test_no_query_meets_all_pairs_or_leaves_the_jvm(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert not re.search(r"NestedLoopJoin|CartesianProduct", physical)
    assert bool(re.search(r"Python|Pandas|Arrow", physical)) == (name in PIXELS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_scans_read_what_they_need(spark):
    plan = plans.QUERIES["sample_threshold"](spark, SF)._jdf.queryExecution().toString()
    read = plan[plan.index("ReadSchema:") :].split("\n")[0]
    assert "event_type" not in read and "value" in read
    plan = plans.QUERIES["media_kind"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,0.0)" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize(("name", "scans", "exchanges"), [("segments", 1, 2), ("ambient_profile", 1, 2), ("step_sentences", 1, 2), ("merge_repeated", 1, 2), ("click_asof_cursor", 3, 6)])
def test_recordings_are_partitioned_once(spark, name, scans, exchanges):
    """One scan, one exchange by user that makes the series, and one by job on which everything else stays."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan parquet|FileScan", plan)) <= scans
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= exchanges
