"""Queries against their SQL where an instant's microseconds decide about a step of the timeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright import plans
from tracewright.sources import adapters

#: One recording: (step of 36 s, event_type, value, k) in order of event_id.
TIMELINE = [
    (0, "view", 20.0, 10), (1000, "view", 20.0, 10), (5000, "click", 20.0, 21), (5500, "error", 20.0, 30), (9000, "click", 20.0, 12),
    (9600, "error", 250.0, 90), (15000, "view", 5.0, 80), (20000, "error", 20.0, 70), (26000, "signup", 20.0, 3), (31000, "purchase", 20.0, 44),
    (36000, "view", 20.0, 96), (41000, "click", 20.0, 35), (46000, "view", 20.0, 50), (51000, "signup", 20.0, 20),
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The first event is 0.6 ms behind a whole step and the others 0.4 ms, so all begin one step earlier once both are rounded to ms."""
    root = tmp_path_factory.mktemp("times")
    con = duckdb.connect()
    us = lambda step: step * 36_000_000 + (400 if step else 600)
    rows = ", ".join(f"({i}, {us(n)}, '{kind}', {value}, {k})" for i, (n, kind, value, k) in enumerate(TIMELINE))
    made = {
        "events": f"""SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01 09:30:00' + to_microseconds(us) AS ts, 1::BIGINT AS user_id, kind AS event_type, value::DOUBLE AS value,
            '{{"k": ' || k || '}}' AS props FROM (VALUES {rows}) AS t(i, us, kind, value, k)""",
        "part": "SELECT 70::BIGINT AS p_partkey, 'red anvil' AS p_name",
        "conversations": "SELECT 99::BIGINT AS conv_id, 0::BIGINT AS turn, 'user' AS role, 'Nothing to see here. Move on' AS text",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{root}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return str(root), con


def test_instants_are_rounded_to_milliseconds(spark):
    micros = [0, 1, 499, 500, 501, 999, 1499, 1500, 2500, -1, -499, -500, -501, -999, -1000, -1499, -1500, -2500, 1704067211172425, 1704067254840621]
    got = spark.createDataFrame([(u,) for u in micros], "us long").select(adapters.epoch_ms(F.timestamp_micros("us")).alias("ms")).collect()
    want = duckdb.sql(f"SELECT epoch_ms(make_timestamp(u)) FROM (SELECT unnest({micros}::BIGINT[]) AS u)").fetchall()
    assert [r["ms"] for r in got] == [m for (m,) in want]


@pytest.mark.parametrize("name", ["anomalies_ordered", "blank_dedupe", "boundaries_greedy", "bug_localized", "bug_rank_top6", "chronology_violations", "click_asof_cursor", "click_dedupe", "compress_anti", "compress_semi", "error_anomalies", "events_detected", "keyframe_times", "merge_repeated"])
def test_times_are_those_of_the_sql(spark, tables, name):
    root, con = tables
    df = plans.QUERIES[name](spark, root)
    got = sorted(tuple(r) for r in df.collect())
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall())
    assert want and got == want
