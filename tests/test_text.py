"""Text rules over whole-string cases."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text


def rate(spark, strings):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    q = text.with_quality(text.with_label(df, "s"), "s")
    rows = q.select("i", "label", F.col("q_clean").alias("clean"), F.col("q_quality").alias("quality"), text.clock_like(F.col("q_clean")).alias("clock"), text.typed_ok(F.col("q_clean"), F.col("q_tokens"), F.col("q_quality")).alias("typed")).orderBy("i").collect()
    return rows


GOOD = ["Save changes", "OK", "Buy", "Open cart", "SEP DAX", "user2024", "shop.example.com/cart", "x 6 shop.example.com/a 3", "Lunch at 12:30 Cafe Central", "+1.50%", "me@example.org"]
BAD = ["", None, "a", "8:55", "8:55 AM 74%", "wll brt", "B ra) 00:52 ull", "all all 5g", "[ 4138.58 B 4139.41", "««»» ||", "a ull B", "12345678901 2"]


def test_good_labels_are_readable(spark):
    assert all(r["quality"] >= 0.5 and r["label"] for r in rate(spark, GOOD))


def test_noise_has_no_label(spark):
    assert all(r["quality"] < 0.5 and r["label"] == "" for r in rate(spark, BAD))


def test_clean_drops_artifacts(spark):
    assert [r["clean"] for r in rate(spark, ["«  Save® |  now ». ", "tab\tand\x01control", " .,;:-"])] == ["Save now", "tab and control", ""]


def test_labels_prefer_addresses_and_trim_noise(spark):
    got = [r["label"] for r in rate(spark, ["fm) 6 trader.example.com/path 3", "wll Open settings wll", "Settings " * 12])]
    assert got[:2] == ["trader.example.com/path", "Open settings"]
    assert len(got[2]) <= 60 and got[2].endswith("...")


@pytest.mark.parametrize(("s", "clock"), [("8:55", True), ("8:55 AM", True), ("08:55 74%", True), ("8:55 9:10", True), ("Meeting room at 12:30 today", False), ("no time", False), ("", False), ("18:55x", False)])
def test_clocks(spark, s, clock):
    assert rate(spark, [s])[0]["clock"] is clock


@pytest.mark.parametrize(("s", "ok"), [("hello world", True), ("4821", True), ("Hello", True), ("iIFOREX", False), ("at 8:55", False), ("ab", False), ("12 x", False), ("123456789012345678901", False)])
def test_typed_text(spark, s, ok):
    assert rate(spark, [s])[0]["typed"] is ok


def test_roles(spark):
    cases = [("8:55", 0, 10, "status_bar"), ("wll", 0, 10, "status_bar"), ("shop.example.com", 0, 10, "url_bar"), ("My account", 0, 10, "title_bar"), ("x shop.example.com", 0, 200, "url_bar"), ("Pay", 0, 1880, "status_bar"), ("Pay now", 0, 900, "button_like"), ("A long sentence that tells something", 0, 900, "body")]
    df = spark.createDataFrame([(i, t, x, y) for i, (t, x, y, _) in enumerate(cases)], "i int, t string, x int, y int")
    q = text.with_quality(df, "t")
    role = text.role("t", F.col("x"), F.col("y"), F.lit(100), F.lit(40), F.lit(1920), F.lit(1080), F.col("q_clean"), F.col("q_quality"))
    assert [r[0] for r in q.orderBy("i").select(role).collect()] == [c[3] for c in cases]
