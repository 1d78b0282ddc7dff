"""Relations of the engine projected from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.sources.tables import spread, table


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, to the nearest one, halves away from zero; ``unix_millis`` cuts microseconds off instead."""
    halves = F.call_function("div", F.unix_micros(ts.cast("timestamp")), F.lit(500))
    return F.call_function("div", halves + F.when(halves < 0, -1).otherwise(1), F.lit(2))


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a timeline per user: an hour is 100 ms."""
    e = table(spark, sf, "events")
    ms = epoch_ms(F.col("ts"))
    job = Window.partitionBy("user_id")
    return e.select(
        F.col("user_id").alias("job_id"),
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.floor((ms - F.min(ms).over(job)) / 36000).cast("long").alias("t_ms"),
        (F.row_number().over(job.orderBy("ts", "event_id")) - 1).cast("long").alias("i"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).select("job_id", "i", "t_ms", F.round(F.least(F.col("value") / 250, F.lit(1.0)), 4).alias("score"), F.round(F.col("k") / 100, 4).alias("change_frac"), F.round("value", 1).alias("lum"))


def motions(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).where(F.col("event_type").isin("view", "signup")).select("job_id", F.col("i").alias("seq"), "t_ms", F.lit(0.0).alias("dx"), (F.col("k") - 50).cast("double").alias("dy"))


def cursor(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).where(F.col("event_type") == "click").select("job_id", F.col("i").alias("seq"), "t_ms", (F.col("k") * 10).cast("double").alias("x"), F.floor(F.col("value") * 4).cast("double").alias("y"))


def event_list(spark: SparkSession, sf: str) -> DataFrame:
    """Typed events for the step operators in isolation."""
    b = base(spark, sf)
    kind = (
        F.when(F.col("event_type") == "click", "click")
        .when(F.col("event_type") == "purchase", "form_submit")
        .when(F.col("event_type") == "error", F.when(F.col("k") < 50, "navigate").otherwise("dialog_open"))
        .otherwise("scroll")
    )
    scroll = F.col("type") == "scroll"
    act = F.col("type").isin("click", "form_submit")
    odd = act & (F.col("k") % 2 == 1)
    names = F.array(F.lit("Save"), F.lit("Open cart"), F.lit("Help"))
    return b.withColumn("type", kind).select(
        "job_id",
        F.col("i").alias("seq"),
        F.col("event_id"),
        F.col("t_ms").alias("t_start_ms"),
        (F.col("t_ms") + 100).alias("t_end_ms"),
        "type",
        F.when(odd, F.col("k") * 10).alias("x"),
        F.when(odd, F.floor(F.col("value") * 4)).alias("y"),
        F.when(act & (F.col("k") % 5 != 0), F.element_at(names, (F.col("k") % 3 + 1).cast("int"))).otherwise("").alias("target"),
        F.when(scroll, F.when(F.col("k") < 50, "down").otherwise("up")).alias("direction"),
        F.when(scroll, F.abs(F.col("k") - 50).cast("double")).alias("magnitude_px"),
        F.lit(None).cast("string").alias("final_text"),
        F.when(odd, 0.75).otherwise(0.55).alias("confidence"),
    )


def ui_strings(spark: SparkSession, sf: str) -> DataFrame:
    """(src, id, text): strings as they stand on screens, clean and not: every line of every document, whole."""
    lines = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    docs = lines.select(F.lit("doc").alias("src"), F.concat_ws(":", "doc_id", "pos").alias("id"), "text")
    urls = table(spark, sf, "pages").select(F.lit("url"), F.col("page_id").cast("string"), F.concat(F.lit("fm) 6 "), F.regexp_replace("url", "^https?://", ""), F.lit(" 3")))
    parts = table(spark, sf, "part").select(F.lit("part"), F.col("p_partkey").cast("string"), F.concat(F.lit("«|"), "p_name", F.lit("® wll")))
    people = table(spark, sf, "customer").select(F.lit("customer"), F.col("c_custkey").cast("string"), "c_name")
    orders = table(spark, sf, "orders").select(F.lit("order"), F.col("o_orderkey").cast("string"), F.concat(F.date_format("o_orderdate", "d"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.lit(" "), F.substr("o_orderpriority", F.lit(3))))
    return docs.union(urls).union(parts).union(people).union(orders)


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised text: one frame per conversation turn, one block per sentence, whole."""
    c = table(spark, sf, "conversations")
    cut = c.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("pos", "sentence"))
    placed = cut.select(
        F.col("conv_id").alias("job_id"),
        F.concat_ws("-", "conv_id", "turn").alias("frame_id"),
        (F.col("turn") * 1500).alias("t_ms"),
        (F.col("turn") * 10000 + F.col("pos")).cast("long").alias("block_no"),
        F.col("sentence").alias("text"),
        ((F.col("pos") * 97) % 600).cast("long").alias("x"),
        # Seven rows of a screen, the last in its bottom strip.
        ((F.col("pos") % 7) * 173 + F.lit(40)).cast("long").alias("y"),
        F.lit(120).cast("long").alias("w"),
        F.lit(40).cast("long").alias("h"),
        F.round(0.40 + (F.length("sentence") % 60) / 100, 2).alias("confidence"),
    )
    rated = text.with_quality(placed, "text")
    role = text.role("text", F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1080), F.lit(1080), F.col("q_clean"), F.col("q_quality"))
    return text.computed(rated, "role", role).drop("q_clean", "q_tokens", "q_raw", "q_kinds", "q_quality")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.concat_ws("-", "conv_id", "turn").alias("frame_id"), (F.col("turn") * 1500).alias("t_ms"), F.floor(F.col("turn") / 2).cast("long").alias("segment_idx"), F.col("turn").alias("seq"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Report rows: an order is a recording, its line items are the steps."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    step = F.struct(
        F.col("l_linenumber").alias("index"),
        F.concat(F.lit("Open part "), F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", " & <return> it").otherwise(""), F.lit(".")).alias("text"),
        F.round(0.5 + F.col("l_discount") * 4, 2).alias("confidence"),
        F.when(F.col("l_tax") > 0.05, "price may include tax").otherwise("").alias("uncertainty_note"),
        (F.col("l_quantity") * 1000).cast("long").alias("t_start_ms"),
    )
    steps = li.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    kind = F.when(F.col("o_orderstatus") == "F", "crash").when(F.col("o_orderstatus") == "O", "functional").otherwise("unknown")
    some = F.col("o_orderstatus") != "P"
    none = F.array().cast("array<string>")
    return o.join(steps, o["o_orderkey"] == steps["job_id"]).select(
        "job_id",
        F.concat(F.lit("Issue in "), F.substr("o_orderpriority", F.lit(3))).alias("title"),
        F.when(F.col("o_custkey") % 2 == 0, "Seen <twice> & more.").otherwise("").alias("summary"),
        kind.alias("bug_type"),
        F.round(0.3 + (F.col("o_orderkey") % 7) / 10, 2).alias("overall_confidence"),
        F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("Signed in"))).otherwise(none).alias("preconditions"),
        "steps",
        F.struct(F.lit("It stops.").alias("text"), F.when(some, F.col("o_orderkey") * 10).alias("t_ms")).alias("observed"),
        F.when(F.col("o_orderstatus") == "O", F.struct(F.lit("It goes on.").alias("text"), F.lit("visible_convention").alias("basis"), F.lit(0.5).alias("confidence"))).alias("expected"),
        F.struct(F.lit("unknown").alias("os"), F.lit("").alias("browser"), F.lit(None).cast("string").alias("app"), F.lit("desktop").alias("device_class"), F.lit("1080x720").alias("resolution"), F.lit("dark").alias("theme")).alias("environment"),
        F.when(some, F.struct((F.col("o_orderkey") * 10).alias("t_ms"), F.lit(0.85).alias("confidence"))).alias("manifestation"),
        F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("The recording is blurry; extracted text may be incomplete."))).otherwise(none).alias("ambiguity"),
        F.array(F.struct(F.lit(61000).cast("long").alias("t_start_ms"), F.lit(125000).cast("long").alias("t_end_ms"), F.lit("after the bug").alias("reason"))).alias("omitted"),
    )


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    r = li.select(F.col("l_orderkey").alias("report_id"), (F.col("l_orderkey") * 100 + number).alias("revision_id"), F.col("l_shipdate").alias("created_at"))
    return r.withColumn("parent_revision_id", F.lag("revision_id").over(Window.partitionBy("report_id").orderBy("revision_id")))
