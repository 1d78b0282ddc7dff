"""Progress messages of jobs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.sources import snapshots
from tracewright.sources.tables import discard, stored

MESSAGE = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()), T.StructField("pct", T.DoubleType()), T.StructField("at", T.TimestampType())])
# States that end a job, and the stages in their order.
TERMINAL = ("awaiting_review", "completed", "failed")
STAGES = ("s01_validate", "s02_normalize", "s03_segment", "s04_frames_ocr", "s05_motion", "s06_events", "s07_targets", "s09_bug", "s10_synthesis", "s11_validate_score", "s12_finalize")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON files as they appear."""
    return spark.readStream.schema(MESSAGE).json(path)


def updates(stream: DataFrame) -> DataFrame:
    """Messages, and whether their status ends the job."""
    return stream.withColumn("ended", F.col("status").isin(*TERMINAL))


def latest(rows: DataFrame) -> DataFrame:
    """One row per job: its newest message; of messages of one time the one farther on."""
    place = F.struct("at", "ended", F.coalesce("pct", F.lit(-1.0)), "stage", "status")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("stage", "status", "pct", "at", "ended"), place).alias("m")).select("job_id", "m.*")


def publish(rows: DataFrame, path: str) -> None:
    """Append messages (columns of MESSAGE) to the log that ``messages`` follows."""
    rows.select(*MESSAGE.names).write.mode("append").json(path)


def stage_percent(stage):
    """Share of the stages before a stage, in percent of all."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    return F.when(place > 0, F.round((place - 1) / len(STAGES), 4))


def next_stage(stage):
    """The stage after a stage, null after the last."""
    names = F.array(*map(F.lit, STAGES))
    return F.when(F.array_position(names, stage) > 0, F.get(names, F.array_position(names, stage).cast("int")))


#: The table of updates: a row of MESSAGE for each job, and whether it has ended.
STATE = T.StructType([*MESSAGE.fields, T.StructField("ended", T.BooleanType())])


def fold_batch(batch: DataFrame, number: int, table: str, idle_days: int = 30) -> None:
    """Take one batch of updates into the table.

    The table holds open jobs only: a job that has ended, or of which nothing was heard
    for ``idle_days`` before the newest message, goes to the archive beside it.
    A batch rewrites the buckets of its own jobs, and old files go, so
    state and files follow the open jobs and not the batches.  The manifest
    remembers the batch, so one that runs again changes nothing.
    """
    spark = batch.sparkSession
    if snapshots.seen(spark, table, number):
        return
    new = latest(batch).select(*STATE.names)
    found, old = snapshots.met(new, table)
    rows = stored(latest(old.unionByName(new)).select(*STATE.names), "progress-rows")
    newest = rows.agg(F.max("at")).first()[0]
    closed = F.col("ended") | F.coalesce(F.col("at") < F.lit(newest) - F.make_dt_interval(F.lit(idle_days)), F.lit(False))
    # The archive first: if what follows fails, the same batch writes the same file again.
    rows.where(closed).write.mode("overwrite").parquet(f"{table}-ended/batch={number}")
    snapshots.replace_buckets(rows.where(~closed), found, table, number)
    snapshots.vacuum(spark, table)
    discard(rows)


def states(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of every job, open or ended."""
    ended = spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(f"{table}-ended")
    return latest(snapshots.read(spark, table, STATE).unionByName(ended))


def run_to_end(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Process what is there and return the newest row of each job; nothing is gathered on the driver."""
    query = updates(stream).writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return states(stream.sparkSession, table)
