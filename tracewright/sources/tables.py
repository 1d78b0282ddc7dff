"""Readers: parquet tables, JSON artifacts, and blobs with their metadata."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = T.StructType([T.StructField("t_ms", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("change_frac", T.DoubleType()), T.StructField("lum", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where a source comes in fewer pieces than that; untouched otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def artifacts(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """JSON documents under org_id=/job_id=/stage= folders; filters on these prune folders."""
    keyed = T.StructType([*schema.fields, *[T.StructField(k, T.StringType()) for k in ("org_id", "job_id", "stage")]])
    return spark.read.schema(keyed).option("basePath", root).json(root)


def write_artifacts(df: DataFrame, root: str) -> None:
    """Replace the artifacts of the jobs and stages in ``df``, and only these."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("org_id", "job_id", "stage").json(root)


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with size and content hash; drop ``content`` and it is never read beyond the hash."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), "content")


def packet_duration(packets: DataFrame) -> DataFrame:
    """(path, duration_s): the last readable time stamp of each file's packets."""
    t = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    return packets.groupBy("path").agg(F.coalesce(F.max(F.greatest(t("pts_time"), t("dts_time"))), F.lit(0.0)).alias("duration_s"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where the master is local and none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/tracewright"
    return root.rstrip("/")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def append_rows(df: DataFrame, path: str) -> None:
    """Row sink: append to a Parquet table."""
    df.write.mode("append").parquet(path)


def replace_jobs(df: DataFrame, path: str, buckets: int = 256) -> None:
    """Row sink: replace all rows of the jobs in ``df``, and only these.

    The table is laid out in buckets of job_id, so only buckets that are met are
    rewritten, however many jobs the table holds.  A plain folder of files cannot
    be switched in one step: ``snapshots`` has the sink whose readers see all of
    a write or nothing.
    """
    spark = df.sparkSession
    keyed = df.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    schema = T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])
    try:
        old = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        met = keyed.select("bucket").distinct()
        stays = old.join(F.broadcast(met), "bucket", "left_semi").join(keyed.select("job_id").distinct(), "job_id", "left_anti")
        # Written aside first: a table cannot be read and overwritten at once.
        aside = fresh(spark, "replaced")
        keyed.unionByName(stays.select(*keyed.columns)).write.mode("append").parquet(aside)
        keyed = spark.read.schema(schema).parquet(aside)
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


#: Folders of scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


def fresh(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one for intermediate data; it goes with its scope, or else when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate data that is made inside goes at the end: write what is wanted before that, since a lazy result would read it later."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once no later job reads it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: for relations that several branches of a query use."""
    path = fresh(df.sparkSession, label)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
