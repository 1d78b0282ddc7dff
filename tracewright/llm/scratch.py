"""Tables and files that several jobs share.

Intermediate tables cut the lineage: an executor that is lost later costs a
re-read and not a re-computation.  They live below ``spark.checkpoint.dir``,
which driver and executors share on a cluster.  Only where that setting is
absent and the master is local (tests) is a folder of this machine used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """A fresh URI below the shared folder; the caller creates what it holds."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir() + "/tracewright"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete what ``store`` wrote, once no later job reads it."""
    if isinstance(df_or_path, DataFrame):
        spark, paths = df_or_path.sparkSession, {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
