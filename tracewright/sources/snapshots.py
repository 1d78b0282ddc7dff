"""Tables of jobs whose readers see all of a write or nothing of it.

Rows lie in buckets of job_id under ``data/<write>/bucket=<n>``; a manifest
``manifests/<version>.json`` names the folders that make up the table.  A write
adds folders nobody reads yet and then the next manifest, by one rename that
fails if the version exists.  So a failed write leaves the table as it was, of
two writers at once one must start again, and a reader that has begun goes on
with the files of its version.

A replacement reads and rewrites the buckets that it meets, not the table.  A
write may carry a number (of a stream's batch): a manifest remembers the last
one, and the same number again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Versions that ``vacuum`` keeps.
KEEP = 2


class Conflict(RuntimeError):
    """Another writer was first."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of paths on it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _read_text(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, make = _files(spark, path)
    folder = make(f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version; None where there is no table."""
    found = versions(spark, path)
    if not found:
        return None
    fs, make = _files(spark, path)
    return json.loads(_read_text(fs, make(f"{path}/manifests/{found[-1] if version is None else version}.json")))


def commit(spark: SparkSession, path: str, new: dict) -> None:
    """Make ``new`` the table's manifest, if its version is still free."""
    fs, make = _files(spark, path)
    fs.mkdirs(make(f"{path}/manifests"))
    aside, place = make(f"{path}/manifests/.{uuid.uuid4().hex}"), make(f"{path}/manifests/{new['version']}.json")
    out = fs.create(aside, False)
    out.write(json.dumps(new).encode())
    out.close()
    jvm = spark.sparkContext._jvm
    plain = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        # Of both rename calls this one never replaces a file that is there.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(place), plain)
    except Exception as error:
        fs.delete(aside, False)
        if fs.exists(place):
            raise Conflict(f"version {new['version']} of {path} exists") from error
        raise


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in folders])


def read(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """All rows of a version; none where there is no table."""
    held = manifest(spark, path, version)
    return _rows(spark, path, [f for b in held["buckets"].values() for f in b] if held else [], schema)


def _written(df: DataFrame, path: str, buckets: int) -> tuple[str, list[int]]:
    """Write new folders, and say which buckets they are."""
    name = uuid.uuid4().hex
    # One file for each bucket and write.
    df.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    fs, make = _files(df.sparkSession, path)
    found = [s.getPath().getName() for s in fs.listStatus(make(f"{path}/data/{name}"))]
    return name, sorted(int(n[7:]) for n in found if n.startswith("bucket="))


def _next(held: dict | None, buckets: int, number: int | None) -> dict:
    held = held or {"version": 0, "count": buckets, "number": None, "buckets": {}}
    return held | {"version": held["version"] + 1, "number": held["number"] if number is None else number, "buckets": dict(held["buckets"])}


def _done(held: dict | None, number: int | None) -> bool:
    return held is not None and number is not None and held["number"] is not None and number <= held["number"]


def append(df: DataFrame, path: str, number: int | None = None, buckets: int = BUCKETS) -> None:
    """Add rows (with a job_id)."""
    spark, held = df.sparkSession, manifest(df.sparkSession, path)
    if _done(held, number):
        return
    new = _next(held, buckets, number)
    name, met = _written(df, path, new["count"])
    for b in met:
        new["buckets"][str(b)] = [*new["buckets"].get(str(b), []), f"{name}/bucket={b}"]
    commit(spark, path, new)


def met(df: DataFrame, path: str, buckets: int = BUCKETS) -> tuple[list[int], DataFrame]:
    """The buckets that the jobs of ``df`` fall into, and all rows that the table has there."""
    spark, held = df.sparkSession, manifest(df.sparkSession, path)
    count = held["count"] if held else buckets
    found = sorted(r[0] for r in df.select(_bucket(count)).distinct().collect())  # as many as buckets at most
    return found, _rows(spark, path, [f for b in found for f in held["buckets"].get(str(b), [])] if held else [], df.schema)


def replace_buckets(rows: DataFrame, found: list[int], path: str, number: int | None = None, buckets: int = BUCKETS) -> None:
    """Make ``rows`` all that the buckets ``found`` hold."""
    held = manifest(rows.sparkSession, path)
    if _done(held, number):
        return
    new = _next(held, buckets, number)
    name, filled = _written(rows, path, new["count"])
    for b in found:
        new["buckets"].pop(str(b), None)
    for b in filled:
        new["buckets"][str(b)] = [f"{name}/bucket={b}"]
    commit(rows.sparkSession, path, new)


def replace_jobs(df: DataFrame, path: str, number: int | None = None, buckets: int = BUCKETS) -> None:
    """Replace all rows of the jobs in ``df``, and only these."""
    found, old = met(df, path, buckets)
    stays = old.join(df.select("job_id").distinct(), "job_id", "left_anti").select(*df.columns)
    replace_buckets(stays.unionByName(df), found, path, number, buckets)


def seen(spark: SparkSession, path: str, number: int) -> bool:
    """Whether the table holds the write of that number."""
    return _done(manifest(spark, path), number)


def vacuum(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Delete folders and manifests that none of the last ``keep`` versions needs."""
    fs, make = _files(spark, path)
    found = versions(spark, path)
    kept = found[-keep:]
    needed = {f for v in kept for b in manifest(spark, path, v)["buckets"].values() for f in b}
    for v in found[:-keep]:
        fs.delete(make(f"{path}/manifests/{v}.json"), False)
    data = make(f"{path}/data")
    for write in fs.listStatus(data) if fs.exists(data) else []:
        name = write.getPath().getName()
        parts = [s.getPath().getName() for s in fs.listStatus(write.getPath()) if s.isDirectory()]
        if not any(f"{name}/{p}" in needed for p in parts):
            fs.delete(write.getPath(), True)
            continue
        for p in parts:
            if f"{name}/{p}" not in needed:
                fs.delete(make(f"{path}/data/{name}/{p}"), True)
