"""Tables kept as files in buckets, of which a version rewrites only those it touches.

A version's manifest, one small file, maps each bucket to the folder that holds it. It is written under another name and
renamed when all its data are there, so readers see whole versions and one file tells them which folders to read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, through Spark's own file system; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions of a table."""
    return sorted(int(n[:-5]) for n in listed(spark, f"{root}/manifest") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, upto: int | None = None) -> dict[int, str]:
    """Bucket -> its folder in the last version, of those up to ``upto``; empty without one."""
    numbers = [v for v in versions(spark, root) if upto is None or v <= upto]
    if not numbers:
        return {}
    fs, p = _fs(spark, f"{root}/manifest/{numbers[-1]}.json")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): f"{root}/{folder}" for b, folder in json.loads(text).items()}


def _publish(spark: SparkSession, root: str, number: int, places: dict[int, str]) -> None:
    fs, whole = _fs(spark, f"{root}/manifest/{number}.json")
    _, part = _fs(spark, f"{root}/manifest/_{number}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps({b: f.removeprefix(f"{root}/") for b, f in sorted(places.items())}).encode()))
    finally:
        out.close()
    fs.delete(whole, False)  # of a run that failed after this point, with the same rows
    if not fs.rename(part, whole):
        raise OSError(f"version {number} of {root} can't be published")


def bucket_of(key: list[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def touched_buckets(rows: DataFrame, key: list[str | Column], buckets: int) -> list[int]:
    """The buckets that rows belong to; at most so many numbers come to the driver."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


def read(spark: SparkSession, root: str, schema: str, only: list[int] | None = None, upto: int | None = None) -> DataFrame:
    """The table's last version up to ``upto``, or of it the files of some buckets alone."""
    places = manifest(spark, root, upto)
    paths = [f for b, f in sorted(places.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write(rows: DataFrame, root: str, number: int, touched: list[int], bucket: Column) -> None:
    """Version ``number``: these rows are all that the touched buckets hold, others stay as in the version before.

    A hot bucket is written by several tasks (Spark splits what it rebalances). A number that is written again replaces
    what its failed run left.
    """
    spark = rows.sparkSession
    folder = f"v{number}"
    rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{folder}")
    there = {int(n.partition("=")[2]): f"{root}/{folder}/{n}" for n in listed(spark, f"{root}/{folder}") if n.startswith("bucket=")}
    before = manifest(spark, root, number - 1)
    _publish(spark, root, number, {b: f for b, f in before.items() if b not in touched} | there)


def expire(spark: SparkSession, root: str) -> int:
    """Deletes the folders of buckets that the last version doesn't read; how many those were."""
    kept, gone = set(manifest(spark, root).values()), 0
    for v in listed(spark, root):
        for n in listed(spark, f"{root}/{v}") if v.startswith("v") else ():
            if n.startswith("bucket=") and f"{root}/{v}/{n}" not in kept:
                fs, p = _fs(spark, f"{root}/{v}/{n}")
                gone += fs.delete(p, True)
    for v in versions(spark, root)[:-1]:
        fs, p = _fs(spark, f"{root}/manifest/{v}.json")
        fs.delete(p, False)
    return gone
