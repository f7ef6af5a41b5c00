"""Shared helpers: stored intermediates, text splitting and 64-bit hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: While it holds, Spark deletes a query's shuffle files at its end; a kept table needs its shuffles no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    It is set here only where it is unset in a purely local session, as in tests.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_to = jdir.get() if jdir.isDefined() else None
    if not set_to:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        set_to = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(set_to)
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return set_to


class Store:
    """Intermediate tables of one operator run, as zstd Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs only the tasks of the step that was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.option("compression", "zstd")
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _table(self, file: str) -> str | None:
        """The kept table that a file is of."""
        name = self.root.rpartition("/")[2]
        return f"{self.root}/{file.split(name + '/')[1].split('/')[0]}" if f"/{name}/" in file else None

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes kept tables that no later step reads."""
        for df in frames:
            for path in {self._table(x) for x in df.inputFiles()} - {None}:
                self._delete(path)

    def release(self, result: DataFrame) -> DataFrame:
        """result, after deleting the kept tables that it doesn't read."""
        used = {self._table(x) for x in result.inputFiles()}
        for n in range(1, self.n + 1):
            if f"{self.root}/{n}" not in used:
                self._delete(f"{self.root}/{n}")
        return result


def cumulated(df: DataFrame, order: list[str | Column], value: str | Column, store: Store) -> DataFrame:
    """df, kept, with ``before``: the sum of a whole-numbered value over all rows ahead in the order, which has no ties.

    Rows are dealt by ranges of the order, so a hot key is spread like any other; one sum for each partition goes to
    the driver. Only a task's rows are sorted together.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = store.keep(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    total, sums = 0, []
    for r in rows.groupBy("__part").agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("n")).orderBy("__part").collect():
        sums.append((r[0], total))
        total += r.n
    ahead = spark.createDataFrame(sums, "__part int, __ahead long")  # one row a partition, so the broadcast is bounded
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__ahead") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return rows.join(F.broadcast(ahead), "__part").withColumn("before", before.cast("long")).drop("__part", "__ahead")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def id_columns(key: Column) -> list[Column]:
    """A document's id as k and e, whether it is null: a null would make pandas turn the ids of a batch into floats."""
    k = key.cast("long")
    return [F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("e")]


def ids_of(batch: pd.DataFrame) -> pd.Series:
    """The ids of a batch with id_columns()."""
    return batch["k"].astype("Int64").mask(batch["e"])


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.filter(F.split(text_or_empty(text), rf"[{SPACE}]+"), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on unsigned arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; of the whole if there are fewer, none for none."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + h[i : n - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return out
