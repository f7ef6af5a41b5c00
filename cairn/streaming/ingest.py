"""Incremental ingestion: a file stream of source records, each batch published into the next version of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.publish import upsert
from ..operators.versions import bucket_of, expire, listed, read, touched_buckets, versions, write

__all__ = ["current", "expire", "ingest", "late_counts", "listed", "publisher", "versions"]
KEY = ["source_id", "source_record_id"]
_listed = listed


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table: the last version of each bucket."""
    return read(spark, root, schema)


def publisher(root: str, schema: str, key: list[str] = KEY, order: str = "modified", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch function that upserts into version batch + 1, which holds only the buckets of keys that the batch touches.

    A batch that runs again after a failure writes the same version from the same ones before it.
    """

    def publish(batch: DataFrame, number: int) -> None:
        touched = touched_buckets(batch, key, buckets)
        old = read(batch.sparkSession, root, schema, touched, number)
        write(upsert(old, batch, key, order), root, number + 1, touched, bucket_of(key, buckets))

    return publish


def ingest(spark: SparkSession, source: str, root: str, schema: str, checkpoint: str) -> StreamingQuery:
    """Publishes the Parquet files that appear in ``source``, all there are now, then stops."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(publisher(root, schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(rows: DataFrame, time: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Records per source and window of event time; records later than the watermark are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "source_id").agg(F.count(F.lit(1)).alias("n")).select("window.start", "source_id", "n")
