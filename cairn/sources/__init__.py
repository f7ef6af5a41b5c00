"""Sources: a name and a reader (spark, options) -> DataFrame with the columns of RECORD.

Options that every reader takes: ``dir``, the folder of its files; ``box`` (west, south, east, north) and ``since``, which
are pushed down as filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "source_id string, source_record_id string, name string, lng double, lat double, modified timestamp"
Reader = Callable[[SparkSession, dict], DataFrame]


def narrowed(df: DataFrame, options: dict) -> DataFrame:
    """df within the options' box and since their time."""
    if options.get("box"):
        west, south, east, north = options["box"]
        df = df.filter(F.col("lng").between(west, east) & F.col("lat").between(south, north))
    if options.get("since"):
        df = df.filter(F.col("modified") >= F.lit(options["since"]).cast("timestamp"))
    return df


def events(spark: SparkSession, options: dict) -> DataFrame:
    rows = spark.read.parquet(f"{options['dir']}/events.parquet")
    none = F.lit(None).cast("double")
    return narrowed(rows.select(F.lit("events").alias("source_id"), F.col("event_id").cast("string").alias("source_record_id"), F.col("event_type").alias("name"), none.alias("lng"), none.alias("lat"), F.col("ts").alias("modified")), options)


def orders(spark: SparkSession, options: dict) -> DataFrame:
    rows = spark.read.parquet(f"{options['dir']}/orders.parquet")
    none = F.lit(None).cast("double")
    return narrowed(rows.select(F.lit("orders").alias("source_id"), F.col("o_orderkey").cast("string").alias("source_record_id"), F.col("o_orderpriority").alias("name"), none.alias("lng"), none.alias("lat"), F.col("o_orderdate").alias("modified")), options)


def customers(spark: SparkSession, options: dict) -> DataFrame:
    """Records with positions: where each customer is put on the map."""
    key = F.col("c_custkey")
    lng, lat = F.lit(-2.6) + key * 7919 % 30000 / 10000.0, F.lit(53.2) + key * 10473 % 16000 / 10000.0
    rows = spark.read.parquet(f"{options['dir']}/customer.parquet")
    seen = F.timestamp_seconds(F.lit(1_700_000_000) + key * 3600)
    return narrowed(rows.select(F.lit("customers").alias("source_id"), key.cast("string").alias("source_record_id"), F.col("c_name").alias("name"), lng.alias("lng"), lat.alias("lat"), seen.alias("modified")), options)


SOURCES: dict[str, Reader] = {"events": events, "orders": orders, "customers": customers}


def write_staging(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Staging sink: Parquet, or CSV with quotes doubled inside quotes."""
    writer = df.write.mode("errorifexists")
    writer.csv(path, header=True, quote='"', escape='"') if form == "csv" else writer.parquet(path)


def read_staging(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True, quote='"', escape='"') if form == "csv" else reader.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report sink: a report of a few rows as one file of JSON lines."""
    df.coalesce(1).write.mode("errorifexists").json(path)
