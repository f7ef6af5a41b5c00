"""Matching inside the run: each batch is decided against the canonical records of the batches before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.blocking import cells_between, images, placed, reach, wrapped
from ..operators.checkpoints import checkpoint_folder
from ..operators.matching import FARTHEST_M, FIELDS, identifier_keys, resolve
from ..operators.versions import bucket_of, read, touched_buckets, write

#: Degrees of the squares that canonical records are stored by.
SQUARE = 0.25
DECISIONS = "id long, outcome string, matched long, confidence double"


def _square(x: str):
    return geo.cell_of(wrapped(F.col(x)) if x == "lng" else F.col(x), SQUARE)


def _reached(rows: DataFrame) -> DataFrame:
    """(sx, sy) of the squares that hold anything near the rows."""
    up = FARTHEST_M * 1.001 / geo.METRES_A_DEGREE
    there = rows.filter(placed()).select(F.col("lng").alias("x"), F.col("lat").alias("y"), reach(F.col("lat"), FARTHEST_M).alias("aside"))
    there = images(there, "x", "aside")
    low, high = F.greatest(F.lit(-180.0), F.col("x") - F.col("aside")), F.least(F.lit(180.0), F.col("x") + F.col("aside"))
    wide = there.select(F.explode(cells_between(low, high, SQUARE)).alias("sx"), "y")
    return wide.select("sx", F.explode(cells_between(F.col("y") - up, F.col("y") + up, SQUARE)).alias("sy")).distinct()


def matcher(root: str, buckets: int = 64) -> Callable[[DataFrame, int], DataFrame]:
    """A batch function that decides prepared records and adds those that become canonical to the tables under root.

    Canonical records are stored twice: by the square they lie in and by each of their identifiers. A batch reads only
    the buckets of squares in its reach and of its own identifiers, and rewrites only those its new records belong to.
    Records of a later batch come after all earlier ones, so batches give what one run over all of them gives. A batch
    that runs again reads the same versions and writes the same. It returns its decisions, which are kept as well.
    """
    places, keys = f"{root}/places", f"{root}/keys"

    def decide(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        checkpoint_folder(spark)
        own = batch if "keys" in batch.columns else batch.withColumn("keys", identifier_keys(qid=F.col("qid")))
        rows = own.select("id", "lng", "lat", *FIELDS, "keys").checkpoint()
        by_square, by_key = f"sx long, sy long, {_ddl(rows)}", f"key string, {_ddl(rows)}"
        reached = _reached(rows)
        near = read(spark, places, by_square, touched_buckets(reached, ["sx", "sy"], buckets), number)
        near = near.join(reached, ["sx", "sy"], "left_semi").drop("sx", "sy")
        asked = rows.select(F.explode("keys").alias("key")).distinct()
        known = read(spark, keys, by_key, touched_buckets(asked, ["key"], buckets), number)
        identified = known.join(asked, "key", "left_semi").drop("key").dropDuplicates(["id"])
        told = resolve(rows, near, identified).checkpoint()
        new = rows.join(told.filter("outcome = 'NEW_CANONICAL'").select("id"), "id", "left_semi")
        in_squares = new.filter(placed()).select(_square("lng").alias("sx"), _square("lat").alias("sy"), *rows.columns)
        in_keys = new.select(F.explode("keys").alias("key"), *rows.columns)
        for table, added, key, ddl in ((places, in_squares, ["sx", "sy"], by_square), (keys, in_keys, ["key"], by_key)):
            touched = touched_buckets(added, key, buckets)
            write(read(spark, table, ddl, touched, number).unionByName(added), table, number + 1, touched, bucket_of(key, buckets))
        told.write.mode("overwrite").parquet(f"{root}/decisions/batch={number}")
        return told

    return decide


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """All decisions so far."""
    return spark.read.schema(f"{DECISIONS}, batch int").option("basePath", f"{root}/decisions").parquet(f"{root}/decisions/*").drop("batch")
