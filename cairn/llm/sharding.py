"""Shards by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, text_or_empty

#: Multiplier of the published 64-bit generator, in 16-bit limbs from the lowest.
MULTIPLIER = 2862933555777941757
LIMBS = [(MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48)]
LOW32 = 0xFFFFFFFF
ROWS_A_BUCKET = 1000


def _low32(x: Column, a: int, b: int) -> Column:
    """x * (b * 2**16 + a) modulo 2**32, for x below 2**32."""
    return (x * F.lit(a) + (x * F.lit(b)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(LOW32))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the 64-bit generator on two 32-bit halves, free of overflow."""
    mid = lo * F.lit(LIMBS[1])
    low = lo * F.lit(LIMBS[0]) + F.lit(1) + mid.bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    carry = F.shiftright(low, 32) + F.shiftright(mid, 16)
    high = carry + _low32(hi, LIMBS[0], LIMBS[1]) + _low32(lo, LIMBS[2], LIMBS[3])
    return high.bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump_hash(key: Column, n_shards: int) -> Column:
    """Struct (shard, grown): the shard of a long key among n_shards and among one more.

    The jumps only go up, so n_shards + 1 steps always suffice; steps past the last jump change nothing.
    A null key counts as -1.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("shard"),
        F.lit(-1).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("jump"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(LOW32)).alias("lo"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        jump = F.floor((s["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(s["jump"] > n_shards, s).otherwise(
            F.struct(
                F.when(s["jump"] < n_shards, s["jump"]).otherwise(s["shard"]).alias("shard"),
                s["jump"].alias("grown"),
                jump.cast("long").alias("jump"),
                hi.alias("hi"),
                lo.alias("lo"),
            )
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(n_shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def with_shards(df: DataFrame, key: str, n_shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with its shard and the shard it would have with one more; no shuffle. Columns of these names are replaced."""
    told = df.select(F.struct("*").alias("row"), jump_hash(F.col(key), n_shards).alias("jump"))
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in (shard, grown)]
    return told.select(*kept, F.col("jump.shard").alias(shard), F.col("jump.grown").alias(grown))


def shard_slots(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    Slots count the rows of a shard without gaps from 0. A shard is never sorted in one task: rows are numbered
    inside hash buckets of about ROWS_A_BUCKET rows, and the buckets' offsets come from their counts. Repeated
    rows are counted before the shuffle and unfolded at the end. Null text: size 1, checksum of no bytes.
    Null key: as -1. An empty table gives no rows. Other columns of docs are not read.
    """
    store = Store(docs.sparkSession, "shards")
    body = text_or_empty(F.col(text))
    rows = (
        docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    rows = store.keep(with_shards(rows, "doc_id", n_shards))
    buckets = max(1, -(-rows.count() // (n_shards * ROWS_A_BUCKET)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    return (
        rows.join(offsets, ["shard", "bucket"])
        .withColumn("first", first)
        .withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    )
