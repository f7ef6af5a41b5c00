"""Reports: histograms, percentiles, shares, gates and digests over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cumulated, cumulated_within


def histogram(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, cause: Column, example: str, order: str) -> DataFrame:
    """(cause, n, share, example): share of all rows to 4 places and the example of least order."""
    by = df.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.min_by(example, order).alias("example"))
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row, so the broadcast is bounded
    return by.join(F.broadcast(total)).select("cause", "n", F.round(F.col("n") / F.greatest("total", F.lit(1)), 4).alias("share"), "example")


def gates(measured: DataFrame, tests: dict[str, tuple[Column, bool]]) -> DataFrame:
    """(gate, verdict, blocking) of each test over one row of figures; a null figure isn't evaluated."""
    rows = [F.struct(F.lit(k).alias("gate"), F.when(t.isNull(), "not-evaluated").when(t, "pass").otherwise("fail").alias("verdict"), F.lit(b).alias("blocking")) for k, (t, b) in tests.items()]
    return measured.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose key has the least digest: the same rows on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def even_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows spread evenly over the order: those numbered floor(i * rows / n)."""
    numbered = cumulated(df, [order], name="__rn")
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row, so the broadcast is bounded
    rn, rows = F.col("__rn"), F.col("__total")
    at = F.ceil(rn * n / rows)
    picked = numbered.join(F.broadcast(total)).filter((F.floor(at * rows / n) == rn) & (at < n) | (rows <= n))
    return picked.drop("__rn", "__total")


def multiset_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of rows that only one side has, or that differ between the sides."""
    fields = [c for c in left.columns if c != key]
    a, b = left.select(key, F.struct(*fields).alias("a")), right.select(key, F.struct(*fields).alias("b"))
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return a.join(b, key, "full").select(key, verdict.alias("verdict")).filter("verdict IS NOT NULL")


def unique_slugs(df: DataFrame, base: str, order: str) -> DataFrame:
    """df with ``slug``: in order, the first of base, base-2, base-3 ... that no row before has.

    Each row starts with its number within its base. Of rows with one slug the first in order keeps it; the others
    learn that the number is taken in their base for all rows behind its owner, and every row takes its number anew
    among those that are free for it. Rounds go on until no slug is shared, however many that takes; each is
    checkpointed.
    """
    rows = cumulated_within(df.select(F.col(base).alias("__base"), F.col(order).alias("__order")), ["__base"], ["__order"], name="__m").withColumn("__m", F.col("__m") + 1)
    taken = None
    while True:
        number = F.col("__m")
        if taken is not None:
            by_base = taken.groupBy("__b").agg(F.array_sort(F.collect_list(F.struct("__n", "__owner"))).alias("__taken"))
            free = F.aggregate("__taken", F.col("__m"), lambda k, t: F.when((t["__n"] <= k) & (t["__owner"] < F.col("__order")), k + 1).otherwise(k))
            number = F.coalesce(free, F.col("__m"))
        now = rows if taken is None else rows.join(by_base, F.col("__base") == F.col("__b"), "left")
        now = now.select("__base", "__order", "__m", number.alias("__k"))
        now = now.withColumn("slug", F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), F.col("__k").cast("string")))).checkpoint()
        shared = now.groupBy("slug").agg(F.min("__order").alias("__owner"), F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
        lost = now.join(shared, "slug").filter("__order > __owner").select(F.col("__base").alias("__b"), F.col("__k").alias("__n"), "__owner").checkpoint()
        if not lost.limit(1).count():
            return df.join(now.select(F.col("__order").alias("__o"), "slug"), F.col(order) == F.col("__o")).drop("__o")
        taken = (lost if taken is None else taken.unionByName(lost)).groupBy("__b", "__n").agg(F.min("__owner").alias("__owner")).checkpoint()
