"""Numbers and running sums over a whole order, without a task that holds it all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpoint_folder


def cumulated(df: DataFrame, order: list[str | Column], weight: Column | None = None, name: str = "before") -> DataFrame:
    """df with the sum of a whole-numbered weight (1 if none is given) over all rows ahead in the order.

    Rows are dealt by ranges of the order, so a hot key is spread like any other, and one sum for each partition goes
    to the driver. The dealt rows are checkpointed, as ranges are drawn anew each time. Equal rows of the order follow
    each other in any order.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__w", F.lit(1) if weight is None else weight).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    total, sums = 0, []
    for part, n in rows.groupBy("__part").agg(F.sum("__w").cast("long")).orderBy("__part").collect():
        sums.append((part, total))
        total += n or 0
    ahead = spark.createDataFrame(sums, "__part int, __ahead long")  # a row a partition, so the broadcast is bounded
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__ahead") + F.coalesce(F.sum("__w").over(within), F.lit(0))
    return rows.join(F.broadcast(ahead), "__part").withColumn(name, before.cast("long")).drop("__w", "__part", "__ahead")


def cumulated_within(df: DataFrame, keys: list[str], order: list[str | Column], weight: Column | None = None, name: str = "before") -> DataFrame:
    """df with the sum of a weight over the rows ahead in the order of each key. Null keys are equal to each other."""
    rows = cumulated(df, [*keys, *order], weight, name)
    first = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(name).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(first, same).withColumn(name, F.col(name) - F.col("__first")).select(*df.columns, name)


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): each distinct value of a key, how often it occurs and how many rows are below it."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("n").alias("total"))
    ranked = cumulated_within(counts, keys, [value], F.col("n"))
    return ranked.join(totals, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])


#: Keys times wanted ranks that selection takes on, and rows that one of its rounds sends to the driver, at most.
SELECTED, BUCKETS = 2_000, 200_000


def _spread(x: Column, curved: bool) -> Column:
    """A number that rises with x; curved, so that values over many magnitudes lie apart too."""
    d = x.cast("double")
    return F.signum(d) * F.log1p(F.abs(d)) if curved else d


def selected(df: DataFrame, keys: list[str], value: str, ranks_of) -> tuple[list[tuple], list[tuple]] | None:
    """([key tuple], [(key number, rank, value)]): values of given ranks of each key, without sorting the values.

    Each round counts the rows of every range that still holds a wanted rank by buckets of equal width between its least
    and greatest value, and goes on with the buckets that hold one, until a range is a single value. A round is one
    aggregate with a bounded result (BUCKETS rows); widths are even in the values and in their logarithms by turns, so
    ranges shrink whatever the values' distribution. ``ranks_of(n)`` gives the ranks, from 0, wanted of n rows. None if
    there are more keys than SELECTED, or if values differ that are equal as doubles.
    """
    spark, v = df.sparkSession, F.col(value)
    rows = df.filter(v.isNotNull()).select(*keys, value)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(v).alias("__lo"), F.max(v).alias("__hi")).limit(SELECTED + 1).collect()
    if len(stats) * max((len(ranks_of(r["__n"])) for r in stats), default=0) > SELECTED:
        return None
    names = [tuple(r[k] for k in keys) for r in stats]
    done: list[tuple] = []
    # (key number, least, greatest, rows below it in the key, wanted ranks)
    left = [(i, r["__lo"], r["__hi"], 0, sorted(ranks_of(r["__n"]))) for i, r in enumerate(stats)]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`__{k}` {kinds[k]}" for k in keys] + ["__range int", f"__a {kinds[value]}", f"__b {kinds[value]}"])
    for turn in range(200):
        done += [(i, rank, lo) for i, lo, hi, _, ranks in left if lo == hi for rank in ranks]
        left = [x for x in left if x[1] != x[2]]
        if not left:
            return names, done
        ranges = spark.createDataFrame([(*names[i], n, lo, hi) for n, (i, lo, hi, _, _) in enumerate(left)], schema)
        buckets = max(2, min(1024, BUCKETS // len(left)))
        low, high, x = (_spread(F.col(c), turn % 2 == 1) for c in ("__a", "__b", value))
        share = F.floor((x - low) / (high - low) * buckets)
        at = F.when(v == F.col("__a"), 0).when(v == F.col("__b"), buckets - 1).otherwise(F.coalesce(F.least(F.greatest(share, F.lit(0)), F.lit(buckets - 1)), F.lit(buckets // 2)))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        met = rows.join(F.broadcast(ranges), [*same, v.between(F.col("__a"), F.col("__b"))])
        counted = met.groupBy("__range", at.cast("int").alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"), F.min(v).alias("__lo"), F.max(v).alias("__hi")).orderBy("__range", "__bucket").collect()
        after, below = [], {n: x[3] for n, x in enumerate(left)}
        for r in counted:
            n = r["__range"]
            inside = [k for k in left[n][4] if below[n] <= k < below[n] + r["__n"]]
            if inside:
                after.append((left[n][0], r["__lo"], r["__hi"], below[n], inside))
            below[n] += r["__n"]
        if after == left:
            return None
        left = after
    return None


def _selected(df: DataFrame, keys: list[str], value: str, ranks_of, row_of, schema: str) -> DataFrame | None:
    got = selected(df, keys, value, ranks_of)
    if got is None:
        return None
    names, found = got
    held: list[dict] = [{} for _ in names]
    for i, rank, x in found:
        held[i][rank] = x
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(*name, *row_of(x)) for name, x in zip(names, held, strict=True)], ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [schema]))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the key: the one of rank ceil(p / 100 * n). By selection, or by ranks of all values
    if there are very many keys."""
    rank = lambda p, n: max(1, math.ceil(p / 100.0 * n)) - 1
    wanted = lambda n: {rank(p, n) for p in percents.values()} | {n - 1}
    row = lambda x: [x[rank(p, max(x) + 1)] for p in percents.values()]
    chosen = _selected(df, keys, value, wanted, row, ", ".join(f"`{k}` {dict(df.dtypes)[value]}" for k in percents))
    if chosen is not None:
        return chosen

    def at(p: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p / 100.0) * F.col("total")))
        return F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("n")), F.col(value)))

    return value_ranks(df, keys, value).groupBy(*keys).agg(*[at(p).alias(k) for k, p in percents.items()])


def interpolated(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbouring values; by selection, or by ranks of all values
    if there are very many keys."""

    def wanted(n: int) -> set[int]:
        return {f(p / 100.0 * (n - 1)) for p in percents.values() for f in (math.floor, math.ceil)} | {n - 1}

    def row(x: dict) -> list[float]:
        n = max(x) + 1
        out = []
        for p in percents.values():
            at = p / 100.0 * (n - 1)
            low, high = float(x[math.floor(at)]), float(x[math.ceil(at)])
            out.append(low + (high - low) * (at - math.floor(at)))
        return out

    chosen = _selected(df, keys, value, wanted, row, ", ".join(f"`{k}` double" for k in percents))
    if chosen is not None:
        return chosen

    def parts(p: float) -> list[Column]:
        at = F.lit(p / 100.0) * (F.col("total") - 1)
        held = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
        return [held(F.floor(at)), held(F.ceil(at)), F.max(at - F.floor(at))]

    found = {f"__{k}_{i}": x for k, p in percents.items() for i, x in enumerate(parts(p))}
    out = value_ranks(df, keys, value).groupBy(*keys).agg(*[x.alias(k) for k, x in found.items()])
    return out.select(*keys, *[(F.col(f"__{k}_0") + (F.col(f"__{k}_1") - F.col(f"__{k}_0")) * F.col(f"__{k}_2")).alias(k) for k in percents])


def ordered_digest(df: DataFrame, keys: list[str], order: list[str], content: Column, chunk: int = 1000, between: str = "\n") -> DataFrame:
    """(keys, digest): the digest of a key's rows in order, by the digests of chunks of so many rows, joined and hashed again.

    A chunk is at most ``chunk`` rows in one array, and the last step has one digest for each, so no row holds a group.
    """
    rows = cumulated_within(df.select(*keys, *order, content.alias("__content")), keys, order)
    chunks = rows.groupBy(*keys, F.floor(F.col("before") / chunk).alias("__chunk")).agg(F.array_sort(F.collect_list(F.struct("before", "__content"))).alias("r"))
    digests = chunks.select(*keys, "__chunk", F.sha2(F.array_join(F.transform("r", lambda x: x["__content"]), between), 256).alias("d"))
    whole = digests.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__chunk", "d"))).alias("r"))
    return whole.select(*keys, F.sha2(F.array_join(F.transform("r", lambda x: x["d"]), between), 256).alias("digest"))
