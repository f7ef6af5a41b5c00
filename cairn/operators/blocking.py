"""Candidate pairs: near each other, or sharing an identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .checkpoints import checkpoint_folder

#: Rows of either side that one group of the join has at most, and how often a crowded cell is halved at most.
CROWDED, HALVINGS = 2000, 8
LEAF = ["level", "lx", "ly"]


def _cells(df: DataFrame, size: float) -> tuple[Column, Column]:
    return geo.cell_of(F.col("lng"), size), geo.cell_of(F.col("lat"), size)


def crowded_leaves(right: DataFrame, size: float, most: int, asking: DataFrame | None = None) -> DataFrame | None:
    """Leaves of a quadtree over the crowded cells: (gx, gy, hx, hy, level, lx, ly, n), a row for each finest cell in use.

    The tree is drawn from counts: those of cells first, then, for cells with more than ``most`` rows of the right, or of
    the left rows that come to it (``asking``, with gx and gy), those of the finest cells in them (4^HALVINGS at most), summed up level by level; a leaf is the largest square that has no
    more than ``most`` rows, or a finest one that has. None if no cell is crowded.
    """
    gx, gy = _cells(right, size)
    cells = right.select(gx.alias("gx"), gy.alias("gy"))
    crowded = cells.groupBy("gx", "gy").count().filter(F.col("count") > most).select("gx", "gy")
    if asking is not None:
        crowded = crowded.union(asking.groupBy("gx", "gy").count().filter(F.col("count") > most).select("gx", "gy")).distinct()
    checkpoint_folder(right.sparkSession)
    crowded = crowded.checkpoint()
    if crowded.isEmpty():
        return None
    fine = 2**HALVINGS
    hx, hy = (F.floor(F.col(x) / F.lit(size) * fine).cast("long") for x in ("lng", "lat"))
    counts = right.select(gx.alias("gx"), gy.alias("gy"), hx.alias("hx"), hy.alias("hy")).join(F.broadcast(crowded), ["gx", "gy"], "left_semi").groupBy("gx", "gy", "hx", "hy").count()
    level, n = F.lit(HALVINGS), F.col("count")
    counts = counts.repartition("gx", "gy")  # all sums below are inside a cell
    for k in range(HALVINGS, 0, -1):
        square = Window.partitionBy("gx", "gy", F.shiftright("hx", k), F.shiftright("hy", k))
        counts = counts.withColumn(f"n{k}", F.sum("count").over(square))
    for k in range(1, HALVINGS + 1):
        level, n = F.when(F.col(f"n{k}") <= most, HALVINGS - k).otherwise(level), F.when(F.col(f"n{k}") <= most, F.col(f"n{k}")).otherwise(n)
    return counts.select("gx", "gy", "hx", "hy", level.cast("int").alias("level"), n.alias("n")).withColumns({"lx": _up("hx"), "ly": _up("hy")})


def _up(fine: str) -> Column:
    """The number of the square of a row's level that holds a finest cell."""
    return F.floor(F.col(fine) / F.pow(F.lit(2.0), F.lit(HALVINGS) - F.col("level"))).cast("long")


def reach(lat: Column, metres: float) -> Column:
    """Degrees of longitude that cover a distance either side of a row at this latitude: 360, all round, if that takes in a pole."""
    up = F.lit(metres * 1.001 / geo.METRES_A_DEGREE)
    top = F.abs(lat) + up
    side = up / F.cos(F.radians(top))
    return F.when((top < 90) & (side < 179), side).when(F.abs(lat) <= 90, 360.0).otherwise(F.least(F.lit(179.0), up * 100))


def images(rows: DataFrame, x: str, aside: str) -> DataFrame:
    """rows, each again where its reach goes over the antimeridian, with x a turn further: what is near there has an x from -180 to 180.

    Longitudes are taken into that range first. A row that reaches all round (360) is there once, so a pair meets once.
    """
    turned = rows.withColumn(x, wrapped(F.col(x)))
    over = F.when((F.col(aside) < 360) & (F.col(x) - F.col(aside) < -180), 360.0).when((F.col(aside) < 360) & (F.col(x) + F.col(aside) >= 180), -360.0)
    return turned.withColumn(x, F.explode(F.when(over.isNull(), F.array(F.col(x))).otherwise(F.array(F.col(x), F.col(x) + over))))


def wrapped(lng: Column) -> Column:
    """Longitude from -180 to 180; what is there already is unchanged."""
    return F.when(lng.between(-180, 180), lng).otherwise(lng - 360 * F.floor((lng + 180) / 360))


def placed() -> Column:
    """Whether a row has a position: two finite numbers."""
    return (F.abs("lng") < float("inf")) & (F.abs("lat") < float("inf"))


def cells_between(low: Column, high: Column, size: float) -> Column:
    """Numbers of the cells from low to high."""
    return F.sequence(geo.cell_of(low, size), geo.cell_of(high, size))


def dealt(left: DataFrame, right: DataFrame, metres: float, size: float | None = None, keep=(), most: int = CROWDED) -> tuple[DataFrame, DataFrame, list[str]]:
    """(a, b, key): both sides dealt into groups by key, so that two rows within a distance meet in exactly one group.

    a has l, x1, y1, aside and the kept columns as l_, b has r, x2, y2 and r_. Only the left side is copied to its
    neighbouring cells, so the right side's rows are shuffled once. A cell is as high as the distance unless a size is
    given, so a row goes to three rows of cells. Crowded cells are split into the leaves of a quadtree, of which a left
    row goes to those in its reach; a leaf's left rows, and the right rows of a finest leaf that is still crowded
    (places at one point), are cut into blocks by hash. So each group has at most ``most`` rows of the right and about
    as many of the left, however the places lie.

    Reach is that of the sphere: over the antimeridian, and all round at a pole. Rows without a position are near
    nothing. a is dealt into as many partitions as shuffles have: groups are of bounded size, and pairs cost far more
    than their rows' bytes tell.
    """
    size = size or max(0.001, metres / geo.METRES_A_DEGREE * 1.001)
    left, right = (df.filter(placed()) for df in (left, right))
    c, up = F.col, F.lit(metres * 1.001 / geo.METRES_A_DEGREE)
    a = images(left.select(c("id").alias("l"), c("lng").alias("x1"), c("lat").alias("y1"), *[c(k).alias(f"l_{k}") for k in keep], reach(c("lat"), metres).alias("aside")), "x1", "aside")
    low, high = F.greatest(F.lit(-180.0), c("x1") - c("aside")), F.least(F.lit(180.0), c("x1") + c("aside"))
    a = a.withColumn("gx", F.explode(cells_between(low, high, size))).withColumn("gy", F.explode(cells_between(c("y1") - up, c("y1") + up, size)))
    right = right.withColumn("lng", wrapped(c("lng")))
    gx, gy = _cells(right, size)
    b = right.select(c("id").alias("r"), c("lng").alias("x2"), c("lat").alias("y2"), *[c(k).alias(f"r_{k}") for k in keep], gx.alias("gx"), gy.alias("gy"))
    leaves = crowded_leaves(right, size, most, a.select("gx", "gy"))
    key = ["gx", "gy"]
    if leaves is not None:
        a, b = _split(a, b, leaves, metres, size, most)
        key = ["gx", "gy", *LEAF, "lb", "rb"]
    return a.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key), b, key


def near_pairs(left: DataFrame, right: DataFrame, metres: float, size: float | None = None, keep=(), most: int = CROWDED) -> DataFrame:
    """(l, r, metres) of all pairs within a distance, by an equi-join of the groups that dealt() makes."""
    a, b, key = dealt(left, right, metres, size, keep, most)
    up = F.lit(metres * 1.001 / geo.METRES_A_DEGREE)
    # files of few bytes may hold many rows, so neither side may be taken for one that can be broadcast
    met = a.join(b.hint("merge"), key).filter((F.abs(F.col("y1") - F.col("y2")) <= up) & (F.abs(F.col("x1") - F.col("x2")) <= F.col("aside")))
    pairs = met.withColumn("metres", geo.haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return pairs.filter(F.col("metres") <= metres).drop(*key, "x1", "y1", "x2", "y2", "aside")


def _split(a: DataFrame, b: DataFrame, leaves: DataFrame, metres: float, size: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the leaf and the blocks that their rows belong to; cells that aren't crowded are leaves of level 0.

    What is broadcast is the table of leaves with their blocks, a small share of most rows each; no side's rows are.
    """
    c, zero = F.col, F.lit(0).cast("long")
    fine = 2**HALVINGS
    cell = ["gx", "gy"]
    checkpoint_folder(leaves.sparkSession)
    squares = leaves.groupBy(*cell, *LEAF).agg(F.max("n").alias("n")).withColumn("rbs", F.ceil(c("n") / most)).checkpoint()
    width = F.lit(size) / F.pow(F.lit(2.0), c("level"))
    up = F.lit(metres * 1.001 / geo.METRES_A_DEGREE)
    aside = c("aside") if "aside" in a.columns else reach(c("y1"), metres)
    reached = (c("x1") + aside >= c("lx") * width) & (c("x1") - aside <= (c("lx") + 1) * width) & (c("y1") + up >= c("ly") * width) & (c("y1") - up <= (c("ly") + 1) * width)
    blocks = a.join(F.broadcast(squares), cell).filter(reached).groupBy(*cell, *LEAF).agg(F.ceil(F.count(F.lit(1)) / most).alias("lbs"))  # a row for each leaf
    squares = squares.drop("n").join(blocks, [*cell, *LEAF], "left").checkpoint()
    numbered = {"level": F.coalesce("level", F.lit(0)), "lx": F.coalesce("lx", zero), "ly": F.coalesce("ly", zero)}
    a = a.join(F.broadcast(squares), cell, "left").filter(c("level").isNull() | reached).withColumns(numbered)
    a = a.withColumns({"lb": F.pmod(F.xxhash64("l"), F.coalesce("lbs", F.lit(1).cast("long"))), "rb": F.explode(F.sequence(zero, F.coalesce(c("rbs") - 1, zero)))}).drop("rbs", "lbs")
    # a right row of a crowded cell asks for the squares of all levels that hold it: one of them is a leaf
    hx, hy = (F.floor(c(x) / F.lit(size) * fine).cast("long") for x in ("x2", "y2"))
    there = b.join(F.broadcast(squares.select(*cell).distinct().withColumn("c", F.lit(True))), cell, "left").withColumns({"hx": hx, "hy": hy})
    there = there.withColumn("level", F.explode(F.when(c("c"), F.sequence(F.lit(0), F.lit(HALVINGS))).otherwise(F.array(F.lit(0)))))
    there = there.withColumns({k: F.when(c("c"), _up(h)).otherwise(zero) for k, h in (("lx", "hx"), ("ly", "hy"))})
    there = there.join(F.broadcast(squares), [*cell, *LEAF], "left").filter(c("c").isNull() | c("lbs").isNotNull())
    there = there.withColumns({"rb": F.coalesce(F.pmod(F.xxhash64("r"), "rbs"), zero), "lb": F.explode(F.sequence(zero, F.coalesce(c("lbs") - 1, zero)))})
    return a, there.drop("rbs", "lbs", "c", "hx", "hy")


def identifier_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) of all pairs that share an identifier; both sides have (id, keys array). No side is broadcast, however small its file."""
    a = left.select(F.col("id").alias("l"), F.explode("keys").alias("key"))
    b = right.select(F.col("id").alias("r"), F.explode("keys").alias("key"))
    return a.join(b.hint("merge"), "key").select("l", "r").distinct()
