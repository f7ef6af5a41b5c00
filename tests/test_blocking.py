"""Near pairs against brute force, however crowded the places are."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import blocking

SCHEMA = "id long, lng double, lat double, name string"


def places(n, seed, crowd=0.5, spread=0.004):
    """Half in one small square, some of them at one point, the rest wide; two without a position."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 10 == 0 and crowd:
            lng, lat = -1.5, 53.9
        elif rng.random() < crowd:
            lng, lat = -1.5 + rng.uniform(-spread, spread), 53.9 + rng.uniform(-spread, spread)
        else:
            lng, lat = rng.uniform(-1.6, -1.4), rng.uniform(53.8, 54.0)
        out.append((i, lng, lat, f"n{i}"))
    return out + [(10**6, None, 53.9, "x"), (10**6 + 1, -1.5, None, "y")]


def near(a, b, metres):
    def distance(p, q):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, r[1:3])) for r in (p, q))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))

    there = lambda rows: [r for r in rows if r[1] is not None and r[2] is not None]
    return sorted((p[0], q[0]) for p in there(a) for q in there(b) if distance(p, q) <= metres)


@pytest.mark.parametrize("metres, size, most", [(500.0, None, 20), (500.0, None, 5), (120.0, 0.05, 40), (3000.0, None, 100), (500.0, None, 2000)])
def test_pairs_meet_once(spark, metres, size, most):
    a, b = places(300, 1), places(400, 2)
    got = blocking.near_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), metres, size, keep=("name",), most=most)
    rows = got.collect()
    assert sorted((r.l, r.r) for r in rows) == near(a, b, metres)
    assert all(r.l_name == f"n{r.l}" and r.r_name == f"n{r.r}" for r in rows) and set(got.columns) == {"l", "r", "l_name", "r_name", "metres"}


def test_groups_of_a_crowded_cell_are_bounded(spark):
    """With half of all places in one cell and a tenth at one point, no group of the join is over the bound."""
    rows = spark.createDataFrame(places(4000, 3, 0.6, 0.01), SCHEMA).filter("lng IS NOT NULL AND lat IS NOT NULL")
    size, most = 0.02, 100
    leaves = blocking.crowded_leaves(rows, size, most)
    gx, gy = (blocking.geo.cell_of(F.col(x), size) for x in ("lng", "lat"))
    a = rows.select(F.col("id").alias("l"), F.col("lng").alias("x1"), F.col("lat").alias("y1"), gx.alias("gx"), gy.alias("gy"))
    b = rows.select(F.col("id").alias("r"), F.col("lng").alias("x2"), F.col("lat").alias("y2"), gx.alias("gx"), gy.alias("gy"))
    a, b = blocking._split(a, b, leaves, 1000.0, size, most)
    key = ["gx", "gy", *blocking.LEAF, "lb", "rb"]
    for side in (a, b):
        sizes = [r["count"] for r in side.groupBy(*key).count().collect()]
        assert max(sizes) <= 1.6 * most and sum(sizes) >= 4000
    plain = rows.groupBy(gx, gy).count().agg(F.max("count")).first()[0]
    assert plain > 8 * most


def test_a_crowded_left_side_is_split_too(spark):
    a, b = places(600, 5, 0.9), places(30, 6, 0.0)
    frames = [spark.createDataFrame(x, SCHEMA) for x in (a, b)]
    assert sorted((r.l, r.r) for r in blocking.near_pairs(*frames, 2000.0, most=50).collect()) == near(a, b, 2000.0)


def test_nothing_crowded_or_nothing_at_all(spark):
    rows = spark.createDataFrame(places(50, 4, 0.0), SCHEMA)
    assert blocking.crowded_leaves(rows.filter("lng IS NOT NULL AND lat IS NOT NULL"), 0.05, 2000) is None
    assert blocking.near_pairs(rows.limit(0), rows, 500.0).count() == blocking.near_pairs(rows, rows.limit(0), 500.0).count() == 0


def test_pairs_meet_over_the_antimeridian_and_at_the_poles(spark):
    """Reach is that of the sphere: what brute force finds near, at any longitude and latitude, is found once."""
    rng = random.Random(7)
    rows = [(x, y) for x in (180.0, -180.0, 179.99, -179.99, 179.999, 180.01, 0.0, 90.0, -90.0) for y in (-17.0, 0.0, 88.95, 89.99, -89.999, 90.0)]
    rows += [(rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(89.93, 90)) for _ in range(60)] + [(rng.choice([-1, 1]) * rng.uniform(179.98, 180), rng.uniform(-17, -16.9)) for _ in range(60)]
    a, b = ([(i, *rows[i], f"n{i}") for i in range(len(rows)) if i % 3 != k] for k in (0, 1))
    frames = [spark.createDataFrame([*x, (10**6, math.nan, 1.0, "z"), (10**6 + 1, 1.0, math.inf, "z")], SCHEMA) for x in (a, b)]
    for metres, most in ((5000.0, 2000), (5000.0, 10), (300.0, 2000)):
        assert sorted((r.l, r.r) for r in blocking.near_pairs(*frames, metres, size=0.5, most=most).collect()) == near(a, b, metres)
