"""The SQL functions give what the builders give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn import sql
from cairn.operators import discovery as op
from cairn.plans.discovery import BOX, tables

from .conftest import SMALL


@pytest.fixture(scope="module")
def t(spark):
    made = tables(spark, SMALL)
    sql.register(spark, made)
    return made


@pytest.mark.parametrize(
    "call, options",
    [
        ("", {}),
        ("words => 'machinery'", {"words": "machinery"}),
        ("words => '-machinery town'", {"words": "-machinery town"}),
        ("words => '\"town 3\" or furniture'", {"words": '"town 3" or furniture'}),
        ("kinds => array('church', 'castle'), level => 2", {"types": ["church", "castle"], "level": 2}),
        ("lng => -1.5e0, lat => 53.9e0, radius_m => 30000e0", {"centre": (-1.5, 53.9), "radius_m": 30000.0}),
        ("words => 'building', lng => -1.5e0, lat => 53.9e0, max_cost => 5000e0", {"words": "building", "centre": (-1.5, 53.9), "max_cost": 5000.0}),
    ],
)
def test_search_places(spark, t, call, options):
    got = [tuple(r) for r in spark.sql(f"SELECT * FROM search_places({call})").collect()]
    assert got == [tuple(r) for r in op.search_places(t, **options).collect()] and (got or "town 3" in call)


def test_map_clusters(spark, t):
    got = [tuple(r) for r in spark.sql(f"SELECT * FROM map_clusters({', '.join(f'{x}e0' for x in BOX)}, 0.1e0)").collect()]
    assert got and got == [tuple(r) for r in op.map_clusters(t, BOX, 0.1).collect()]


def test_places_of_period(spark, t):
    got = {r.place_id for r in spark.sql("SELECT * FROM places_of_period('roman')").collect()}
    assert got and got == {r.place_id for r in op.places_of_period(t.temporal, t.periods, "roman").collect()}


@pytest.mark.parametrize("query", ["hall", "hall -railings", '"south west"', 'railings or "south west"', "-hall", '"a or b"', "", "or", "hall or", "x1 hall"])
def test_web_matches(spark, t, query):
    texts = ["The Hall", "Hall, railings", "south west of it", "west south", "a or b", "a b", "", None, "x1 hall"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [r.m for r in df.select(F.call_function("web_matches", "text", F.lit(query)).alias("m")).collect()]
    assert got == [r.m for r in df.select(op.matches_words(op.text_tokens(F.col("text")), query).alias("m")).collect()]
