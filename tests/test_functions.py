"""Worked examples, guards and invariants of the engine's functions and operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairn.functions import classify, geo, names, rights, temporal, text
from cairn.operators import discovery, publish, reports, visibility
from cairn.operators.requests import SearchRequest
from cairn.plans.substrate import PERIODS


def one(spark, value, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in columns.items()))
    return row.select(value.alias("v")).first().v


def test_grid_worked_example(spark):
    """The mapping agency's worked example, to under a millimetre."""
    got = one(spark, geo.grid_to_osgb36(F.col("e"), F.col("n")), e=651409.903, n=313177.270)
    import math

    lat, lng = math.degrees(got.lat), math.degrees(got.lng)
    assert abs(lat - (52 + 39 / 60 + 27.2531 / 3600)) < 1e-8
    assert abs(lng - (1 + 43 / 60 + 4.5177 / 3600)) < 1e-8


@pytest.mark.parametrize(
    "a, b, apart",
    [
        ("2, Westfield Road", "8, Westfield Road", True),
        ("Sundial to South of Church of St Mary", "Church of St Mary", True),
        ("Bowl barrow 300m south west of Cot Nab Farm", "Bowl barrow 350m west of Cot Nab Farm", True),
        ("Marrick Priory", "Marrick Priory", False),
    ],
)
def test_names_that_denote_distinct_things(spark, a, b, apart):
    assert one(spark, names.distinct_things(names.analyse(F.col("a")), names.analyse(F.col("b"))), a=a, b=b) is apart


def test_generic_names(spark):
    assert one(spark, names.is_generic(F.col("a")), a="Church of St Mary")
    assert not one(spark, names.is_generic(F.col("a")), a="Fountains Abbey")


@pytest.mark.parametrize("name, kind", [("Castle Farmhouse", "monument"), ("Abbeydale Works", "industrial_site"), ("Fountains Abbey", "abbey"), ("Number 5", "unknown")])
def test_place_types(spark, name, kind):
    assert one(spark, classify.place_type(F.col("n"), F.lit(None).cast("string"))["kind"], n=name) == kind


@pytest.mark.parametrize("words, periods", [("Late 17th century barn", ["stuart"]), ("Roman Catholic church", []), ("Roman villa", ["roman"]), ("C18 house", ["georgian"]), ("nothing", [])])
def test_temporal_claims(spark, words, periods):
    got = one(spark, temporal.claims(F.col("t"), F.lit(False), PERIODS), t=words)
    assert [x.period for x in got] == periods


@pytest.mark.parametrize("raw, code", [("CC BY-SA 4.0", "CC-BY-SA-4.0"), ("CC BY-NC-ND 4.0", "UNSUPPORTED"), ("see talk page", "UNKNOWN"), ("PD-old", "PUBLIC-DOMAIN")])
def test_licences(spark, raw, code):
    assert one(spark, rights.licence(F.col("r")), r=raw) == code


def test_text_functions(spark):
    assert one(spark, text.normalise_name(F.col("n")), n="St. Mary's & L'Église") == "st marys and leglise"
    assert one(spark, text.tidy_name(F.col("n")), n="CHURCH OF THE HOLY TRINITY II") == "Church of the Holy Trinity II"
    assert one(spark, text.round_half_up(F.col("x"), 1), x=-0.25) == -0.2
    assert one(spark, text.format_year(F.col("y")), y=-800) == "800 BC"


@pytest.mark.parametrize("box", [None, (1.0, 1.0, 0.0, 2.0), (0.0, 50.0, 5.0, 51.0)])
def test_bad_boxes(box):
    with pytest.raises(ValueError):
        discovery.check_box(box)


def test_search_request():
    assert SearchRequest().problems() == []
    assert len(SearchRequest("x" * 201, 0.0, 500, -1).problems()) == 4


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (None, "m", 3)], "k int, v string, o int")
    once = publish.upsert(old, new, ["k"], "o")
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "c", 2), (2, "d", 1), (None, "m", 3)]
    again = publish.upsert(once, new, ["k"], "o")
    assert again.exceptAll(once).count() == 0


def test_slugs_are_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a")], "i int, base string")
    slugs = [r.slug for r in reports.unique_slugs(df, "base", "i").collect()]
    assert len(set(slugs)) == 4


def test_visibility(spark):
    df = spark.createDataFrame([(1, "approved", 7), (2, "submitted", 8)], "id int, status string, owner_id int")
    assert visibility.by_status(df, visibility.Actor()).count() == 1
    assert visibility.by_status(df, visibility.Actor(1, "editor")).count() == 2
    assert visibility.moderated(df, visibility.Actor(8)).count() == 2
    assert visibility.staging(df, visibility.Actor()).count() == 0


def test_box_is_pushed_to_the_scan(spark):
    """A viewport over stored places reads only the columns and rows it needs."""
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-places-") + "/places"
    spark.createDataFrame([(1, "x", 0.5, 50.5, "approved", "k")], "id long, name string, lng double, lat double, status string, other string").write.parquet(path)
    plan = spark.read.parquet(path).filter("status = 'approved'").filter(geo.in_box(F.col("lng"), F.col("lat"), (0.0, 50.0, 1.0, 51.0))).groupBy(geo.cell_of(F.col("lng"), 0.1)).count()
    said = plan._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(" in said and "ReadSchema: struct<lng:double,lat:double,status:string>" in said
