"""Checks of requests as Column expressions, so that whole tables of them are judged at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .discovery import MAX_SPAN

#: Bounds of what a request may ask or say.
LONGEST_TEXT, WIDEST_M, ROWS, STARS, LONGEST_VISIT = 200, 200_000, (1, 100), (1, 5), 1440


def first_problem(*tests: tuple[Column, str]) -> Column:
    """The first problem that holds, or ok. A test that is null doesn't hold."""
    out = F.when(F.coalesce(tests[0][0], F.lit(False)), tests[0][1])
    for bad, why in tests[1:]:
        out = out.when(F.coalesce(bad, F.lit(False)), why)
    return out.otherwise("ok")


def problems(*tests: tuple[Column, str]) -> Column:
    """All problems that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in tests]))


def box_problem(west: Column, south: Column, east: Column, north: Column) -> Column:
    return first_problem(
        (west.isNull() | south.isNull() | east.isNull() | north.isNull(), "missing"), ((east <= west) | (north <= south), "empty or inverted"),
        ((east - west > MAX_SPAN[0]) | (north - south > MAX_SPAN[1]), "too wide"),
    )


def search_problems(words: Column, radius_m: Column, limit: Column, offset: Column) -> Column:
    return problems((F.length(words) > LONGEST_TEXT, "text"), ((radius_m <= 0) | (radius_m > WIDEST_M), "radius"), (~limit.between(*ROWS), "limit"), (offset < 0, "offset"))


def visit_problems(rating: Column, minutes: Column) -> Column:
    """Of a review: stars, and a visit of at most a day."""
    return problems((rating.isNull() | ~rating.between(*STARS), "rating"), (~minutes.between(0, LONGEST_VISIT), "minutes"))


def suggestion_problems(name: Column, lng: Column, lat: Column, kind: Column, kinds: list[str]) -> Column:
    """Of a suggested place: a name of 2 to 200 characters, a possible position, a known kind."""
    return problems((name.isNull() | ~F.length(F.trim(name)).between(2, LONGEST_TEXT), "name"), (lng.isNull() | lat.isNull() | (F.abs(lng) > 180) | (F.abs(lat) > 90), "position"), (kind.isNotNull() & ~kind.isin(kinds), "kind"))


def century_of(year: Column) -> Column:
    """The century of a year: 1 to 100 is the first, 100 to 1 BC the first before."""
    return F.when(year > 0, F.ceil(year / 100.0)).when(year < 0, F.floor(year / 100.0)).cast("long")


def period_of_spans(spans: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """(key, period) of spans (key, start_year, end_year): the period that holds most of a span, the earlier one of equals.

    Periods are a registry of fixed size, so they are broadcast; a span meets only those it overlaps.
    """
    p = periods.select(F.col("id").alias("__period"), "display_order", F.col("start_year").alias("p0"), F.col("end_year").alias("p1"))
    years = F.least("end_year", "p1") - F.greatest("start_year", "p0")
    met = spans.join(F.broadcast(p), (F.col("start_year") <= F.col("p1")) & (F.col("end_year") >= F.col("p0"))).withColumn("years", years)
    return met.groupBy(key).agg(F.max_by("__period", F.struct("years", -F.col("display_order"))).alias("period"))
