"""Discovery: search, viewport markers and density clusters, as DataFrame builders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .checkpoints import checkpoint_folder

Box = tuple[float, float, float, float]
#: The widest viewport, in degrees, and the bounds of rows and cells.
MAX_SPAN = (2.5, 1.5)
MAX_MARKERS, MAX_CELLS, MAX_FOUND = 500, 2000, 100
MIN_CELL, MAX_CELL = 0.005, 5.0


@dataclass
class Filters:
    """What a discovery query may ask for; None asks for nothing."""

    types: list[str] | None = None
    words: str | None = None
    designations: list[str] | None = None
    period: str | None = None
    from_year: int | None = None
    to_year: int | None = None
    needs_image: bool = False


@dataclass
class Tables:
    """The tables that discovery reads; only those a query needs are scanned."""

    places: DataFrame
    designations: DataFrame | None = None
    temporal: DataFrame | None = None
    periods: DataFrame | None = None
    images: DataFrame | None = None
    rights: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def check_box(box: Box | None, widest: tuple[float, float] | None = MAX_SPAN) -> Box:
    """The box, or ValueError if it is missing, empty, inverted or too wide."""
    if box is None or any(x is None for x in box):
        raise ValueError("a bounding box is required")
    west, south, east, north = box
    if east <= west or north <= south:
        raise ValueError("the bounding box is empty or inverted")
    if widest and (east - west > widest[0] or north - south > widest[1]):
        raise ValueError(f"the bounding box is wider than {widest[0]} x {widest[1]} degrees")
    return box


def text_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def matches_words(tokens: Column, wanted: str) -> Column:
    """Web-search syntax: words are all needed, "a phrase" in a row, -word not, or between alternatives."""
    import re

    groups: list[list[Column]] = [[]]
    for phrase, minus, word in re.findall(r'"([^"]*)"|(-?)([\w]+)', wanted.lower()):
        if word == "or" and not minus:
            groups.append([])
            continue
        parts = re.findall(r"[a-z0-9]+", phrase or word)
        if not parts:
            continue
        if len(parts) == 1:
            test = F.array_contains(tokens, parts[0])
        else:
            joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
            test = joined.contains(f" {' '.join(parts)} ")
        groups[-1].append(~test if minus else test)
    tests = []
    for group in groups:
        if group:
            whole = group[0]
            for t in group[1:]:
                whole = whole & t
            tests.append(whole)
    out = F.lit(True) if not tests else tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def thumbnails(images: DataFrame, rights: DataFrame) -> DataFrame:
    """(place_id, thumbnail_url): each place's first approved image with a thumbnail and an attribution."""
    good = images.filter("status = 'approved' AND thumbnail_url IS NOT NULL").join(rights.filter("attribution IS NOT NULL AND licence <> 'UNSUPPORTED'"), images["id"] == rights["image_id"])
    return good.groupBy("place_id").agg(F.min(F.struct("seq", "id", "thumbnail_url"))["thumbnail_url"].alias("thumbnail_url"))


def places_of_period(temporal: DataFrame, periods: DataFrame, period: str) -> DataFrame:
    """place_id of places with an approved claim of this period, or one whose years overlap it."""
    span = periods.filter(F.col("id") == period).select(F.col("start_year").alias("p0"), F.col("end_year").alias("p1"))
    claims = temporal.filter("status = 'approved'")
    overlap = (F.col("start_year") <= F.col("p1")) & (F.col("end_year") >= F.col("p0"))
    return claims.join(F.broadcast(span)).filter((F.col("period_id") == period) | overlap).select("place_id").distinct()


def places_of_years(temporal: DataFrame, from_year: int | None, to_year: int | None) -> DataFrame:
    claims = temporal.filter("status = 'approved' AND start_year IS NOT NULL AND end_year IS NOT NULL")
    if to_year is not None:
        claims = claims.filter(F.col("start_year") <= to_year)
    if from_year is not None:
        claims = claims.filter(F.col("end_year") >= from_year)
    return claims.select("place_id").distinct()


def matching_places(t: Tables, box: Box, f: Filters) -> DataFrame:
    """Public places in the box that pass the filters: scans and semi joins, all before any aggregate."""
    out = t.places.filter("status = 'approved'").filter(geo.in_box(F.col("lng"), F.col("lat"), box))
    if f.types:
        out = out.filter(F.col("place_type").isin(f.types))
    if f.words:
        out = out.filter(matches_words(text_tokens(F.concat_ws(" ", "name", "town", "county")), f.words))

    def having(found: DataFrame) -> DataFrame:
        return out.join(found.select(F.col("place_id").alias("id")), "id", "left_semi")

    if f.designations:
        out = having(t.designations.filter(F.col("designation").isin(f.designations)))
    if f.needs_image:
        out = having(thumbnails(t.images, t.rights))
    if f.period:
        out = having(places_of_period(t.temporal, t.periods, f.period))
    if f.from_year is not None or f.to_year is not None:
        out = having(places_of_years(t.temporal, f.from_year, f.to_year))
    return out


def map_clusters(t: Tables, box: Box, cell: float, f: Filters | None = None, cells: int | None = None) -> DataFrame:
    """Density of places by grid cell: (cell_key, place_count, lng, lat, sample_place_id, sample_name), fullest first."""
    check_box(box, None)
    cell = min(max(cell, MIN_CELL), MAX_CELL)
    gx, gy = geo.cell_of(F.col("lng"), cell), geo.cell_of(F.col("lat"), cell)
    first = F.min(F.struct("name", "id"))
    out = (
        matching_places(t, box, f or Filters())
        .groupBy(gx.alias("gx"), gy.alias("gy"))
        .agg(F.count(F.lit(1)).alias("place_count"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), first.alias("s"))
        .select(F.concat_ws(":", "gx", "gy").alias("cell_key"), "place_count", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), F.col("s.id").alias("sample_place_id"), F.col("s.name").alias("sample_name"))
    )
    return out.orderBy(F.desc("place_count"), "cell_key").limit(min(max(cells or MAX_CELLS, 1), MAX_CELLS))


def primary_designations(designations: DataFrame, ranking: tuple[str, ...]) -> DataFrame:
    """(place_id, primary_designation): the first in the order of the ranking."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ranking]), F.col("designation"))
    return designations.groupBy("place_id").agg(F.min_by("designation", rank).alias("primary_designation"))


def period_summaries(temporal: DataFrame, periods: DataFrame) -> DataFrame:
    """(place_id, period_summary): names of the periods, or of the associations, each once, in order."""
    named = temporal.filter("status = 'approved'").join(F.broadcast(periods.select(F.col("id").alias("period_id"), "display_name")), "period_id", "left")
    return named.groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("display_name", "association_type"))), ", ").alias("period_summary"))


def map_places(t: Tables, box: Box, ranking: tuple[str, ...], f: Filters | None = None, rows: int | None = None) -> DataFrame:
    """Markers of a viewport, the most important first.

    The kept places, MAX_MARKERS at most, are found once and checkpointed; their ids reach the detail scans as filters.
    """
    check_box(box)
    kept = matching_places(t, box, f or Filters()).orderBy(F.desc("content_level"), "name", "id").limit(min(max(rows or 250, 1), MAX_MARKERS))
    kept = kept.select("id", "slug", "name", "place_type", "lng", "lat", "accuracy", "survival_status")
    checkpoint_folder(kept.sparkSession)
    kept = kept.checkpoint()
    few = [r[0] for r in kept.select("id").collect()]
    of_few = lambda df: df.filter(F.col("place_id").isin(few))
    for more in (primary_designations(of_few(t.designations), ranking), thumbnails(of_few(t.images), t.rights), period_summaries(of_few(t.temporal), t.periods)):
        kept = kept.join(more.withColumnRenamed("place_id", "id"), "id", "left")
    return kept


def search_places(
    t: Tables, words: str | None = None, types: list[str] | None = None, centre: tuple[float, float] | None = None, radius_m: float | None = None,
    box: Box | None = None, max_cost: float | None = None, level: int | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Public places by any of: words, types, circle, box, cost, level; nearest first, then level, then name."""
    out = t.places.filter("status = 'approved'")
    if types:
        out = out.filter(F.col("place_type").isin(types))
    if words:
        out = out.filter(matches_words(text_tokens(F.concat_ws(" ", "name", "town", "county")), words))
    if max_cost is not None:
        out = out.filter(F.col("cost") <= max_cost)
    if level is not None:
        out = out.filter(F.col("content_level") >= level)
    if box:
        out = out.filter(geo.in_box(F.col("lng"), F.col("lat"), box))
    distance = F.lit(None).cast("double")
    if centre:
        distance = geo.haversine_m(F.col("lng"), F.col("lat"), F.lit(centre[0]), F.lit(centre[1]))
        if radius_m is not None:
            out = out.filter(geo.in_box(F.col("lng"), F.col("lat"), geo.box_around(*centre, radius_m)))
    out = out.withColumn("metres", distance)
    if centre and radius_m is not None:
        out = out.filter(F.col("metres") <= radius_m)
    out = out.orderBy(F.asc_nulls_last("metres"), F.desc("content_level"), "name", "id")
    out = out.offset(offset) if offset else out
    return out.limit(min(100 if limit is None else max(limit, 1), MAX_FOUND)).select("id", "name", "place_type", "content_level", F.round("metres", 3).alias("metres"))
