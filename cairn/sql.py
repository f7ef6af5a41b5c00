"""The engine's functions in SQL: temporary functions and table functions of a session, over views of the published tables.

``register(spark, tables)`` makes ``SELECT * FROM search_places(words => 'hall -railings', radius_m => 5000e0, lng => -1.5e0,
lat => 53.9e0)`` and the like possible. Bodies are SQL that Spark inlines, so filters and columns reach the scans.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .operators.discovery import MAX_CELL, MAX_CELLS, MAX_FOUND, MIN_CELL, Tables

#: Names of the temporary views that the table functions read.
PLACES, TEMPORAL, PERIODS = "cairn_places", "cairn_temporal", "cairn_periods"
_TOKENS = "filter(split(lower(coalesce({0}, '')), '[^a-z0-9]+'), t -> t <> '')"
_WORD = "array_join(filter(split(p, '[^a-z0-9]+'), t -> t <> ''), ' ')"
#: The alternatives of a web search, which 'or' outside of quotes parts, each as its words and phrases.
_GROUPS = f"""filter(transform(split(regexp_replace(lower(query), '(?:^|\\\\s)or(?=\\\\s|$)(?=(?:[^"]*"[^"]*")*[^"]*$)', '\\n'), '\\n'),
    g -> filter(transform(regexp_extract_all(g, '"[^"]*"|-?\\\\w+', 0), p -> struct(startswith(p, '-') AS minus, {_WORD} AS words)), x -> x.words <> '')), g -> size(g) > 0)"""
_METRES = "2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians({3} - {1}) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))"
_FROM = f"CASE WHEN search_places.lng IS NOT NULL AND search_places.lat IS NOT NULL THEN {_METRES.format('p.lng', 'p.lat', 'search_places.lng', 'search_places.lat')} END"

SCALARS = {
    "haversine_m(lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE": _METRES.format("lng1", "lat1", "lng2", "lat2"),
    "grid_cell(degrees DOUBLE, size DOUBLE) RETURNS BIGINT": "CAST(floor(degrees / size) AS BIGINT)",
    # each part of one alternative must hold: words and phrases are there, words with a minus aren't
    "web_matches(text STRING, query STRING) RETURNS BOOLEAN": f"query IS NULL OR size({_GROUPS}) = 0 OR exists({_GROUPS}, g -> forall(g, x -> contains(concat(' ', array_join({_TOKENS.format('text')}, ' '), ' '), concat(' ', x.words, ' ')) <> x.minus))",
}
TABLES = {
    """search_places(words STRING DEFAULT NULL, kinds ARRAY<STRING> DEFAULT NULL, lng DOUBLE DEFAULT NULL, lat DOUBLE DEFAULT NULL, radius_m DOUBLE DEFAULT NULL, max_cost DOUBLE DEFAULT NULL, level INT DEFAULT NULL)
        RETURNS TABLE(id BIGINT, name STRING, place_type STRING, content_level INT, metres DOUBLE)""": f"""
        SELECT p.id, p.name, p.place_type, p.content_level, round({_FROM}, 3) AS metres FROM {PLACES} p
        WHERE p.status = 'approved' AND web_matches(concat_ws(' ', p.name, p.town, p.county), search_places.words) AND (search_places.kinds IS NULL OR array_contains(search_places.kinds, p.place_type))
          AND (search_places.radius_m IS NULL OR search_places.lng IS NULL OR {_FROM} <= search_places.radius_m)
          AND (search_places.max_cost IS NULL OR p.cost <= search_places.max_cost) AND (search_places.level IS NULL OR p.content_level >= search_places.level)
        ORDER BY {_FROM} ASC NULLS LAST, p.content_level DESC, p.name, p.id LIMIT {MAX_FOUND}""",
    "map_clusters(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, size DOUBLE) RETURNS TABLE(cell_key STRING, place_count BIGINT, lng DOUBLE, lat DOUBLE, sample_place_id BIGINT, sample_name STRING)": f"""
        SELECT concat_ws(':', gx, gy), count(*), round(avg(x), 6), round(avg(y), 6), min(struct(name, id)).id, min(name)
        FROM (SELECT id, name, p.lng AS x, p.lat AS y, grid_cell(p.lng, least(greatest(map_clusters.size, {MIN_CELL}e0), {MAX_CELL}e0)) AS gx, grid_cell(p.lat, least(greatest(map_clusters.size, {MIN_CELL}e0), {MAX_CELL}e0)) AS gy
              FROM {PLACES} p WHERE status = 'approved' AND p.lng BETWEEN west AND east AND p.lat BETWEEN south AND north)
        GROUP BY gx, gy ORDER BY 2 DESC, 1 LIMIT {MAX_CELLS}""",
    "places_of_period(period STRING) RETURNS TABLE(place_id BIGINT)": f"""
        SELECT DISTINCT t.place_id FROM {TEMPORAL} t JOIN {PERIODS} p ON p.id = places_of_period.period
        WHERE t.status = 'approved' AND (t.period_id = p.id OR (t.start_year <= p.end_year AND t.end_year >= p.start_year))""",
}


def register(spark: SparkSession, tables: Tables) -> None:
    """Makes views of the tables and creates the functions; a session's functions are replaced."""
    tables.places.createOrReplaceTempView(PLACES)
    for name, table in ((TEMPORAL, tables.temporal), (PERIODS, tables.periods)):
        if table is not None:
            table.createOrReplaceTempView(name)
    there = {PLACES, *(n for n, t in ((TEMPORAL, tables.temporal), (PERIODS, tables.periods)) if t is not None)}
    for head, body in (SCALARS | TABLES).items():
        if all(view in there for view in (TEMPORAL, PERIODS) if view in body):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
