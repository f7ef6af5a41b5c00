"""Queries that judge requests and spans of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as op
from .basics import c
from .catalog import query
from .substrate import twin, view

KINDS = ("castle", "church", "monument", "building", "industrial_site", "unknown")


@query("guard_boxes", twin("""SELECT id, CASE WHEN west IS NULL THEN 'missing' WHEN east <= west OR north <= south THEN 'empty or inverted' WHEN east - west > 2.5e0 OR north - south > 1.5e0 THEN 'too wide' ELSE 'ok' END AS verdict
    FROM (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE lng END AS west, lat AS south, lng + (id % 7 - 1) * 0.5e0 AS east, lat + (id % 5) * 0.4e0 AS north FROM v_places)"""))
def guard_boxes(spark, d):
    """What the guards say to a box at each place, some missing, empty or too wide."""
    box = (F.when(c("id") % 11 != 0, c("lng")), c("lat"), c("lng") + (c("id") % 7 - 1) * 0.5, c("lat") + c("id") % 5 * 0.4)
    return view(spark, d, "v_places").select("id", op.box_problem(*box).alias("verdict"))


@query("search_requests", twin("""SELECT id, concat_ws(',', CASE WHEN length(words) > 200 THEN 'text' END, CASE WHEN radius <= 0 OR radius > 200000 THEN 'radius' END, CASE WHEN rows NOT BETWEEN 1 AND 100 THEN 'limit' END, CASE WHEN skip < 0 THEN 'offset' END) AS problems
    FROM (SELECT id, repeat(action, CAST(id % 60 AS INTEGER)) AS words, CASE WHEN id % 4 = 0 THEN NULL ELSE value * 3000e0 - 9000e0 END AS radius, id % 104 AS rows, id % 9 - 1 AS skip FROM v_audit)"""))
def search_requests(spark, d):
    """What is wrong with the searches that events stand for."""
    i = c("id")
    words = F.expr("repeat(action, CAST(id % 60 AS INT))")
    said = op.search_problems(words, F.when(i % 4 != 0, c("value") * 3000.0 - 9000.0), i % 104, i % 9 - 1)
    return view(spark, d, "v_audit").select("id", F.array_join(said, ",").alias("problems"))


@query("visit_reviews", twin("""WITH r AS (SELECT id, target_id AS user_id, id % 300 AS place_id, moment, CASE WHEN id % 13 = 0 THEN NULL ELSE id % 7 END AS rating, id % 1500 AS minutes FROM v_audit WHERE action IN ('view', 'purchase')),
    ok AS (SELECT * FROM r WHERE rating BETWEEN 1 AND 5 AND minutes BETWEEN 0 AND 1440)
    SELECT user_id, place_id, count(*) AS written, arg_max(rating, (moment, id)) AS rating, CASE WHEN count(*) > 1 THEN 'submitted again' ELSE 'submitted' END AS state FROM ok GROUP BY 1, 2"""))
def visit_reviews(spark, d):
    """Reviews of places: one of a user and place, the last valid one; a changed one goes back to be looked at."""
    i = c("id")
    asked = view(spark, d, "v_audit").filter("action IN ('view', 'purchase')").select("id", c("target_id").alias("user_id"), (i % 300).alias("place_id"), "moment", F.when(i % 13 != 0, i % 7).alias("rating"), (i % 1500).alias("minutes"))
    valid = asked.filter(F.size(op.visit_problems(c("rating"), c("minutes"))) == 0)
    kept = valid.groupBy("user_id", "place_id").agg(F.count(F.lit(1)).alias("written"), F.max_by("rating", F.struct("moment", "id")).alias("rating"))
    return kept.withColumn("state", F.when(c("written") > 1, "submitted again").otherwise("submitted"))


@query("suggested_places", twin("""SELECT id, concat_ws(',', CASE WHEN name IS NULL OR length(trim(name)) NOT BETWEEN 2 AND 200 THEN 'name' END, CASE WHEN lat IS NULL OR abs(lng) > 180 OR abs(lat) > 90 THEN 'position' END, CASE WHEN kind NOT IN ('castle', 'church', 'monument', 'building', 'industrial_site', 'unknown') THEN 'kind' END) AS problems
    FROM (SELECT id, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' x ' ELSE name END AS name, lng * (id % 200) AS lng, CASE WHEN id % 17 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN id % 8 = 0 THEN 'folly' ELSE place_type END AS kind FROM v_places)"""))
def suggested_places(spark, d):
    """What is wrong with suggested places."""
    i = c("id")
    name = F.when(i % 6 == 0, None).when(i % 6 == 1, " x ").otherwise(c("name"))
    said = op.suggestion_problems(name, c("lng") * (i % 200), F.when(i % 17 != 0, c("lat")), F.when(i % 8 == 0, "folly").otherwise(c("place_type")), list(KINDS))
    return view(spark, d, "v_places").select("id", F.array_join(said, ",").alias("problems"))


@query("century_claims", twin("SELECT CASE WHEN start_year > 0 THEN CAST(ceil(start_year / 100e0) AS BIGINT) ELSE CAST(floor(start_year / 100e0) AS BIGINT) END AS century, count(*) AS claims, min(start_year) AS first_year, max(start_year) AS last_year FROM v_temporal WHERE start_year IS NOT NULL GROUP BY 1"))
def century_claims(spark, d):
    """Claims by the century they start in, with the years that occur."""
    claims = view(spark, d, "v_temporal").filter("start_year IS NOT NULL").withColumn("century", op.century_of(c("start_year")))
    return claims.groupBy("century").agg(F.count(F.lit(1)).alias("claims"), F.min("start_year").alias("first_year"), F.max("start_year").alias("last_year"))


@query("period_of_claims", twin("""SELECT id, period FROM (SELECT t.id, p.id AS period, row_number() OVER (PARTITION BY t.id ORDER BY least(t.end_year, p.end_year) - greatest(t.start_year, p.start_year) DESC, p.display_order) AS k
    FROM v_temporal t JOIN v_periods p ON t.start_year <= p.end_year AND t.end_year >= p.start_year) WHERE k = 1"""))
def period_of_claims(spark, d):
    """The period that holds most of each claim's years."""
    return op.period_of_spans(view(spark, d, "v_temporal").filter("start_year IS NOT NULL AND end_year IS NOT NULL"), view(spark, d, "v_periods"), "id")


@query("period_use", twin("SELECT p.id, p.display_name, CAST(p.start_year AS INTEGER) AS start_year, CAST(p.end_year AS INTEGER) AS end_year, count(t.id) AS claims FROM v_periods p LEFT JOIN v_temporal t ON t.period_id = p.id GROUP BY 1, 2, 3, 4"))
def period_use(spark, d):
    """The registry of periods with the claims that name each."""
    used = view(spark, d, "v_temporal").groupBy("period_id").agg(F.count(F.lit(1)).alias("claims"))
    periods = view(spark, d, "v_periods")
    rows = periods.join(used, c("id") == c("period_id"), "left")
    return rows.select("id", "display_name", c("start_year").cast("int").alias("start_year"), c("end_year").cast("int").alias("end_year"), F.coalesce("claims", F.lit(0)).alias("claims"))
