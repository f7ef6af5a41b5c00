"""Queries on discovery, full text, joins and the temporal model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as op
from .basics import LEEDS, LEEDS_SQL, c, distance_sql
from .catalog import query
from .substrate import DESIGNATIONS, twin, view

BOX = (-2.4, 53.4, -0.4, 54.6)
IN_BOX = "status = 'approved' AND lng BETWEEN -2.4e0 AND -0.4e0 AND lat BETWEEN 53.4e0 AND 54.6e0"
RANK = "CASE designation " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(DESIGNATIONS)) + " END"
THUMBS = "thumbs AS (SELECT place_id, arg_min(thumbnail_url, (seq, id)) AS thumbnail_url FROM (SELECT i.place_id, i.thumbnail_url, i.seq, i.id FROM v_images i JOIN v_rights r ON i.id = r.image_id WHERE i.status = 'approved' AND i.thumbnail_url IS NOT NULL AND r.attribution IS NOT NULL AND r.licence <> 'UNSUPPORTED') GROUP BY place_id)"


def tables(spark, d) -> op.Tables:
    v = lambda n: view(spark, d, n)
    return op.Tables(v("v_places"), v("v_designations"), v("v_temporal"), v("v_periods"), v("v_images"), v("v_rights"))


def clusters_sql(where: str, cell: str = "0.1e0") -> str:
    return f"""SELECT gx::VARCHAR || ':' || gy::VARCHAR AS cell_key, count(*) AS place_count, round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat, arg_min(id, (name, id)) AS sample_place_id, min(name) AS sample_name
        FROM (SELECT *, CAST(floor(lng / {cell}) AS BIGINT) AS gx, CAST(floor(lat / {cell}) AS BIGINT) AS gy FROM v_places WHERE {where}) GROUP BY gx, gy ORDER BY place_count DESC, cell_key LIMIT 2000"""


@query("map_clusters", twin(clusters_sql(IN_BOX + " AND place_type IN ('castle', 'church', 'monument')")))
def map_clusters(spark, d):
    return op.map_clusters(tables(spark, d), BOX, 0.1, op.Filters(types=["castle", "church", "monument"]))


@query("agg_grid_cluster", twin(clusters_sql(IN_BOX + " AND id IN (SELECT place_id FROM v_temporal WHERE status = 'approved' AND start_year <= 1700 AND end_year >= 1400)", "0.25e0")))
def agg_grid_cluster(spark, d):
    return op.map_clusters(tables(spark, d), BOX, 0.25, op.Filters(from_year=1400, to_year=1700))


SUMMARY = "summ AS (SELECT place_id, string_agg(n, ', ' ORDER BY n) AS period_summary FROM (SELECT DISTINCT t.place_id, coalesce(p.display_name, t.association_type) AS n FROM v_temporal t LEFT JOIN v_periods p ON p.id = t.period_id WHERE t.status = 'approved') GROUP BY place_id)"
PRIMARY = f"prim AS (SELECT place_id, arg_min(designation, {RANK}) AS primary_designation FROM v_designations GROUP BY place_id)"


@query(
    "map_places",
    twin(f"""WITH {THUMBS}, {SUMMARY}, {PRIMARY}, kept AS (SELECT * FROM v_places WHERE {IN_BOX} AND lng <= -0.5e0 AND id IN (SELECT place_id FROM v_designations WHERE designation IN ('listed_building', 'protected_wreck')) ORDER BY content_level DESC, name, id LIMIT 250)
        SELECT k.id, slug, name, place_type, lng, lat, accuracy, survival_status, primary_designation, thumbnail_url, period_summary FROM kept k LEFT JOIN prim ON prim.place_id = k.id LEFT JOIN thumbs ON thumbs.place_id = k.id LEFT JOIN summ ON summ.place_id = k.id"""),
)
def map_places(spark, d):
    return op.map_places(tables(spark, d), (-2.4, 53.4, -0.5, 54.6), DESIGNATIONS, op.Filters(designations=["listed_building", "protected_wreck"]))


@query("map_thumbnail", twin(f"WITH {THUMBS} SELECT * FROM thumbs"))
def map_thumbnail(spark, d):
    t = tables(spark, d)
    return op.thumbnails(t.images, t.rights)


@query("primary_designation", twin(f"WITH {PRIMARY} SELECT * FROM prim"))
def primary_designation(spark, d):
    return op.primary_designations(view(spark, d, "v_designations"), DESIGNATIONS)


@query("period_summary", twin(f"WITH {SUMMARY} SELECT * FROM summ"))
def period_summary(spark, d):
    t = tables(spark, d)
    return op.period_summaries(t.temporal, t.periods)


@query("search_places", twin(f"SELECT id, name, place_type, content_level, round({LEEDS_SQL}, 3) AS metres FROM v_places WHERE status = 'approved' AND place_type IN ('castle', 'church') AND list_contains(string_split(lower(county), ' '), 'building') AND {LEEDS_SQL} <= 40000 ORDER BY {LEEDS_SQL}, content_level DESC, name, id LIMIT 50"))
def search_places(spark, d):
    return op.search_places(tables(spark, d), words="building", types=["castle", "church"], centre=LEEDS, radius_m=40000, limit=50)


query("sort_multi_nulls_last", twin("SELECT id, name, place_type, content_level, CAST(NULL AS DOUBLE) AS metres FROM v_places WHERE status = 'approved' AND cost <= 2000 ORDER BY content_level DESC, name, id LIMIT 100 OFFSET 20"))(
    lambda s, d: op.search_places(tables(s, d), max_cost=2000, offset=20)
)
query("topk_by_level", twin("SELECT id, name FROM v_places WHERE status = 'approved' ORDER BY content_level DESC, name, id LIMIT 25"))(
    lambda s, d: view(s, d, "v_places").filter("status = 'approved'").orderBy(F.desc("content_level"), "name", "id").limit(25).select("id", "name")
)
query("topk_nearby_exclude", twin(f"SELECT id, name FROM v_places WHERE status = 'approved' AND id <> 7 AND {LEEDS_SQL} <= 15000 ORDER BY {LEEDS_SQL}, content_level DESC, name, id LIMIT 8"))(
    lambda s, d: op.search_places(op.Tables(view(s, d, "v_places").filter("id <> 7")), centre=LEEDS, radius_m=15000, limit=8).select("id", "name")
)


@query("arg_guards")
def arg_guards(spark, d):
    """What the guards say to bad boxes."""
    said = []
    for box in (None, (1.0, 1.0, 0.0, 2.0), (0.0, 50.0, 5.0, 51.0), (0.0, 50.0, 1.0, 51.0)):
        try:
            op.check_box(box)
            said.append((str(box), "ok"))
        except ValueError as e:
            said.append((str(box), str(e)))
    return spark.createDataFrame(said, "box string, verdict string")


# full text ---------------------------------------------------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


@query("fts_match", twin(f"SELECT id FROM (SELECT id, {TOKENS.format('name')} AS t FROM v_names) WHERE (list_contains(t, 'hall') AND NOT list_contains(t, 'railings')) OR contains(' ' || array_to_string(t, ' ') || ' ', ' south west ')"))
def fts_match(spark, d):
    return view(spark, d, "v_names").filter(op.matches_words(op.text_tokens(c("name")), 'hall -railings or "south west"')).select("id")


@query("fts_match_filter", twin(f"SELECT id FROM v_places WHERE {IN_BOX} AND place_type = 'church' AND list_contains({TOKENS.format('county')}, 'machinery')"))
def fts_match_filter(spark, d):
    return op.matching_places(tables(spark, d), BOX, op.Filters(types=["church"], words="machinery")).select("id")


@query("fts_index_check", twin(f"SELECT word, count(DISTINCT id) AS indexed, (SELECT count(*) FROM v_names WHERE regexp_matches(lower(name), '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')) AS recomputed FROM (SELECT id, unnest({TOKENS.format('name')}) AS word FROM v_names) WHERE word IN ('hall', 'church', 'castle', 'works') GROUP BY word"))
def fts_index_check(spark, d):
    """Rows found through an inverted index and by testing each text, for some words."""
    names = view(spark, d, "v_names")
    words = ["hall", "church", "castle", "works"]
    index = names.select("id", F.explode(F.array_distinct(op.text_tokens(c("name")))).alias("word")).filter(c("word").isin(words)).groupBy("word").agg(F.count("id").alias("indexed"))
    tests = names.select(F.explode(F.array(*[F.when(op.matches_words(op.text_tokens(c("name")), w), F.lit(w)) for w in words])).alias("word")).filter("word is not null")
    return index.join(tests.groupBy("word").agg(F.count(F.lit(1)).alias("recomputed")), "word")


LEXEMES = " UNION ALL ".join(f"SELECT id, '{w}' AS w, unnest({TOKENS.format(x)}) AS t, generate_subscripts({TOKENS.format(x)}, 1) AS i FROM v_places" for w, x in (("A", "name"), ("B", "concat_ws(' ', town, county)"), ("C", "survival_status")))


@query("fts_vector", twin(f"""SELECT p.id, '[' || coalesce(string_agg('{{"lexeme":"' || t || '","weight":"' || w || '","position":' || i || '}}', ',' ORDER BY w, i), '') || ']' AS document FROM v_places p LEFT JOIN ({LEXEMES}) x ON x.id = p.id GROUP BY 1"""))
def fts_vector(spark, d):
    """Weighted document of each place: lexemes of its name (A), area (B) and summary (C), with positions."""
    parts = (("A", c("name")), ("B", F.concat_ws(" ", "town", "county")), ("C", c("survival_status")))

    def weighted(weight: str, field):
        return F.transform(op.text_tokens(field), lambda t, i: F.struct(t.alias("lexeme"), F.lit(weight).alias("weight"), (i + 1).alias("position")))

    entries = F.concat(*[weighted(w, x) for w, x in parts])
    return view(spark, d, "v_places").select("id", F.to_json(entries).alias("document"))


# joins -------------------------------------------------------------------------------------------------------------


@query("join_inner_equi", twin("SELECT i.id, i.place_id, r.licence FROM v_images i JOIN v_rights r ON i.id = r.image_id"))
def join_inner_equi(spark, d):
    return view(spark, d, "v_images").join(view(spark, d, "v_rights").withColumnRenamed("image_id", "id"), "id").select("id", "place_id", "licence")


@query("join_left", twin("SELECT i.id, r.attribution FROM v_images i LEFT JOIN v_rights r ON i.id = r.image_id"))
def join_left(spark, d):
    return view(spark, d, "v_images").join(view(spark, d, "v_rights").withColumnRenamed("image_id", "id"), "id", "left").select("id", "attribution")


@query("join_semi_exists", twin("SELECT id FROM v_places p WHERE EXISTS (SELECT 1 FROM v_designations x WHERE x.place_id = p.id AND x.designation = 'protected_wreck')"))
def join_semi_exists(spark, d):
    found = view(spark, d, "v_designations").filter("designation = 'protected_wreck'").select(c("place_id").alias("id"))
    return view(spark, d, "v_places").join(found, "id", "left_semi").select("id")


@query("join_anti_not_exists", twin("SELECT id FROM v_images i WHERE NOT EXISTS (SELECT 1 FROM v_rights r WHERE r.image_id = i.id)"))
def join_anti_not_exists(spark, d):
    return view(spark, d, "v_images").join(view(spark, d, "v_rights").withColumnRenamed("image_id", "id"), "id", "left_anti").select("id")


@query("join_theta_overlap", twin("SELECT p.id AS period, count(*) AS claims FROM v_temporal t JOIN v_periods p ON t.start_year <= p.end_year AND t.end_year >= p.start_year GROUP BY 1"))
def join_theta_overlap(spark, d):
    """Claims by the periods they overlap; the registry of 21 periods is broadcast."""
    periods = view(spark, d, "v_periods").select(c("id").alias("period"), c("start_year").alias("p0"), c("end_year").alias("p1"))
    joined = view(spark, d, "v_temporal").join(F.broadcast(periods), (c("start_year") <= c("p1")) & (c("end_year") >= c("p0")))
    return joined.groupBy("period").agg(F.count(F.lit(1)).alias("claims"))


@query("join_scalar_subquery", twin("SELECT id, (SELECT x.reference FROM v_designations x WHERE x.place_id = p.id ORDER BY x.created_at, x.id LIMIT 1) AS reference FROM v_places p"))
def join_scalar_subquery(spark, d):
    first = view(spark, d, "v_designations").groupBy(c("place_id").alias("id")).agg(F.min(F.struct("created_at", c("id").alias("i"), "reference"))["reference"].alias("reference"))
    return view(spark, d, "v_places").join(first, "id", "left").select("id", "reference")


@query("join_correlated_agg", twin("SELECT id, (SELECT count(*) FROM v_temporal t WHERE t.place_id = p.id) AS claims, (SELECT count(*) FROM v_temporal t WHERE t.place_id = p.id AND t.status <> 'approved') AS unresolved FROM v_places p"))
def join_correlated_agg(spark, d):
    n = view(spark, d, "v_temporal").groupBy(c("place_id").alias("id")).agg(F.count(F.lit(1)).alias("claims"), F.count(F.when(c("status") != "approved", 1)).alias("unresolved"))
    return view(spark, d, "v_places").join(n, "id", "left").select("id", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def neighbours(edges, kind: str, other: str):
    """(id, other_id, predicate): edges that touch entities of a kind, in either direction, with the other end's id."""
    out = edges.filter((c("subject_type") == kind) & (c("object_type") == other)).select(c("subject_id").alias("id"), c("object_id").alias("other_id"), "predicate")
    back = edges.filter((c("object_type") == kind) & (c("subject_type") == other)).select(c("object_id").alias("id"), c("subject_id").alias("other_id"), "predicate")
    return out.unionByName(back)


@query("graph_1hop_bidir", twin("SELECT e.id, p.name, e.predicate FROM (SELECT subject_id AS id, object_id AS o, predicate FROM v_edges WHERE subject_type = 'place' UNION ALL SELECT object_id, subject_id, predicate FROM v_edges WHERE object_type = 'place') e JOIN v_people p ON p.id = e.o"))
def graph_1hop_bidir(spark, d):
    people = view(spark, d, "v_people").select(c("id").alias("other_id"), "name")
    return neighbours(view(spark, d, "v_edges"), "place", "person").join(people, "other_id").select("id", "name", "predicate")


@query("join_two_step_in", twin("SELECT id, name FROM v_people WHERE id IN (SELECT DISTINCT source_id FROM v_claims)"))
def join_two_step_in(spark, d):
    return view(spark, d, "v_people").join(view(spark, d, "v_claims").select(c("source_id").alias("id")), "id", "left_semi").select("id", "name")


@query("join_ordered_attach", twin("SELECT x.entity_id, x.ordinal, p.name FROM v_claims x LEFT JOIN v_people p ON p.id = x.source_id ORDER BY 1, 2"))
def join_ordered_attach(spark, d):
    people = view(spark, d, "v_people").select(c("id").alias("source_id"), "name")
    return view(spark, d, "v_claims").join(people, "source_id", "left").select("entity_id", "ordinal", "name").orderBy("entity_id", "ordinal")


@query("join_values", "SELECT r.r_name AS name, v.step FROM region r CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS BIGINT) AS step) v")
def join_values(spark, d):
    return view(spark, d, "region").select(c("r_name").alias("name")).crossJoin(F.broadcast(spark.range(1, 4).toDF("step")))


@query("join_cross_literal", "SELECT n.n_name AS nation, v.category FROM nation n, (VALUES ('A', 'coast'), ('B', 'hill'), ('C', 'both')) AS v(letter, category) WHERE (v.category = 'both' AND n.n_regionkey = 0) OR left(n.n_name, 1) = v.letter")
def join_cross_literal(spark, d):
    kinds = spark.createDataFrame([("A", "coast"), ("B", "hill"), ("C", "both")], "letter string, category string")
    both = ((c("category") == "both") & (c("n_regionkey") == 0)) | (F.left("n_name", F.lit(1)) == c("letter"))
    return view(spark, d, "nation").join(F.broadcast(kinds), both).select(c("n_name").alias("nation"), "category")


@query("join_embed", twin("""SELECT i.id, i.thumbnail_url, '{"slug":"' || p.slug || '","name":"' || p.name || '"}' AS place FROM v_images i JOIN v_places p ON p.id = i.place_id"""))
def join_embed(spark, d):
    places = view(spark, d, "v_places").select(c("id").alias("place_id"), F.struct("slug", "name").alias("place"))
    return view(spark, d, "v_images").join(places, "place_id").select("id", "thumbnail_url", F.to_json("place").alias("place"))


# temporal model ----------------------------------------------------------------------------------------------------


@query("place_matches_period", twin("SELECT DISTINCT t.place_id AS id FROM v_temporal t, (SELECT * FROM v_periods WHERE id = 'tudor') p WHERE t.status = 'approved' AND (t.period_id = 'tudor' OR (t.start_year <= p.end_year AND t.end_year >= p.start_year))"))
def place_matches_period(spark, d):
    t = tables(spark, d)
    return op.places_of_period(t.temporal, t.periods, "tudor").withColumnRenamed("place_id", "id")


@query("year_range_filter", twin("SELECT DISTINCT place_id AS id FROM v_temporal WHERE status = 'approved' AND start_year IS NOT NULL AND end_year IS NOT NULL AND end_year >= 1900"))
def year_range_filter(spark, d):
    return op.places_of_years(view(spark, d, "v_temporal"), 1900, None).withColumnRenamed("place_id", "id")


query("century_span", "SELECT n, CAST((n - 1) * 100 + 1 AS BIGINT) AS start_year, CAST(n * 100 AS BIGINT) AS end_year FROM (SELECT CAST(unnest(range(1, 22)) AS BIGINT) AS n)")(
    lambda s, d: s.range(1, 22).select(c("id").alias("n"), ((c("id") - 1) * 100 + 1).alias("start_year"), (c("id") * 100).alias("end_year"))
)


@query("period_for_span", twin("SELECT n, id AS period FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY ov DESC, display_order) AS k FROM (SELECT s.n, p.id, p.display_order, least(s.n * 100, p.end_year) - greatest((s.n - 1) * 100 + 1, p.start_year) AS ov FROM (SELECT CAST(unnest(range(1, 22)) AS BIGINT) AS n) s, v_periods p) WHERE ov > 0) WHERE k = 1"))
def period_for_span(spark, d):
    """The period that holds most of each century; the earlier in the registry of equals."""
    spans = spark.range(1, 22).select(c("id").alias("n"), ((c("id") - 1) * 100 + 1).alias("a"), (c("id") * 100).alias("b"))
    pairs = spans.crossJoin(F.broadcast(view(spark, d, "v_periods"))).withColumn("ov", F.least("b", "end_year") - F.greatest("a", "start_year"))
    return pairs.filter("ov > 0").groupBy("n").agg(F.max_by("id", F.struct("ov", -c("display_order"))).alias("period"))


@query("forbidden_date_audit", twin("SELECT count(*) AS forbidden FROM v_temporal WHERE derivation ILIKE '%date first listed%'"))
def forbidden_date_audit(spark, d):
    return view(spark, d, "v_temporal").filter(c("derivation").ilike("%date first listed%")).agg(F.count(F.lit(1)).alias("forbidden"))


@query("temporal_coverage", twin("SELECT date_precision, count(*) AS claims, count(DISTINCT place_id) AS places, round(count(DISTINCT place_id) * 1e0 / greatest((SELECT count(*) FROM v_places), 1), 4) AS share FROM v_temporal WHERE status = 'approved' GROUP BY 1"))
def temporal_coverage(spark, d):
    total = view(spark, d, "v_places").agg(F.count(F.lit(1)).alias("total"))
    by = view(spark, d, "v_temporal").filter("status = 'approved'").groupBy("date_precision").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("place_id").alias("places"))
    return by.join(F.broadcast(total)).select("date_precision", "claims", "places", F.round(c("places") / F.greatest("total", F.lit(1)), 4).alias("share"))


@query("temporal_attach", twin("SELECT DISTINCT k.id AS place_id, t.association_type, t.period_id, t.start_year, t.end_year, 0.7e0 AS confidence FROM v_temporal t JOIN v_candidates k ON t.place_id = k.id WHERE t.status <> 'approved' AND NOT EXISTS (SELECT 1 FROM v_temporal o WHERE o.status = 'approved' AND o.place_id = k.id AND o.association_type = t.association_type AND o.period_id IS NOT DISTINCT FROM t.period_id)"))
def temporal_attach(spark, d):
    """Staged claims through their source records, those already there left out."""
    claims = view(spark, d, "v_temporal")
    staged = claims.filter("status <> 'approved'").join(view(spark, d, "v_candidates").select(c("id").alias("place_id")), "place_id")
    known = claims.filter("status = 'approved'").select(c("place_id").alias("q"), c("association_type").alias("a"), c("period_id").alias("p")).distinct()
    new = staged.join(known, (c("place_id") == c("q")) & (c("association_type") == c("a")) & c("period_id").eqNullSafe(c("p")), "left_anti")
    return new.select("place_id", "association_type", "period_id", "start_year", "end_year", F.lit(0.7).alias("confidence")).distinct()


@query("inception_year", twin("SELECT id, CAST(start_year AS INTEGER) AS year, abs(start_year - end_year) <= 25 AS agrees FROM v_temporal WHERE start_year IS NOT NULL"))
def inception_year(spark, d):
    from ..functions.text import leading_year

    year = leading_year(F.concat(c("start_year").cast("string"), F.lit("-01-01T00:00:00Z")))
    return view(spark, d, "v_temporal").filter("start_year IS NOT NULL").select("id", year.alias("year"), (F.abs(c("start_year") - c("end_year")) <= 25).alias("agrees"))


@query("join_spatial_grid", twin(f"SELECT k.id AS l, p.id AS r, round({distance_sql('k.lng', 'k.lat', 'p.lng', 'p.lat')}, 3) AS metres FROM v_candidates k JOIN v_places p ON p.lat BETWEEN k.lat - 0.02e0 AND k.lat + 0.02e0 WHERE {distance_sql('k.lng', 'k.lat', 'p.lng', 'p.lat')} <= 2000"))
def join_spatial_grid(spark, d):
    from ..operators.blocking import near_pairs

    return near_pairs(view(spark, d, "v_candidates"), view(spark, d, "v_places"), 2000.0).select("l", "r", F.round("metres", 3).alias("metres"))
