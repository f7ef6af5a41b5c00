"""Queries on aggregates, windows, order, sets, visibility and quality reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranks
from ..operators import reports as op
from ..operators import visibility as vis
from ..operators.spread import spread_by_count
from .basics import c
from .catalog import query
from .substrate import DESIGNATIONS, twin, view

LISTED = "(" + ", ".join(f"'{x}'" for x in DESIGNATIONS) + ")"


# aggregates --------------------------------------------------------------------------------------------------------

query("agg_count_group", twin("SELECT predicate AS key, count(*) AS n FROM v_claims GROUP BY 1"))(lambda s, d: op.histogram(view(s, d, "v_claims"), c("predicate")))
query("agg_count_distinct", twin("SELECT predicate, count(DISTINCT source_id) AS sources, count(DISTINCT value) AS values FROM v_claims GROUP BY 1"))(
    lambda s, d: view(s, d, "v_claims").groupBy("predicate").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("value").alias("values"))
)


@query("agg_filter_clause", twin("SELECT count(*) AS images, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_rights r WHERE r.image_id = i.id)) AS with_rights, count(*) FILTER (WHERE status = 'approved') AS approved FROM v_images i"))
def agg_filter_clause(spark, d):
    rights = view(spark, d, "v_rights").select(c("image_id").alias("id")).distinct().withColumn("has", F.lit(True))
    both = view(spark, d, "v_images").join(rights, "id", "left")
    return both.agg(F.count(F.lit(1)).alias("images"), F.count("has").alias("with_rights"), F.count_if(c("status") == "approved").alias("approved"))


query("agg_percentile_cont", twin("SELECT action, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM v_audit GROUP BY 1"))(
    lambda s, d: ranks.interpolated(view(s, d, "v_audit"), ["action"], "value", {"p50": 50, "p95": 95})
)
RANKED = "SELECT action, value, row_number() OVER (PARTITION BY action ORDER BY value) AS rn, count(*) OVER (PARTITION BY action) AS n FROM v_audit WHERE value IS NOT NULL"
query("agg_nearest_rank", twin(f"SELECT action, max(CASE WHEN rn = ceil(0.5e0 * n) THEN value END) AS p50, max(CASE WHEN rn = ceil(0.95e0 * n) THEN value END) AS p95 FROM ({RANKED}) GROUP BY 1"))(
    lambda s, d: ranks.nearest_rank(view(s, d, "v_audit"), ["action"], "value", {"p50": 50, "p95": 95})
)
query("agg_min_max_avg_sum", twin("SELECT action, min(value) AS lo, max(value) AS hi, round(avg(value), 3) AS mean, round(sum(value), 3) AS total FROM v_audit GROUP BY 1"))(
    lambda s, d: view(s, d, "v_audit").groupBy("action").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.sum("value"), 3).alias("total"))
)
query("agg_first_ordered", twin("SELECT place_type, arg_min(id, (name, id)) AS sample_id, min(name) AS sample FROM v_places GROUP BY 1"))(
    lambda s, d: view(s, d, "v_places").groupBy("place_type").agg(F.min(F.struct("name", "id")).alias("s")).select("place_type", c("s.id").alias("sample_id"), c("s.name").alias("sample"))
)
query("agg_string_distinct", twin("SELECT place_id, string_agg(designation, ', ' ORDER BY designation) AS kinds FROM (SELECT DISTINCT place_id, designation FROM v_designations) GROUP BY 1"))(
    lambda s, d: view(s, d, "v_designations").groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_set("designation")), ", ").alias("kinds"))
)


@query("agg_json", twin("SELECT '{\"types\":{' || (SELECT string_agg('\"' || place_type || '\":' || n, ',' ORDER BY place_type) FROM (SELECT place_type, count(*) AS n FROM v_places GROUP BY 1)) || '},\"statuses\":{' || (SELECT string_agg('\"' || status || '\":' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM v_places GROUP BY 1)) || '}}' AS report"))
def agg_json(spark, d):
    """One nested document of counts by type and by status."""
    places = view(spark, d, "v_places")

    def mapped(key: str):
        return places.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(key))

    return mapped("place_type").crossJoin(mapped("status")).select(F.to_json(F.struct(c("place_type").alias("types"), c("status").alias("statuses"))).alias("report"))


query("agg_having", twin("SELECT count(*) AS unresolved FROM v_temporal WHERE status <> 'approved' HAVING count(*) > 0"))(
    lambda s, d: view(s, d, "v_temporal").filter("status <> 'approved'").agg(F.count(F.lit(1)).alias("unresolved")).filter("unresolved > 0")
)
query("agg_two_level", twin("SELECT max(p95) AS worst FROM (SELECT target_id % 50 AS g, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM v_audit GROUP BY 1)"))(
    lambda s, d: ranks.interpolated(view(s, d, "v_audit").select((c("target_id") % 50).alias("g"), "value"), ["g"], "value", {"p95": 95}).agg(F.max("p95").alias("worst"))
)
query("agg_ratio", twin("SELECT predicate, round(count(DISTINCT entity_id) * 1e0 / greatest(count(*), 1), 4) AS ratio FROM v_claims GROUP BY 1"))(
    lambda s, d: view(s, d, "v_claims").groupBy("predicate").agg(F.round(F.countDistinct("entity_id") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("ratio"))
)
query("agg_histogram_normalised_reason", twin("SELECT regexp_replace(action || ' took ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' ms', '\\d+(\\.\\d+)?', 'N', 'g') AS reason, count(*) AS n FROM v_audit WHERE value IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason"))(
    lambda s, d: op.histogram(view(s, d, "v_audit").filter("value IS NOT NULL"), text.mask_numbers(F.concat("action", F.lit(" took "), F.floor("value").cast("string"), F.lit(" ms"))), "reason").orderBy(F.desc("n"), "reason")
)


@query("agg_payload_bytes", twin("""SELECT town, CAST(sum(strlen('{"id":' || id || ',"name":"' || name || '","lng":"' || printf('%.4f', lng) || '","lat":"' || printf('%.4f', lat) || '"}') + 1) + 1 AS BIGINT) AS bytes FROM v_places GROUP BY 1"""))
def agg_payload_bytes(spark, d):
    """Bytes of each town's places as a JSON array: those of its elements, the commas between and the brackets."""
    element = F.to_json(F.struct("id", "name", F.format_string("%.4f", "lng").alias("lng"), F.format_string("%.4f", "lat").alias("lat")))
    return view(spark, d, "v_places").groupBy("town").agg((F.sum(F.octet_length(element) + 1) + 1).cast("long").alias("bytes"))


query("agg_share", twin("SELECT action AS cause, count(*) AS n, round(count(*) * 1e0 / (SELECT count(*) FROM v_audit), 4) AS share, arg_min(target_id, id) AS example FROM v_audit GROUP BY 1"))(
    lambda s, d: op.shares(view(s, d, "v_audit"), c("action"), "target_id", "id")
)

# windows and order -------------------------------------------------------------------------------------------------


@query("win_best_and_runner_up", twin("SELECT entity_id, max(CASE WHEN k = 1 THEN source_id END) AS best, max(CASE WHEN k = 2 THEN source_id END) AS runner_up, max(CASE WHEN k = 1 THEN v END) - max(CASE WHEN k = 2 THEN v END) AS lead FROM (SELECT *, CAST(value AS INTEGER) AS v, row_number() OVER (PARTITION BY entity_id ORDER BY CAST(value AS INTEGER) DESC, ordinal, source_id) AS k FROM v_claims) WHERE k <= 2 GROUP BY 1"))
def win_best_and_runner_up(spark, d):
    ranked = view(spark, d, "v_claims").withColumn("v", c("value").cast("int")).withColumn("k", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("v"), "ordinal", "source_id"))).filter("k <= 2")
    of = lambda col, k: F.max(F.when(c("k") == k, c(col)))
    return ranked.groupBy("entity_id").agg(of("source_id", 1).alias("best"), of("source_id", 2).alias("runner_up"), (of("v", 1) - of("v", 2)).alias("lead"))


query("win_first_wins", twin("SELECT entity_id, predicate, arg_min(value, (ordinal, source_id, value)) AS value FROM v_claims GROUP BY 1, 2"))(
    lambda s, d: view(s, d, "v_claims").groupBy("entity_id", "predicate").agg(F.min(F.struct("ordinal", "source_id", "value"))["value"].alias("value"))
)
query("win_slug_suffix", twin("SELECT id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM (SELECT id, regexp_replace(lower(place_type || '-' || town), '[^a-z0-9]+', '-', 'g') AS base FROM v_places))"))(
    lambda s, d: op.unique_slugs(view(s, d, "v_places").select("id", text.slugify(F.concat_ws("-", "place_type", "town")).alias("base")), "base", "id").select("id", "slug")
)
query("win_even_sample", twin("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM v_places) WHERE n <= 40 OR rn IN (SELECT CAST(floor(i * (SELECT count(*) FROM v_places) / 40e0) AS BIGINT) FROM (SELECT unnest(range(0, 40)) AS i))"))(
    lambda s, d: op.even_sample(view(s, d, "v_places").select("id"), "id", 40)
)
TIERS = "SELECT year(moment) * 100 + month(moment) AS tier, count(*) AS n FROM v_audit GROUP BY 1"
query("win_growth_vs_previous", twin(f"SELECT CAST(tier AS INTEGER) AS tier, n, round(n * 1e0 / lag(n) OVER (ORDER BY tier), 4) AS growth FROM ({TIERS})"))(
    lambda s, d: view(s, d, "v_audit").groupBy((F.year("moment") * 100 + F.month("moment")).alias("tier")).agg(F.count(F.lit(1)).alias("n")).withColumn("growth", F.round(c("n") / F.lag("n").over(Window.orderBy("tier")), 4))
)
query("sort_queue", twin("SELECT place_id, count(*) AS unresolved FROM v_temporal WHERE status <> 'approved' GROUP BY 1 ORDER BY unresolved DESC, place_id LIMIT 200"))(
    lambda s, d: view(s, d, "v_temporal").filter("status <> 'approved'").groupBy("place_id").agg(F.count(F.lit(1)).alias("unresolved")).orderBy(F.desc("unresolved"), "place_id").limit(200)
)
PRIORITY = {"error": 0, "purchase": 1, "signup": 2}
query("sort_priority_map", twin("SELECT id, action FROM v_audit ORDER BY CASE action WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 9 END, id LIMIT 100"))(
    lambda s, d: view(s, d, "v_audit").orderBy(F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[c("action")], F.lit(9)), "id").limit(100).select("id", "action")
)
query("sample_hash_order", twin("SELECT id, name FROM v_places ORDER BY md5(id::VARCHAR), id LIMIT 50"))(lambda s, d: op.hash_sample(view(s, d, "v_places"), "id", 50).select("id", "name"))

# sets --------------------------------------------------------------------------------------------------------------


@query("union_all_reasons", twin("SELECT id, 'no type' AS reason FROM v_candidates WHERE place_type = 'unknown' UNION ALL SELECT id, 'no identifier' FROM v_candidates WHERE qid IS NULL UNION ALL SELECT id, 'low confidence' FROM v_candidates WHERE type_confidence < 0.7e0"))
def union_all_reasons(spark, d):
    tests = {"no type": c("place_type") == "unknown", "no identifier": c("qid").isNull(), "low confidence": c("type_confidence") < 0.7}
    reasons = F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])
    return view(spark, d, "v_candidates").select("id", F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason"))


@query("set_overlap_diff", twin("""SELECT a.entity_id, array_to_string(list_sort(list_intersect(a.v, b.v)), ',') AS shared, array_to_string(list_sort(list_filter(b.v, lambda x: NOT list_contains(a.v, x))), ',') AS extra
    FROM (SELECT entity_id, list(DISTINCT value) AS v FROM v_claims WHERE ordinal % 2 = 0 GROUP BY 1) a JOIN (SELECT entity_id, list(DISTINCT value) AS v FROM v_claims WHERE ordinal % 2 = 1 GROUP BY 1) b ON a.entity_id = b.entity_id"""))
def set_overlap_diff(spark, d):
    claims = view(spark, d, "v_claims")
    side = lambda k, name: claims.filter(c("ordinal") % 2 == k).groupBy("entity_id").agg(F.collect_set("value").alias(name))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return side(0, "a").join(side(1, "b"), "entity_id").select("entity_id", joined(F.array_intersect("a", "b")).alias("shared"), joined(F.array_except("b", "a")).alias("extra"))


@query("multiset_compare", twin("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'orphan' ELSE 'differs' END AS verdict FROM (SELECT id, place_type FROM v_places WHERE id % 7 <> 0) a FULL JOIN (SELECT id, place_type FROM v_candidates WHERE id % 5 <> 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.place_type <> b.place_type"))
def multiset_compare(spark, d):
    a = view(spark, d, "v_places").filter("id % 7 <> 0").select("id", "place_type")
    return op.multiset_difference(a, view(spark, d, "v_candidates").filter("id % 5 <> 0").select("id", "place_type"), "id")


# visibility --------------------------------------------------------------------------------------------------------

ANYONE, EDITOR, MODERATOR = vis.Actor(), vis.Actor(3, "editor"), vis.Actor(4, "moderator")


def seen(rows, by_actor):
    """(actor, n): how many rows each actor sees."""
    out = None
    for name, df in by_actor.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("actor"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("rls_status", twin("SELECT 'anyone' AS actor, count(*) AS n FROM v_places WHERE status = 'approved' UNION ALL SELECT 'editor', count(*) FROM v_places"))
def rls_status(spark, d):
    t = view(spark, d, "v_places")
    return seen(t, {"anyone": vis.by_status(t, ANYONE), "editor": vis.by_status(t, EDITOR)})


@query("rls_role_lattice", twin("SELECT coalesce(role, 'user') AS role, count(*) AS n, coalesce(role, 'user') IN ('editor', 'moderator', 'admin') AS edits, coalesce(role, 'user') IN ('moderator', 'admin') AS moderates FROM v_profiles GROUP BY 1"))
def rls_role_lattice(spark, d):
    role = F.coalesce("role", F.lit("user"))
    return op.histogram(view(spark, d, "v_profiles"), role, "role").withColumns({"edits": c("role").isin(*vis.EDITORS), "moderates": c("role").isin(*vis.MODERATORS)})


query("rls_parent_gated", twin("SELECT id FROM v_designations WHERE place_id IN (SELECT id FROM v_places WHERE status = 'approved')"))(
    lambda s, d: vis.with_visible_parent(view(s, d, "v_designations").withColumnRenamed("id", "i"), "place_id", view(s, d, "v_places"), ANYONE).select(c("i").alias("id"))
)
query("rls_owner", twin("SELECT id FROM v_images WHERE owner_id = 3"))(lambda s, d: vis.by_owner(view(s, d, "v_images"), vis.Actor(3)).select("id"))
query("rls_moderated", twin("SELECT 'anyone' AS actor, count(*) AS n FROM v_images WHERE status = 'approved' UNION ALL SELECT 'owner', count(*) FROM v_images WHERE status = 'approved' OR owner_id = 5 UNION ALL SELECT 'moderator', count(*) FROM v_images"))(
    lambda s, d: seen(None, {k: vis.moderated(view(s, d, "v_images"), a) for k, a in {"anyone": ANYONE, "owner": vis.Actor(5), "moderator": MODERATOR}.items()})
)
query("rls_temporal", twin("SELECT t.id FROM v_temporal t JOIN v_places p ON p.id = t.place_id WHERE t.status = 'approved' AND p.status = 'approved'"))(
    lambda s, d: vis.with_visible_parent(vis.by_status(view(s, d, "v_temporal"), ANYONE).withColumnRenamed("id", "i"), "place_id", view(s, d, "v_places"), ANYONE).select(c("i").alias("id"))
)
query("rls_staging_hidden", twin("SELECT 'anyone' AS actor, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'editor', count(*) FROM v_candidates"))(
    lambda s, d: seen(None, {"anyone": vis.staging(view(s, d, "v_candidates"), ANYONE), "editor": vis.staging(view(s, d, "v_candidates"), EDITOR)})
)

# quality -----------------------------------------------------------------------------------------------------------

FIGURES = "SELECT count(*) AS n, avg(CASE WHEN status = 'approved' THEN 1e0 ELSE 0e0 END) AS approved, max(accuracy) AS worst FROM v_places"


def _figures(spark, d):
    return view(spark, d, "v_places").agg(F.count(F.lit(1)).alias("n"), F.avg((c("status") == "approved").cast("double")).alias("approved"), F.max("accuracy").alias("worst"))


def gates_sql(tests: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS gate, CASE WHEN ({t}) IS NULL THEN 'not-evaluated' WHEN {t} THEN 'pass' ELSE 'fail' END AS verdict, {b} AS blocking FROM ({FIGURES})" for k, (t, b) in tests.items())


TIER_GATES = {"rows": ("n >= 1000", True), "approved share": ("approved >= 0.95e0", True), "accuracy": ("worst <= 500", False), "latency": ("CAST(NULL AS DOUBLE) <= 300", False)}
ACTIVATION_GATES = {"rows": ("n > 0", True), "approved share": ("approved >= 0.5e0", True), "accuracy": ("worst <= 100", False)}
query("gate_tier", twin(gates_sql(TIER_GATES)))(lambda s, d: op.gates(_figures(s, d), {k: (F.expr(t), b) for k, (t, b) in TIER_GATES.items()}))
query("gate_activation", twin(gates_sql(ACTIVATION_GATES)))(lambda s, d: op.gates(_figures(s, d), {k: (F.expr(t), b) for k, (t, b) in ACTIVATION_GATES.items()}))


@query("verify_report", twin("""SELECT 'places' AS metric, count(*) * 1e0 AS figure FROM v_places UNION ALL SELECT 'approved share', round(avg(CASE WHEN status = 'approved' THEN 1e0 ELSE 0e0 END), 4) FROM v_places
    UNION ALL SELECT 'claims without place', count(*) * 1e0 FROM v_temporal t WHERE NOT EXISTS (SELECT 1 FROM v_places p WHERE p.id = t.place_id) UNION ALL SELECT 'images without rights', count(*) * 1e0 FROM v_images i WHERE NOT EXISTS (SELECT 1 FROM v_rights r WHERE r.image_id = i.id)"""))
def verify_report(spark, d):
    places, images = view(spark, d, "v_places"), view(spark, d, "v_images")
    orphans = view(spark, d, "v_temporal").join(places.select(c("id").alias("place_id")), "place_id", "left_anti")
    bare = images.join(view(spark, d, "v_rights").select(c("image_id").alias("id")), "id", "left_anti")
    figure = lambda df, name, agg: df.agg(agg.cast("double").alias("figure")).select(F.lit(name).alias("metric"), "figure")
    parts = (
        figure(places, "places", F.count(F.lit(1))), figure(places, "approved share", F.round(F.avg((c("status") == "approved").cast("double")), 4)),
        figure(orphans, "claims without place", F.count(F.lit(1))), figure(bare, "images without rights", F.count(F.lit(1))),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


query("audit_report", twin("SELECT predicate, count(*) AS merged, CAST(max(sources) AS BIGINT) AS most FROM (SELECT entity_id, predicate, count(DISTINCT source_id) AS sources FROM v_claims GROUP BY 1, 2) WHERE sources > 1 GROUP BY 1"))(
    lambda s, d: spread_by_count(view(s, d, "v_claims").select("entity_id", "predicate", "source_id"), "entity_id", "predicate").groupBy("entity_id", "predicate").agg(F.countDistinct("source_id").alias("sources")).filter("sources > 1").groupBy("predicate").agg(F.count(F.lit(1)).alias("merged"), F.max("sources").alias("most"))
)
query("discovery_report", twin("SELECT action AS scenario, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_cont(0.95) WITHIN GROUP (ORDER BY value) <= 300 AS ok FROM v_audit GROUP BY 1"))(
    lambda s, d: ranks.interpolated(view(s, d, "v_audit").select(c("action").alias("scenario"), "value"), ["scenario"], "value", {"p50": 50, "p95": 95}).withColumn("ok", c("p95") <= 300)
)
query("review_pressure", twin("SELECT date_precision AS cause, count(*) AS n, round(count(*) * 2e0 / 60, 2) AS hours FROM v_temporal WHERE status <> 'approved' GROUP BY 1"))(
    lambda s, d: op.histogram(view(s, d, "v_temporal").filter("status <> 'approved'"), c("date_precision"), "cause").withColumn("hours", F.round(c("n") * 2.0 / 60, 2))
)
query("timing_stats", twin(f"SELECT a.action, round(a.mean, 6) AS mean, a.worst, b.p50, b.p99 FROM (SELECT action, avg(value) AS mean, max(value) AS worst FROM v_audit GROUP BY 1) a JOIN (SELECT action, max(CASE WHEN rn = ceil(0.5e0 * n) THEN value END) AS p50, max(CASE WHEN rn = ceil(0.99e0 * n) THEN value END) AS p99 FROM ({RANKED}) GROUP BY 1) b ON a.action = b.action"))(
    lambda s, d: view(s, d, "v_audit").groupBy("action").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("worst")).join(ranks.nearest_rank(view(s, d, "v_audit"), ["action"], "value", {"p50": 50, "p99": 99}), "action")
)
query("commons_projection", twin("SELECT lang AS category, count(*) AS files, round(count(*) / 14.2e0 / 60, 4) AS hours FROM documents GROUP BY 1"))(
    lambda s, d: op.histogram(view(s, d, "documents"), c("lang"), "category").select("category", c("n").alias("files"), F.round(c("n") / 14.2 / 60, 4).alias("hours"))
)


@query("enum_parity", twin(f"SELECT designation, 'used' AS only FROM (SELECT DISTINCT designation FROM v_designations WHERE designation NOT IN {LISTED}) UNION ALL SELECT x, 'listed' FROM (SELECT unnest([{LISTED[1:-1]}]) AS x) WHERE x NOT IN (SELECT designation FROM v_designations WHERE id % 2 = 0)"))
def enum_parity(spark, d):
    """Values that only one of two vocabularies has: the registry, and the designations of entries with an even id."""
    listed = spark.createDataFrame([(x,) for x in DESIGNATIONS], "designation string")
    entries = view(spark, d, "v_designations")
    used, even = entries.select("designation").distinct(), entries.filter("id % 2 = 0").select("designation").distinct()
    return used.exceptAll(listed).withColumn("only", F.lit("used")).unionByName(listed.exceptAll(even).withColumn("only", F.lit("listed")))


@query("storage_stats")
def storage_stats(spark, d):
    """Bytes and rows of each table's files."""
    out = None
    for name in ("documents", "orders", "lineitem"):
        part = view(spark, d, name).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        part = part.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).select(F.lit(name).alias("table"), "bytes", "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("query_bench")
def query_bench(spark, d):
    """Milliseconds of product queries: a warm-up and timed runs into no sink."""
    import time

    from .catalog import QUERIES

    rows = []
    for name in ("map_clusters", "search_places"):
        for i in range(3):
            start = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            rows.append((name, i, (time.time() - start) * 1000))
    return spark.createDataFrame(rows, "scenario string, run int, ms double")


query("rights_ready_counts", twin("SELECT count(*) AS images, count(r.image_id) AS with_rights, count(CASE WHEN r.attribution IS NOT NULL AND r.licence <> 'UNSUPPORTED' THEN 1 END) AS ready FROM v_images i LEFT JOIN v_rights r ON r.image_id = i.id"))(
    lambda s, d: view(s, d, "v_images").join(view(s, d, "v_rights"), c("image_id") == c("id"), "left").agg(F.count(F.lit(1)).alias("images"), F.count("image_id").alias("with_rights"), F.count_if(c("attribution").isNotNull() & (c("licence") != "UNSUPPORTED")).alias("ready"))
)
