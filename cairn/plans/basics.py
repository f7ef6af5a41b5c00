"""Queries on filters, scalar functions and geography."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.ranks import ordered_digest
from .catalog import query
from .substrate import PERIODS, twin, view

UK = (-8.7, 49.8, 1.8, 60.9)
LEEDS = (-1.55, 53.8)
SCALARS: dict = {}


def scalar(name: str, source: str, columns: Callable[[], dict], sql: str, key: str = "id"):
    """Registers a query that adds computed columns to the key of a view."""

    def run(spark, d):
        return view(spark, d, source).select(key, *[x.alias(k) for k, x in columns().items()])

    query(name, twin(f"SELECT {key}, {sql} FROM {source}"))(run)


c = F.col

# filters -----------------------------------------------------------------------------------------------------------


@query("scan_filter", twin("SELECT id, name, place_type FROM v_places WHERE status = 'approved' AND slug = 'customer-000000007'"))
def scan_filter(spark, d):
    return view(spark, d, "v_places").filter("status = 'approved' AND slug = 'customer-000000007'").select("id", "name", "place_type")


def optional_filters(df, **wanted):
    """Filters on the columns whose wanted value isn't None."""
    for column, value in wanted.items():
        df = df if value is None else df.filter(c(column).isin(list(value)) if isinstance(value, (list, tuple)) else c(column) == value)
    return df


query("optional_filters", twin("SELECT id, name FROM v_places WHERE place_type = 'castle' AND content_level = 2"))(
    lambda s, d: optional_filters(view(s, d, "v_places"), place_type="castle", content_level=2, county=None).select("id", "name")
)
query("in_list_filter", twin("SELECT id, place_type FROM v_places WHERE place_type IN ('castle', 'church')"))(
    lambda s, d: optional_filters(view(s, d, "v_places"), place_type=["castle", "church"]).select("id", "place_type")
)


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return min(max(default if value is None else value, low), high)


query("clamp_limits", twin("SELECT id FROM v_places ORDER BY id LIMIT least(greatest(coalesce(9999, 250), 1), 500)"))(
    lambda s, d: view(s, d, "v_places").select("id").orderBy("id").limit(clamp(9999, 250, 1, 500))
)
query("case_bands", twin("SELECT CASE WHEN accuracy <= 10 THEN 'to 10' WHEN accuracy <= 50 THEN 'to 50' WHEN accuracy <= 250 THEN 'to 250' ELSE 'over' END AS band, count(*) AS n FROM v_places GROUP BY 1"))(
    lambda s, d: view(s, d, "v_places").groupBy(F.when(c("accuracy") <= 10, "to 10").when(c("accuracy") <= 50, "to 50").when(c("accuracy") <= 250, "to 250").otherwise("over").alias("band")).agg(F.count(F.lit(1)).alias("n"))
)
scalar(
    "coalesce_nullif", "v_licences", lambda: {"credit": F.coalesce(F.nullif(c("artist"), F.lit("")), c("credit")), "same": c("artist").eqNullSafe(c("credit"))},
    "coalesce(nullif(artist, ''), credit) AS credit, artist IS NOT DISTINCT FROM credit AS same",
)
query("range_check", twin("SELECT id, lng, lat FROM v_places WHERE lng NOT BETWEEN -2.5e0 AND 0.2e0 OR lat NOT BETWEEN 53.3e0 AND 54.7e0"))(
    lambda s, d: view(s, d, "v_places").filter(~geo.in_box(c("lng"), c("lat"), (-2.5, 53.3, 0.2, 54.7))).select("id", "lng", "lat")
)
query("enum_cast_check", twin("SELECT place_type, count(*) AS n FROM v_places WHERE place_type NOT IN ('castle', 'church', 'monument', 'building') GROUP BY 1"))(
    lambda s, d: view(s, d, "v_places").join(F.broadcast(s.createDataFrame([(x,) for x in ("castle", "church", "monument", "building")], "place_type string")), "place_type", "left_anti").groupBy("place_type").agg(F.count(F.lit(1)).alias("n"))
)
MARKER = ("id", "slug", "name", "place_type", "lng", "lat", "accuracy", "survival_status")
query("projection_contract", twin(f"SELECT {', '.join(MARKER)} FROM v_places WHERE status = 'approved'"))(lambda s, d: view(s, d, "v_places").filter("status = 'approved'").select(*MARKER))
MODES = {"all": None, "sacred": ("church", "abbey", "priory", "cathedral"), "industry": ("industrial_site", "railway_site", "canal_structure")}


def types_of_mode(mode: str, types=None):
    """Types of a discovery mode; types that are given win."""
    return types or MODES[mode]


query("discovery_mode_types", twin("SELECT id, place_type FROM v_places WHERE place_type IN ('church', 'abbey', 'priory', 'cathedral')"))(
    lambda s, d: optional_filters(view(s, d, "v_places"), place_type=types_of_mode("sacred")).select("id", "place_type")
)


def _reasons(*tests):
    return F.filter(F.array(*[F.when(bad, F.lit(why)) for bad, why in tests]), lambda x: x.isNotNull())


@query(
    "validate_candidate",
    twin("""SELECT id, concat_ws('; ', CASE WHEN length(name) > 17 THEN 'name too long' END, CASE WHEN lng < -2.3e0 THEN 'lng out of range' END, CASE WHEN place_type IN ('unknown') THEN 'type not known' END,
        CASE WHEN qid IS NULL AND postcode IS NULL THEN 'no identifier' END) AS reasons FROM v_candidates"""),
)
def validate_candidate(spark, d):
    """Why a candidate is invalid, in order; nothing if it is valid."""
    tests = (
        (F.length("name") > 17, "name too long"), (c("lng") < -2.3, "lng out of range"), (c("place_type").isin("unknown"), "type not known"),
        (c("qid").isNull() & c("postcode").isNull(), "no identifier"),
    )
    return view(spark, d, "v_candidates").select("id", F.array_join(_reasons(*tests), "; ").alias("reasons"))


# text --------------------------------------------------------------------------------------------------------------

N = "lower(strip_accents(name))"
NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '&', ' and ', 'g'), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    return f"list_filter(string_split({NORMAL.format(f'lower(strip_accents({x}))')}, ' '), lambda t: t <> '' AND t NOT IN ({stop}))"


scalar("str_normalise_name", "v_names", lambda: {"normal": text.normalise_name(c("name"))}, NORMAL.format(N) + " AS normal")
scalar("str_tokenise", "v_names", lambda: {"tokens": F.array_join(text.tokenise(c("name")), " ")}, f"array_to_string({tokens_sql('name')}, ' ') AS tokens")
TIDY = """CASE WHEN name = upper(name) THEN array_to_string(list_transform(string_split(lower(name), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('of','the','and','to','at','in','on','for','a','an') THEN w
    WHEN i > 1 AND regexp_matches(w, '^(i{1,3}|iv|v|vi{1,3}|ix|x)$') THEN upper(w) WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END), ' ') ELSE name END"""
scalar("str_tidy_name", "v_names", lambda: {"tidy": text.tidy_name(c("name"))}, f"{TIDY} AS tidy")
scalar(
    "str_alt_names", "v_names", lambda: {"alts": F.array_join(F.array_sort(text.alternative_names(c("name"), c("other"))), "|")},
    f"""array_to_string(list_sort(list_distinct(list_filter([CASE WHEN length(trim(regexp_split_to_array(name, '[;:]')[1])) > 2 THEN {TIDY.replace('name', "trim(regexp_split_to_array(name, '[;:]')[1])")} END, trim(name)], lambda n: n IS NOT NULL AND n <> other))), '|') AS alts""",
)
SLUG = "left(coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'place'), 120)"
scalar("str_slugify", "v_names", lambda: {"slug": text.slugify(c("name"))}, f"{SLUG} AS slug")
STRIP = "regexp_replace({0}, '<[^>]*>', ' ', 'g')"
for _p, _t in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0*39;|&apos;", "''")):
    STRIP = f"regexp_replace({STRIP}, '{_p}', '{_t}', 'gi')"
STRIP = f"nullif(trim(regexp_replace({STRIP}, '\\s+', ' ', 'g')), '')"
scalar("str_strip_html", "pages", lambda: {"text": text.strip_html(c("html"))}, STRIP.format("html") + " AS text", key="page_id")
scalar("str_host_equal", "pages", lambda: {"host": text.host_of(c("url"))}, "lower(regexp_replace(coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1), ''), url), '^www[.]', '')) AS host", key="page_id")
scalar("str_regex_first_int", "v_claims", lambda: {"ordinal": c("ordinal"), "source_id": c("source_id"), "year": text.leading_year(F.concat(F.lit("-"), c("value"), F.lit(" or so")))}, "ordinal, source_id, CAST(nullif(regexp_extract('-' || value || ' or so', '^(-?\\d{1,6})', 1), '') AS INTEGER) AS year", key="entity_id")
SCALE = "CASE WHEN regexp_matches(coalesce(capture_scale, ''), '1\\s*:\\s*\\d+') THEN CAST(regexp_extract(capture_scale, '1\\s*:\\s*(\\d+)', 1) AS DOUBLE) * 0.0005e0 ELSE 25e0 END"
scalar("str_capture_scale", "v_grid", lambda: {"metres": text.capture_scale_metres(c("capture_scale"))}, f"{SCALE} AS metres")
scalar("str_postcode_norm", "v_candidates", lambda: {"code": text.postcode_key(c("postcode"))}, "upper(regexp_replace(postcode, '\\s+', '', 'g')) AS code")
scalar("str_reason_mask", "v_places", lambda: {"reason": text.mask_numbers(F.concat(F.lit("distance "), c("accuracy").cast("int").cast("string"), F.lit(".5 m over 500")))}, "regexp_replace('distance ' || CAST(CAST(accuracy AS INTEGER) AS VARCHAR) || '.5 m over 500', '\\d+(\\.\\d+)?', 'N', 'g') AS reason")
scalar("str_label", "v_designations", lambda: {"label": text.label(c("designation"))}, "array_to_string(list_transform(string_split(replace(designation, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label")
GRAMS = "[substr({0}, CAST(i AS INTEGER), 2) FOR i IN range(1, length({0}))]"


def dice_sql(a: str, b: str) -> str:
    ga, gb = GRAMS.format(a), GRAMS.format(b)
    over = f"list_sum(list_transform(list_distinct({ga}), lambda g: least(len(list_filter({ga}, lambda x: x = g)), len(list_filter({gb}, lambda x: x = g)))))"
    return f"CASE WHEN {a} = {b} THEN 1e0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0e0 ELSE 2e0 * coalesce({over}, 0) / (length({a}) + length({b}) - 2) END"


scalar("str_bigram_dice", "v_names", lambda: {"score": F.round(text.dice(text.normalise_name(c("name")), text.normalise_name(c("other"))), 6)}, "round(" + dice_sql("a", "b") + ", 6) AS score")
from .catalog import ORACLES  # noqa: E402

ORACLES["str_bigram_dice"] = twin(f"SELECT id, round({dice_sql('a', 'b')}, 6) AS score FROM (SELECT id, {NORMAL.format(N)} AS a, {NORMAL.format('lower(strip_accents(other))')} AS b FROM v_names)")
scalar(
    "str_token_containment", "v_names", lambda: {"score": F.round(text.containment(text.tokenise(c("name")), text.tokenise(c("other"))), 6)},
    f"round(CASE WHEN least(len({tokens_sql('name')}), len({tokens_sql('other')})) > 0 THEN len(list_intersect({tokens_sql('name')}, {tokens_sql('other')}))::DOUBLE / least(len(list_distinct({tokens_sql('name')})), len(list_distinct({tokens_sql('other')}))) ELSE 0e0 END, 6) AS score",
)
scalar("str_csv_quote", "v_names", lambda: {"cell": text.csv_quoted(F.concat(c("name"), F.lit(' "x"')))}, """'"' || replace(name || ' "x"', '"', '""') || '"' AS cell""")
scalar("str_format_year", "v_periods", lambda: {"label": text.format_year(c("start_year"))}, "CASE WHEN start_year <= -10000 THEN format('{:,}', CAST(floor(-start_year / 1000e0 + 0.5e0) * 1000 AS BIGINT)) || ' BC' WHEN start_year < 0 THEN (-start_year)::VARCHAR || ' BC' ELSE 'AD ' || start_year::VARCHAR END AS label")
scalar("math_round_half", "v_places", lambda: {"a": text.round_half_up(c("lng"), 1), "b": text.round_half_up(c("lat"), 3)}, "floor(lng * 10e0 + 0.5e0) / 10e0 AS a, floor(lat * 1000e0 + 0.5e0) / 1000e0 AS b")
scalar("math_equiv_radius", "v_grid", lambda: {"radius": F.round(geo.equivalent_radius_m(c("area_ha")), 6)}, "round(CASE WHEN area_ha > 0 THEN sqrt(area_ha * 10000e0 / pi()) ELSE 0e0 END, 6) AS radius")
scalar("math_cell_degrees", "v_places", lambda: {"cell": F.when(c("content_level") <= 1, 1.0).when(c("content_level") == 2, 0.25).when(c("content_level") == 3, 0.05).otherwise(0.01)}, "CASE WHEN content_level <= 1 THEN 1e0 WHEN content_level = 2 THEN 0.25e0 WHEN content_level = 3 THEN 0.05e0 ELSE 0.01e0 END AS cell")
scalar("math_cluster_px", "v_places", lambda: {"px": F.round(F.least(F.lit(64.0), 26 + F.sqrt("id") * 2.2), 6)}, "round(least(64e0, 26 + sqrt(id) * 2.2e0), 6) AS px")
scalar("date_epoch_ms", "v_places", lambda: {"iso": text.iso_from_millis((c("id") - 500) * 86400000 + 123)}, "strftime(make_timestamp(((id - 500) * 86400000 + 123) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso")
scalar("date_slice10", "v_audit", lambda: {"day": F.substring(c("moment").cast("string"), 1, 10)}, "left(CAST(moment AS VARCHAR), 10) AS day")
scalar("arr_distinct_sort", "v_names", lambda: {"same": text.same_tokens(text.tokenise(c("name")), text.tokenise(c("other")))}, f"list_sort({tokens_sql('name')}) = list_sort({tokens_sql('other')}) AS same")
scalar("arr_subset", "v_names", lambda: {"inside": text.is_subset(text.tokenise(c("name")), text.tokenise(c("other")))}, f"len({tokens_sql('name')}) > 0 AND list_has_all({tokens_sql('other')}, {tokens_sql('name')}) AS inside")
scalar("json_path", "v_audit", lambda: {"k": F.get_json_object("props", "$.k").cast("long")}, "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k")


@query("json_unnest", twin("SELECT id, unnest(string_split(name, ' ')) AS item FROM v_names"))
def json_unnest(spark, d):
    arrays = view(spark, d, "v_names").select("id", F.to_json(F.split("name", " ")).alias("j"))
    return arrays.select("id", F.explode(F.coalesce(F.from_json("j", "array<string>"), F.array().cast("array<string>"))).alias("item"))


@query("json_build", twin("""SELECT id, '{"name":"' || name || '","location":{"lng":"' || printf('%.4f', lng) || '","lat":"' || printf('%.4f', lat) || '"},"areas":["' || town || '","' || county || '"]}' AS document FROM v_places"""))
def json_build(spark, d):
    return view(spark, d, "v_places").select("id", F.to_json(F.struct("name", F.struct(*[F.format_string("%.4f", x).alias(x) for x in ("lng", "lat")]).alias("location"), F.array("town", "county").alias("areas"))).alias("document"))


def stable_id(*parts) -> F.Column:
    """An id in uuid form that depends on the parts alone."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


scalar("hash_id", "v_places", lambda: {"uid": stable_id(c("slug"), c("id").cast("string"))}, "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uid")
ORACLES["hash_id"] = twin("SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uid FROM (SELECT id, sha256(slug || chr(31) || id::VARCHAR) AS h FROM v_places)")


def digest_sql(content: str, between: str) -> str:
    """SQL of the digest of each type's places in order, by chunks of a thousand."""
    rows = f"SELECT place_type, id, {content} AS x, (row_number() OVER (PARTITION BY place_type ORDER BY id) - 1) // 1000 AS chunk FROM v_places"
    chunks = f"SELECT place_type, chunk, count(*) AS n, sha256(string_agg(x, {between} ORDER BY id)) AS d FROM ({rows}) GROUP BY 1, 2"
    return f"SELECT place_type, sha256(string_agg(d, {between} ORDER BY chunk)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM ({chunks}) GROUP BY 1"


@query("hash_digest_set", twin("SELECT place_type, digest FROM (" + digest_sql("id::VARCHAR || chr(31) || name", "chr(30)") + ")"))
def hash_digest_set(spark, d):
    """Digest of each group's rows in order; groups of places by type."""
    return ordered_digest(view(spark, d, "v_places"), ["place_type"], ["id"], F.concat_ws("\x1f", c("id").cast("string"), c("name")), between="\x1e")


# geography ---------------------------------------------------------------------------------------------------------


def distance_sql(x1, y1, x2, y2) -> str:
    return f"2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


LEEDS_SQL = distance_sql("lng", "lat", "-1.55e0", "53.8e0")
scalar("geo_haversine", "v_places", lambda: {"metres": F.round(geo.haversine_m(c("lng"), c("lat"), F.lit(LEEDS[0]), F.lit(LEEDS[1])), 3)}, f"round({LEEDS_SQL}, 3) AS metres")


@query("geo_radius", twin(f"SELECT id, round({LEEDS_SQL}, 3) AS metres FROM v_places WHERE {LEEDS_SQL} <= 15000"))
def geo_radius(spark, d):
    near = view(spark, d, "v_places").filter(geo.in_box(c("lng"), c("lat"), geo.box_around(*LEEDS, 15000)))
    near = near.withColumn("m", geo.haversine_m(c("lng"), c("lat"), F.lit(LEEDS[0]), F.lit(LEEDS[1]))).filter("m <= 15000")
    return near.select("id", F.round("m", 3).alias("metres")).orderBy("metres", "id")


query("geo_bbox", twin("SELECT id, lng, lat FROM v_places WHERE lng BETWEEN -2e0 AND -1e0 AND lat BETWEEN 53.5e0 AND 54e0"))(
    lambda s, d: view(s, d, "v_places").filter(geo.in_box(c("lng"), c("lat"), (-2.0, 53.5, -1.0, 54.0))).select("id", "lng", "lat")
)
scalar(
    "geo_grid_cells", "v_places", lambda: {"gx": geo.cell_of(c("lng")), "gy": geo.cell_of(c("lat")), "side": geo.lng_cells(c("lat"), 5000.0)},
    "CAST(floor(lng / 0.05e0) AS BIGINT) AS gx, CAST(floor(lat / 0.05e0) AS BIGINT) AS gy, CAST(ceil(least(180e0, (5000e0 / 111195e0) / greatest(0.01e0, cos(radians(lat)))) / 0.05e0) AS INTEGER) AS side",
)
scalar("grid_plausible", "v_grid", lambda: {"plausible": geo.grid_plausible(c("easting"), c("northing"))}, "easting BETWEEN 0 AND 800000 AND northing BETWEEN 0 AND 1400000 AS plausible")
ESTIMATE = lambda: geo.position_estimate(c("capture_scale"), c("area_ha"), c("is_area"))
scalar(
    "position_estimate", "v_grid", lambda: {"method": ESTIMATE()["method"], "accuracy_m": ESTIMATE()["accuracy_m"]},
    f"CASE WHEN is_area THEN 'geometry_centroid' ELSE 'source_coordinate' END AS method, floor(greatest({SCALE} + 5e0, CASE WHEN is_area AND area_ha > 0 THEN sqrt(area_ha * 10000e0 / pi()) ELSE 0e0 END) * 10e0 + 0.5e0) / 10e0 AS accuracy_m",
)
scalar("wd_accuracy", "v_places", lambda: {"metres": F.round(geo.stated_accuracy_m(c("accuracy") / 50000.0), 6), "approximate": geo.stated_accuracy_m(c("accuracy") / 50000.0) > 250}, "round(greatest(25e0, accuracy / 50000e0 * 111320e0), 6) AS metres, greatest(25e0, accuracy / 50000e0 * 111320e0) > 250 AS approximate")
scalar("st_xy_view", "v_places", lambda: {"lng": c("lng"), "lat": c("lat")}, "lng, lat")


def arc_sql(x: str) -> str:
    n = (geo.AIRY_A - geo.AIRY_B) / (geo.AIRY_A + geo.AIRY_B)
    k = [1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 2.625 * n**3, 1.875 * n**2 + 1.875 * n**3, 35 / 24 * n**3]
    p, m = f"({x} - {geo.LAT0!r}::DOUBLE)", f"({x} + {geo.LAT0!r}::DOUBLE)"
    return f"{geo.AIRY_B * geo.SCALE0!r}::DOUBLE * ({k[0]!r}::DOUBLE * {p} - {k[1]!r}::DOUBLE * sin({p}) * cos({m}) + {k[2]!r}::DOUBLE * sin(2 * {p}) * cos(2 * {m}) - {k[3]!r}::DOUBLE * sin(3 * {p}) * cos(3 * {m}))"


def _grid_sql() -> str:
    f = f"{geo.AIRY_A * geo.SCALE0!r}::DOUBLE"
    steps = [f"g0 AS (SELECT id, easting, northing, (northing + 100000e0) / {f} + {geo.LAT0!r}::DOUBLE AS p FROM v_grid WHERE easting BETWEEN 0 AND 800000 AND northing BETWEEN 0 AND 1400000)"]
    steps += [f"g{i + 1} AS (SELECT id, easting, northing, p + (northing + 100000e0 - {arc_sql('p')}) / {f} AS p FROM g{i})" for i in range(5)]
    e2 = f"{(geo.AIRY_A**2 - geo.AIRY_B**2) / geo.AIRY_A**2!r}::DOUBLE"
    steps.append(f"h AS (SELECT id, p, tan(p) AS t, easting - 400000e0 AS d, {f} / sqrt(1 - {e2} * sin(p) * sin(p)) AS nu, {f} * (1 - {e2}) / pow(1 - {e2} * sin(p) * sin(p), 1.5) AS rho FROM g5)")
    lat = "p - t / (2 * rho * nu) * pow(d, 2) + t / (24 * rho * pow(nu, 3)) * (5 + 3 * t * t + (nu / rho - 1) - 9 * t * t * (nu / rho - 1)) * pow(d, 4) - t / (720 * rho * pow(nu, 5)) * (61 + 90 * t * t + 45 * pow(t, 4)) * pow(d, 6)"
    lng = f"{geo.LON0!r}::DOUBLE + d / (cos(p) * nu) - (nu / rho + 2 * t * t) * pow(d, 3) / (cos(p) * 6 * pow(nu, 3)) + (5 + 28 * t * t + 24 * pow(t, 4)) * pow(d, 5) / (cos(p) * 120 * pow(nu, 5)) - (61 + 662 * t * t + 1320 * pow(t, 4) + 720 * pow(t, 6)) * pow(d, 7) / (cos(p) * 5040 * pow(nu, 7))"
    steps.append(f"o AS (SELECT id, {lat} AS lat, {lng} AS lng FROM h)")
    return "WITH " + ", ".join(steps)


def _wgs_sql() -> str:
    e2, we2 = (geo.AIRY_A**2 - geo.AIRY_B**2) / geo.AIRY_A**2, 2 * geo.WGS84_F - geo.WGS84_F**2
    n = lambda v: f"({v!r}::DOUBLE)"
    s, t, k = geo.SHIFT, geo.TURN, n(1 + geo.SHIFT["s"])
    out = _grid_sql() + f", a AS (SELECT id, lat, lng, {n(geo.AIRY_A)} / sqrt(1 - {n(e2)} * sin(lat) * sin(lat)) AS nu FROM o), b AS (SELECT id, nu * cos(lat) * cos(lng) AS x, nu * cos(lat) * sin(lng) AS y, (1 - {n(e2)}) * nu * sin(lat) AS z FROM a)"
    out += f", c AS (SELECT id, {n(s['tx'])} + x * {k} - y * {n(t['rz'])} + z * {n(t['ry'])} AS x, {n(s['ty'])} + x * {n(t['rz'])} + y * {k} - z * {n(t['rx'])} AS y, {n(s['tz'])} - x * {n(t['ry'])} + y * {n(t['rx'])} + z * {k} AS z FROM b)"
    out += f", w0 AS (SELECT id, x, y, z, sqrt(x * x + y * y) AS r, atan2(z, sqrt(x * x + y * y) * (1 - {n(we2)})) AS q FROM c)"
    for i in range(6):
        out += f", w{i + 1} AS (SELECT id, x, y, z, r, atan2(z + {n(we2)} * ({n(geo.WGS84_A)} / sqrt(1 - {n(we2)} * sin(q) * sin(q))) * sin(q), r) AS q FROM w{i})"
    return out


OSGB = lambda: geo.grid_to_osgb36(c("easting"), c("northing"))


@query("osgb_inverse_tm", twin(_grid_sql() + " SELECT id, round(degrees(lat), 9) AS lat, round(degrees(lng), 9) AS lng FROM o"))
def osgb_inverse_tm(spark, d):
    grid = view(spark, d, "v_grid").filter(geo.grid_plausible(c("easting"), c("northing"))).withColumn("o", OSGB())
    return grid.select("id", F.round(F.degrees("o.lat"), 9).alias("lat"), F.round(F.degrees("o.lng"), 9).alias("lng"))


@query("osgb_to_wgs84", twin(_wgs_sql() + " SELECT id, floor(degrees(q) * 1e7 + 0.5e0) / 1e7 AS lat, floor(degrees(atan2(y, x)) * 1e7 + 0.5e0) / 1e7 AS lng FROM w6"))
def osgb_to_wgs84(spark, d):
    grid = view(spark, d, "v_grid").withColumn("w", geo.osgb36_to_wgs84(OSGB())).filter("w is not null")
    return grid.select("id", "w.lat", "w.lng")


@query("positions_conflict", twin(f"SELECT p.id, {distance_sql('p.lng', 'p.lat', 'k.lng', 'k.lat')} > p.accuracy + k.accuracy + 25e0 AS apart FROM v_places p JOIN v_candidates k ON p.id = k.id"))
def positions_conflict(spark, d):
    p, k = view(spark, d, "v_places").alias("p"), view(spark, d, "v_candidates").alias("k")
    metres = geo.haversine_m(c("p.lng"), c("p.lat"), c("k.lng"), c("k.lat"))
    return p.join(k, c("p.id") == c("k.id")).select("p.id", geo.positions_conflict(metres, c("p.accuracy"), c("k.accuracy")).alias("apart"))


@query("queue_distance", twin(f"SELECT k.id, round({distance_sql('k.lng', 'k.lat', 'p.lng', 'p.lat')}, 3) AS metres FROM v_candidates k LEFT JOIN (SELECT * FROM v_places WHERE status = 'approved') p ON p.id = k.id"))
def queue_distance(spark, d):
    p, k = view(spark, d, "v_places").filter("status = 'approved'").alias("p"), view(spark, d, "v_candidates").alias("k")
    return k.join(p, c("p.id") == c("k.id"), "left").select("k.id", F.round(geo.haversine_m(c("k.lng"), c("k.lat"), c("p.lng"), c("p.lat")), 3).alias("metres"))


@query("period_registry", twin("SELECT id, display_name, CAST(start_year AS INTEGER) AS start_year, CAST(end_year AS INTEGER) AS end_year FROM v_periods WHERE start_year <> 0 AND end_year >= start_year"))
def period_registry(spark, d):
    table = spark.createDataFrame(PERIODS, "id string, display_name string, start_year int, end_year int")
    return table.filter("start_year <> 0 AND end_year >= start_year")


scalar(
    "math_trig", "v_places", lambda: {"s": F.round(F.sin(F.radians("lat")), 9), "t": F.round(F.atan2(F.tan(F.radians("lng")), F.cos(F.radians("lat"))), 9), "p": F.round(F.pow("lat", F.lit(1.5)), 6)},
    "round(sin(radians(lat)), 9) AS s, round(atan2(tan(radians(lng)), cos(radians(lat))), 9) AS t, round(pow(lat, 1.5e0), 6) AS p",
)
