"""Heritage-shaped views over the generic tables, each one text that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The registry of periods (id, name, first year, last year), in display order.
PERIODS = (
    ("prehistory", "Prehistory", -900000, -43),
    ("palaeolithic", "Palaeolithic", -900000, -10001),
    ("mesolithic", "Mesolithic", -10000, -4001),
    ("neolithic", "Neolithic", -4000, -2201),
    ("bronze_age", "Bronze Age", -2200, -801),
    ("iron_age", "Iron Age", -800, -43),
    ("roman", "Roman Britain", 43, 409),
    ("early_medieval", "Anglo-Saxon & Viking", 410, 1065),
    ("norman", "Norman", 1066, 1153),
    ("medieval", "Medieval", 1154, 1484),
    ("tudor", "Tudor", 1485, 1602),
    ("stuart", "Stuart", 1603, 1713),
    ("georgian", "Georgian", 1714, 1836),
    ("victorian", "Victorian", 1837, 1900),
    ("edwardian", "Edwardian", 1901, 1913),
    ("wwi", "First World War", 1914, 1918),
    ("interwar", "Interwar", 1919, 1938),
    ("wwii", "Second World War", 1939, 1945),
    ("postwar", "Post-war", 1946, 1979),
    ("late_20th", "Late 20th century", 1980, 1999),
    ("contemporary", "Today", 2000, 2100),
)
#: Designations in the order that ranks them.
DESIGNATIONS = (
    "listed_building", "scheduled_monument", "world_heritage_site", "conservation_area",
    "registered_park_garden", "registered_battlefield", "protected_wreck", "undesignated",
)


def case(column: str, values) -> str:
    """CASE text that maps 0, 1, 2 ... to values."""
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Phrases that names and texts are made with; {0} is the part's name.
NAME_FORMS = (
    "{0} House", "CHURCH OF ST MARY", "{0} Barn approximately 10 metres east of {0} Farm", "2, {0} Road", "8, {0} Road", "Sundial to South of Church of {0}",
    "Stables at {0} Hall", "{0} Castle Farmhouse", "{0} works", "Remains of {0} Abbey; a monastic precinct", "Bowl barrow 300m south west of {0} Farm", "MILL AND WALLS OF {0}",
    "L''Église d''{0} & Tower", "Railings, Gate Piers and Gate to {0} College", "Church of All Saints", "Roman fort on {0} Moor",
)
PERIOD_FORMS = (
    "{0}, a C18 house", "Late 17th century barn at {0}", "seventeenth-century farmhouse, {0}", "Roman villa near {0}", "Roman Catholic Church of {0}", "Norman Road, {0}",
    "Tudor Cottage, {0}", "Bronze Age barrow on {0}", "medieval settlement and C12 chapel of {0}", "{0} Victoria Street", "Statue of {0}, Victorian", "Iron-Age hillfort and Anglo-Saxon cemetery",
    "{0} with no date", "Second World War pillbox", "C25 nothing, C1 and C21 something", "Victorian railway station, 19th century, {0}",
)


def _forms(forms, key: str, name: str) -> str:
    def concat(form: str) -> str:
        return "'" + form.replace("{0}", f"' || {name} || '") + "'"

    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {concat(f)}" for i, f in enumerate(forms)) + " END"


#: What a place's title is made with; some neighbours share it.
STEM = "'Ash' || CAST(c_custkey % 97 AS STRING)"
YEAR = "-800 + CAST((o_orderkey * 37) % 2800 AS INT)"
VIEWS = {
    "v_places": f"""SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '-')) AS slug,
        -2.6e0 + ((c_custkey * 7919) % 30000) / 10000e0 AS lng, 53.2e0 + ((c_custkey * 10473) % 16000) / 10000e0 AS lat,
        {case('c_nationkey % 6', ('castle', 'church', 'monument', 'building', 'industrial_site', 'unknown'))} AS place_type,
        CAST(1 + c_custkey % 4 AS INT) AS content_level, CASE WHEN c_custkey % 10 = 0 THEN 'submitted' ELSE 'approved' END AS status,
        CAST(5 + c_custkey % 300 AS DOUBLE) AS accuracy, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'surviving' ELSE 'ruined' END AS survival_status,
        'Town ' || c_nationkey AS town, c_mktsegment AS county, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS cost, c_custkey % 1000 AS owner_id,
        CASE WHEN c_custkey % 4 <> 0 THEN 0.9e0 ELSE 0.5e0 END AS type_confidence, CASE WHEN c_custkey % 5 = 0 THEN 'ls1 ' || c_custkey % 9 || 'ab' ELSE NULL END AS postcode,
        CASE WHEN c_custkey % 12 = 0 THEN 'Q' || c_custkey ELSE NULL END AS qid, c_custkey % 3 AS source_id, {case('c_custkey % 8', DESIGNATIONS)} AS designation,
        {_forms(NAME_FORMS, 'c_custkey', STEM)} AS title, CASE WHEN c_custkey % 7 = 0 THEN {STEM} || ' Manor' ELSE NULL END AS alt_title FROM {{customer}}""",
    "v_designations": f"""SELECT o_orderkey AS id, o_custkey AS place_id, {case('o_orderkey % 8', DESIGNATIONS)} AS designation,
        {case('o_orderkey % 4', ('I', 'II*', 'II'))} AS grade, o_orderdate AS created_at, CAST(1000000 + o_orderkey AS STRING) AS reference FROM {{orders}}""",
    "v_temporal": f"""SELECT o_orderkey AS id, o_custkey AS place_id, CASE WHEN o_orderkey % 2 = 0 THEN 'built' ELSE 'occupied' END AS association_type,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN {YEAR} = 0 THEN 1 ELSE {YEAR} END AS start_year,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN {YEAR} + CAST(o_orderkey % 120 AS INT) = 0 THEN 1 ELSE {YEAR} + CAST(o_orderkey % 120 AS INT) END AS end_year,
        CASE WHEN o_orderkey % 5 <> 0 THEN NULL WHEN o_orderkey % 25 = 0 THEN 'roman' WHEN o_orderkey % 25 = 5 THEN 'medieval' WHEN o_orderkey % 25 = 10 THEN 'tudor' WHEN o_orderkey % 25 = 15 THEN 'georgian' ELSE 'victorian' END AS period_id,
        CASE WHEN o_orderkey % 11 = 0 THEN 'submitted' ELSE 'approved' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'century' ELSE 'period' END AS date_precision,
        CASE WHEN o_orderkey % 97 = 0 THEN 'read from the Date First Listed' ELSE 'read from the name' END AS derivation FROM {{orders}}""",
    "v_periods": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d}, {10 * (i + 1)})" for i, (a, b, c, d) in enumerate(PERIODS)) + ") AS t(id, display_name, start_year, end_year, display_order)",
    "v_images": """SELECT p_partkey AS id, 1 + p_partkey % 1500 AS place_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'https://img.example/' || p_partkey || '.jpg' END AS thumbnail_url,
        CASE WHEN p_partkey % 5 = 0 THEN 'submitted' ELSE 'approved' END AS status, p_size AS seq, p_partkey % 1000 AS owner_id FROM {part}""",
    "v_rights": """SELECT p_partkey AS image_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'by ' || p_brand END AS attribution,
        CASE WHEN p_partkey % 6 = 1 THEN 'UNSUPPORTED' WHEN p_partkey % 2 = 0 THEN 'CC-BY-4.0' ELSE 'CC0' END AS licence FROM {part} WHERE p_partkey % 9 <> 0""",
    "v_claims": f"""SELECT l_orderkey AS entity_id, {case('l_linenumber % 5', ('inception_year', 'official_website', 'style', 'architect', 'postcode'))} AS predicate, l_suppkey AS source_id,
        CAST(CAST(l_quantity AS INT) AS STRING) AS value, CAST(l_linenumber AS INT) AS ordinal, l_returnflag AS flag, l_shipdate AS moment, l_linestatus AS state FROM {{lineitem}}""",
    "v_edges": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'place' ELSE 'person' END AS subject_type, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 1 + o_orderkey % 100 END AS subject_id,
        CASE WHEN o_orderkey % 3 = 0 THEN 'built_by' WHEN o_orderkey % 3 = 1 THEN 'owned_by' ELSE 'associated_with' END AS predicate,
        CASE WHEN o_orderkey % 2 = 0 THEN 'person' ELSE 'place' END AS object_type, CASE WHEN o_orderkey % 2 = 0 THEN 1 + o_orderkey % 120 ELSE o_custkey END AS object_id FROM {orders}""",
    "v_people": "SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug, s_nationkey AS nation FROM {supplier}",
    "v_names": f"SELECT p_partkey AS id, {_forms(NAME_FORMS, 'p_partkey', 'p_name')} AS name, {_forms(NAME_FORMS, '(p_partkey + p_size)', 'p_name')} AS other, {case('p_size % 9', DESIGNATIONS)} AS designation FROM {{part}}",
    "v_period_text": f"SELECT p_partkey AS id, {_forms(PERIOD_FORMS, 'p_partkey', 'p_name')} AS text, p_partkey % 3 = 0 AS descriptive FROM {{part}}",
    "v_grid": """SELECT c_custkey AS id, 400000e0 + (c_custkey * 97) % 145000 AS easting, CASE WHEN c_custkey % 50 = 0 THEN -5e0 ELSE 420000e0 + (c_custkey * 61) % 90000 END AS northing,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '1:' || CAST(500 * (1 + c_custkey % 20) AS STRING) END AS capture_scale, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 4000) / 100e0 END AS area_ha, c_custkey % 3 = 0 AS is_area FROM {customer}""",
    "v_licences": """SELECT doc_id AS id, CASE WHEN doc_id % 12 = 0 THEN 'CC BY-SA 4.0' WHEN doc_id % 12 = 1 THEN 'CC BY 4.0' WHEN doc_id % 12 = 2 THEN 'Public domain' WHEN doc_id % 12 = 3 THEN 'CC0' WHEN doc_id % 12 = 4 THEN 'CC BY-NC-ND 4.0'
        WHEN doc_id % 12 = 5 THEN 'see talk page' WHEN doc_id % 12 = 6 THEN NULL WHEN doc_id % 12 = 7 THEN 'cc-by-sa-3.0' WHEN doc_id % 12 = 8 THEN 'CC BY 2.5' WHEN doc_id % 12 = 9 THEN 'All rights reserved' WHEN doc_id % 12 = 10 THEN 'PD-old' ELSE '<i>CC BY-SA 2.0</i>' END AS licence_short,
        CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '' ELSE '<a href="x">Ann &amp; Bo' || doc_id % 5 || '</a>' END AS artist, CASE WHEN doc_id % 4 = 0 THEN 'Archive' ELSE NULL END AS credit,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'https://m.example/' || doc_id END AS media_url, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'https://p.example/' || doc_id END AS page_url,
        'File ' || doc_id AS title, CASE WHEN doc_id % 5 < 3 THEN 'Q' || doc_id ELSE 'Q0' END AS depicts, 'Q' || doc_id AS via_qid, CASE WHEN doc_id % 2 = 0 THEN 'Category ' || lang ELSE '' END AS via_category FROM {documents}""",
    "v_audit": "SELECT event_id AS id, user_id AS target_id, event_type AS action, ts AS moment, value, props FROM {events}",
    "v_profiles": f"SELECT c_custkey AS user_id, {case('c_custkey % 6', ('user', 'contributor', 'editor', 'moderator', 'admin'))} AS role FROM {{customer}}",
    "v_candidates": f"""SELECT c_custkey AS id, c_name AS name, -2.6e0 + ((c_custkey * 7919) % 30000) / 10000e0 + ((c_custkey % 41) - 20) / 5000e0 AS lng, 53.2e0 + ((c_custkey * 10473) % 16000) / 10000e0 + ((c_custkey % 29) - 14) / 5000e0 AS lat,
        {case('(c_nationkey + c_custkey % 2) % 6', ('castle', 'church', 'monument', 'building', 'industrial_site', 'unknown'))} AS place_type, CASE WHEN c_custkey % 3 = 0 THEN 0.9e0 ELSE 0.5e0 END AS type_confidence, CAST(5 + c_custkey % 200 AS DOUBLE) AS accuracy,
        CASE WHEN c_custkey % 4 = 0 THEN 'LS1 ' || c_custkey % 9 || 'AB' ELSE NULL END AS postcode, 'town ' || c_nationkey AS town, c_custkey % 2 AS source_id, CASE WHEN c_custkey % 6 = 0 THEN 'Q' || c_custkey ELSE NULL END AS qid,
        {case('(c_custkey + c_nationkey % 2) % 8', DESIGNATIONS)} AS designation,
        {_forms(NAME_FORMS, '(c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)', STEM)} AS title, CASE WHEN c_custkey % 11 = 0 THEN {STEM} || ' Manor' ELSE NULL END AS alt_title FROM {{customer}}""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS or a base table, as a DataFrame."""
    if name not in VIEWS:
        return read(spark, sf_dir, name)
    used = [t for t in BASE if "{" + t + "}" in VIEWS[name]]
    return spark.sql(VIEWS[name], **{t: read(spark, sf_dir, t) for t in used})


def twin(sql: str) -> str:
    """Oracle SQL: the statement with the views it names before it."""
    names = [v for v in VIEWS if v in sql]
    bodies = []
    for v in names:
        body = VIEWS[v]
        for t in BASE:
            body = body.replace("{" + t + "}", t)
        bodies.append(f"{v} AS ({body.replace('AS STRING', 'AS VARCHAR')})")
    sql = sql.strip()
    if not bodies:
        return sql
    return "WITH " + ", ".join(bodies) + (", " + sql[5:] if sql.upper().startswith("WITH ") else " " + sql)
