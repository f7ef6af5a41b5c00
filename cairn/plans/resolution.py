"""Queries on register rows, all identifier schemes, and resolution in order and in batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import register
from ..operators import matching as op
from ..operators.checkpoints import shared_folder
from ..operators.spread import spread
from ..streaming import matched
from .basics import SCALE, _wgs_sql, c
from .catalog import query
from .matching import DECIDED, KIND, METRES, REGISTER, RULE, SURE, records
from .substrate import twin, view

# register rows -----------------------------------------------------------------------------------------------------

#: Register rows are positions of v_grid with the names and designations of v_names; some lack a part.
ROWS = """rows AS (SELECT g.id, CAST(1000000 + g.id AS VARCHAR) AS entry, n.name, CASE WHEN g.id % 13 = 0 THEN NULL ELSE n.designation END AS designation,
    CASE g.id % 5 WHEN 0 THEN 'II' WHEN 1 THEN ' I ' WHEN 2 THEN 'III' WHEN 3 THEN '' END AS grade, CASE WHEN g.id % 31 = 0 THEN NULL ELSE g.easting END AS easting, g.northing, g.capture_scale,
    CASE WHEN g.is_area THEN g.area_ha END AS area_ha, CASE WHEN g.id % 4 <> 0 THEN -86400000 * (g.id % 9000) + 1000 END AS designated_ms FROM v_grid g JOIN v_names n ON n.id = g.id)"""


def register_rows(spark, d):
    rows = spread(view(spark, d, "v_grid").join(view(spark, d, "v_names").select("id", "name", "designation"), "id"), "id")
    i = c("id")
    return rows.select(
        "id", (i + 1_000_000).cast("string").alias("entry"), "name", F.when(i % 13 != 0, c("designation")).alias("designation"),
        F.when(i % 5 == 0, "II").when(i % 5 == 1, " I ").when(i % 5 == 2, "III").when(i % 5 == 3, "").alias("grade"), F.when(i % 31 != 0, c("easting")).alias("easting"), "northing", "capture_scale",
        F.when(c("is_area"), c("area_ha")).alias("area_ha"), F.when(i % 4 != 0, i % 9000 * -86_400_000 + 1000).alias("designated_ms"),
    )


_GRADE = "CASE WHEN trim(grade) IN ('I', 'II*', 'II', 'A', 'B', 'C') THEN trim(grade) END"
_DATE = "strftime(epoch_ms(CAST(designated_ms AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '.000Z'"
_REJECTED = "CASE WHEN easting IS NULL OR northing IS NULL THEN 'missing easting or northing' WHEN NOT (easting BETWEEN 0 AND 800000 AND northing BETWEEN 0 AND 1400000) THEN 'grid reference outside Great Britain (E' || CAST(easting AS BIGINT) || ' N' || CAST(northing AS BIGINT) || ')' END"
_FALLBACK = f"CASE WHEN starts_with({RULE}, 'generic-fallback') THEN 'no kind could be told from the name; fell back to ' || {KIND} || ' by ' || ({RULE}) END"
_WARNINGS = f"concat_ws('|', {_FALLBACK}, CASE WHEN designation IS NULL THEN '{register.NO_DESIGNATION}' END, CASE WHEN designation IS NOT NULL AND trim(grade) <> '' AND {_GRADE} IS NULL THEN 'unknown grade \"' || grade || '\"' END, '{register.NO_ADDRESS}')"
_ACCURACY = f"floor(greatest({SCALE} + 5e0, CASE WHEN area_ha > 0 THEN sqrt(area_ha * 10000e0 / pi()) ELSE 0e0 END) * 10e0 + 0.5e0) / 10e0"


def _if_kept(sql: str) -> str:
    return f"CASE WHEN rejected IS NULL THEN {sql} END"


@query("normalise_register", twin(f"""{_wgs_sql()}, {ROWS}, told AS (SELECT rows.*, {_REJECTED} AS rejected, w6.q, w6.x, w6.y FROM rows LEFT JOIN w6 ON w6.id = rows.id)
    SELECT id, entry, {_if_kept(KIND)} AS place_type, {_if_kept(SURE)} AS type_confidence, {_if_kept('CASE WHEN designation IS NOT NULL THEN ' + _GRADE + ' END')} AS grade, {_if_kept('CASE WHEN designation IS NOT NULL THEN ' + _DATE + ' END')} AS first_designated, {_if_kept("'nhle:' || entry")} AS identifier,
    {_if_kept("CASE WHEN area_ha IS NOT NULL THEN 'geometry_centroid' ELSE 'source_coordinate' END")} AS method, {_if_kept(_ACCURACY)} AS accuracy_m, {_if_kept(_WARNINGS)} AS warnings, {_if_kept('floor(degrees(q) * 1e7 + 0.5e0) / 1e7')} AS lat, rejected FROM told"""))
def normalise_register(spark, d):
    """Register rows in full: grade, date, identifier, position and its accuracy, warnings, or the reason for rejection."""
    rows = register.normalise_register(register_rows(spark, d))
    first, said = F.get("designations", F.lit(0)), lambda x: F.when(c("rejected").isNull(), x)
    number = F.get("identifiers", F.lit(0))
    return rows.select(
        "id", "entry", "place_type", "type_confidence", F.when(c("rejected").isNull(), first["grade"]).alias("grade"), first["first_designated"].alias("first_designated"),
        F.concat(number["scheme"], F.lit(":"), number["value"]).alias("identifier"), "method", "accuracy_m", said(F.array_join("warnings", "|")).alias("warnings"), "lat", "rejected",
    )


@query("register_facts", twin(f"""WITH {ROWS}, kept AS (SELECT *, {_REJECTED} AS rejected FROM rows), f AS (
    SELECT id, 'area_hectares' AS predicate, CASE WHEN area_ha = floor(area_ha) THEN CAST(CAST(area_ha AS BIGINT) AS VARCHAR) ELSE CAST(area_ha AS VARCHAR) END AS value FROM kept WHERE rejected IS NULL AND area_ha IS NOT NULL
    UNION ALL SELECT id, 'designation_reference', entry FROM kept WHERE rejected IS NULL AND designation IS NOT NULL
    UNION ALL SELECT id, 'first_designated', left({_DATE}, 10) FROM kept WHERE rejected IS NULL AND designation IS NOT NULL AND designated_ms IS NOT NULL)
    SELECT id, predicate, value FROM f"""))
def register_facts(spark, d):
    """What the register rows claim, by registered predicates; names are left to former_names."""
    rows = register.normalise_register(register_rows(spark, d)).filter("rejected IS NULL")
    return register.candidate_facts(rows).filter("predicate <> 'former_name'").select("id", "predicate", "value")


_LISTED = ", ".join(f"'{p}'" for p in register.PREDICATES)


@query("predicate_registry", twin(f"SELECT x AS predicate, x IN ({_LISTED}) AS registered, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 7 THEN 'style' ELSE ([{_LISTED}])[1 + (l_orderkey + l_linenumber) % 11] END AS x FROM lineitem) GROUP BY 1"))
def predicate_registry(spark, d):
    """Claims by predicate, and whether the registry has it: all eleven."""
    listed = F.array(*map(F.lit, register.PREDICATES))
    claims = view(spark, d, "lineitem").select(F.when(c("l_linenumber") == 7, "style").otherwise(F.get(listed, ((c("l_orderkey") + c("l_linenumber")) % 11).cast("int"))).alias("predicate"))
    return claims.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).select("predicate", c("predicate").isin(*register.PREDICATES).alias("registered"), "n")


# identifiers -------------------------------------------------------------------------------------------------------

#: External identifiers of either side, by scheme, and the references of their designations.
_KEYS = """ka AS (SELECT id, 'wd' || qid AS k FROM v_candidates WHERE qid IS NOT NULL UNION SELECT id, 'os' || id % 7001 FROM v_candidates WHERE id % 10 = 3 UNION SELECT place_id + 1, 'ref' || reference FROM v_designations WHERE id % 3 = 0),
    kb AS (SELECT id, 'wd' || qid AS k FROM v_places WHERE qid IS NOT NULL UNION SELECT id, 'os' || id % 7001 FROM v_places WHERE id % 5 = 3 UNION SELECT place_id, 'ref' || reference FROM v_designations WHERE id % 2 = 0)"""


def keyed_sides(spark, d):
    """(id, keys) of candidates and places, by every scheme and by designation references."""
    entries = view(spark, d, "v_designations")

    def side(name: str, every: int, references):
        found = references.groupBy("id").agg(F.collect_list("reference").alias("references"))
        external = F.array(F.struct(F.lit("os").alias("scheme"), F.when(c("id") % every == 3, (c("id") % 7001).cast("string")).alias("value")))
        return view(spark, d, name).join(found, "id", "left").select("id", op.identifier_keys(external, c("references"), wikidata=c("qid")).alias("keys"))

    a = side("v_candidates", 10, entries.filter("id % 3 = 0").select((c("place_id") + 1).alias("id"), "reference"))
    return a, side("v_places", 5, entries.filter("id % 2 = 0").select(c("place_id").alias("id"), "reference"))


@query("join_identifier_schemes", twin(f"WITH {_KEYS} SELECT DISTINCT ka.id AS l, kb.id AS r FROM ka JOIN kb USING (k) WHERE ka.id IN (SELECT id FROM v_candidates) AND kb.id IN (SELECT id FROM v_places)"))
def join_identifier_schemes(spark, d):
    """Pairs that share an identifier of any scheme, or only a designation's reference."""
    return op.shared_identifiers(*keyed_sides(spark, d))


# resolution --------------------------------------------------------------------------------------------------------


def _resolved() -> str:
    """SQL: near and identified pairs with earlier records, the canonical ones found record by record, then the decisions."""
    sql = DECIDED.replace("v_places", "v_candidates").replace(f"WHERE {METRES} <= 5000", f"WHERE {METRES} <= 5000 AND p.id < k.id").replace("ON p.qid = k.qid)", "ON p.qid = k.qid AND p.id < k.id)")
    strong = f"""strong AS MATERIALIZED (SELECT l, r FROM scored WHERE NOT register_veto AND NOT apart AND score >= 0.5e0 UNION SELECT l, r FROM told WHERE NOT ({REGISTER})),
    turns AS MATERIALIZED (SELECT v.id, row_number() OVER (ORDER BY v.id) AS i, any_value(s.rs) AS rs FROM v_candidates v LEFT JOIN (SELECT l, list(r) AS rs FROM strong GROUP BY 1) s ON s.l = v.id GROUP BY 1),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids UNION ALL SELECT t.i, CASE WHEN list_has_any(coalesce(t.rs, []), w.ids) THEN w.ids ELSE list_append(w.ids, t.id) END FROM walk w JOIN turns t ON t.i = w.i + 1),
    kept AS (SELECT unnest(ids) AS id FROM (SELECT ids FROM walk ORDER BY i DESC LIMIT 1)), by_id AS"""
    sql = sql.replace("by_id AS", strong, 1).replace(f"FROM told WHERE NOT ({REGISTER})) GROUP BY 1)", f"FROM told WHERE NOT ({REGISTER}) AND r IN (SELECT id FROM kept)) GROUP BY 1)")
    return sql.replace("FROM scored WHERE NOT register_veto AND NOT apart)", "FROM scored WHERE NOT register_veto AND NOT apart AND r IN (SELECT id FROM kept))")


RESOLVED = twin(f"{_resolved()} SELECT id, outcome, matched FROM decided").replace("WITH ", "WITH RECURSIVE ", 1)


@query("resolution_in_batches", RESOLVED)
def resolution_in_batches(spark, d):
    """The same decisions from two runs, the second against the canonical records that the first stored."""
    root = f"{shared_folder(spark)}/cairn/matched-{uuid.uuid4().hex}"
    decide, rows = matched.matcher(root, 16), records(spark, d, "v_candidates")
    middle = (view(spark, d, "v_candidates").agg(F.max("id")).first()[0] or 0) // 2
    decide(rows.filter(c("id") <= middle), 0)
    decide(rows.filter(c("id") > middle), 1)
    return matched.decisions(spark, root).select("id", "outcome", "matched")
