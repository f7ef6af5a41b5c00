"""Queries on normalisation, names, matching and comparison of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import classify, names, rights, temporal, text
from ..operators import compared
from ..operators import matching as op
from ..operators.checkpoints import checkpoint_folder
from ..operators.spread import spread
from .basics import STRIP, c, dice_sql, distance_sql, scalar, tokens_sql
from .catalog import query
from .substrate import PERIODS, twin, view



def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def any_of(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


# names -------------------------------------------------------------------------------------------------------------

REL = "(?i)(?:" + "|".join(names.RELATIONS).replace(r"[\s\S]*?", r"(?s:.)*?") + ")"


def analysed(view_name: str, column: str, more: str = "") -> str:
    """SQL of the pieces of a name: x, has, head, relation, phrase, street."""
    cut = f"regexp_extract(x, {quoted('(?is)^(.*?)' + REL)}, 1)"
    return f"""(SELECT *, CASE WHEN has THEN trim({cut}) ELSE trim(x) END AS head, CASE WHEN has THEN trim(substr(x, length({cut}) + 1)) END AS relation, nullif(regexp_extract(x, {quoted(names.STREET)}, 1), '') AS street
        FROM (SELECT *, regexp_matches(x, {quoted(REL)}) AND length({cut}) > 0 AS has FROM (SELECT id{more}, regexp_split_to_array({column}, '[;:]')[1] AS x FROM {view_name})))"""


OBJECT = f"substr(relation, length(regexp_extract(relation, {quoted(REL)}, 0)) + 1)"
NUMBERS = r"list_transform(regexp_split_to_array(street, '(?i)\s*(?:-|–|and|&)\s*'), lambda n: lower(trim(n)))"
joined = lambda x: F.array_join(x, " ")


@query("analyse_name", twin(f"SELECT id, head, relation, array_to_string({tokens_sql('head')}, ' ') AS head_tokens, CASE WHEN has THEN array_to_string({tokens_sql(OBJECT)}, ' ') ELSE '' END AS object_tokens, CASE WHEN street IS NULL THEN '' ELSE array_to_string({NUMBERS}, ' ') END AS streets FROM {analysed('v_names', 'name')}"))
def analyse_name(spark, d):
    a = spread(view(spark, d, "v_names"), "id").select("id", names.analyse(c("name")).alias("a"))
    return a.select("id", "a.head", "a.relation", joined("a.head_tokens").alias("head_tokens"), joined("a.object_tokens").alias("object_tokens"), joined("a.street_numbers").alias("streets"))


GENERIC_SQL = f"len(list_filter({{0}}, lambda t: NOT (t IN {any_of(names.GENERIC)} OR regexp_matches(t, '^\\d+$')))) = 0"
scalar("is_generic_name", "v_names", lambda: {"generic": names.is_generic(c("name"))}, GENERIC_SQL.format(tokens_sql("name")) + " AS generic")


def both_sides() -> str:
    def side(column: str, p: str) -> str:
        return f"(SELECT id, {tokens_sql('head')} AS {p}h, has AS {p}has, CASE WHEN has THEN {tokens_sql('relation')} ELSE [] END AS {p}r, CASE WHEN has THEN {tokens_sql(OBJECT)} ELSE [] END AS {p}o, CASE WHEN street IS NULL THEN [] ELSE {NUMBERS} END AS {p}s FROM {analysed('v_names', column)})"

    return f"(SELECT * FROM {side('name', 'a')} JOIN {side('other', 'b')} USING (id))"


def against(a: str, b: str) -> str:
    return f"({a}has AND len({a}o) > 0 AND NOT {b}has AND len({b}h) > 0 AND list_has_all({a}o, {b}h) AND NOT (len({a}h) > 0 AND list_has_all({b}h, {a}h)) AND len({a}h) > 0)"


DISTINCT = f"(len(as_) > 0 AND len(bs) > 0 AND NOT list_has_any(as_, bs)) OR (ahas AND bhas AND list_sort(ah) = list_sort(bh) AND list_sort(ar) <> list_sort(br)) OR {against('a', 'b')} OR {against('b', 'a')}"
SIDES = both_sides().replace(" AS as FROM", " AS as_ FROM")


def both_names(spark, d):
    """(id, a, b) of both names of each id, analysed once."""
    return spread(view(spark, d, "v_names"), "id").select("id", names.analyse(c("name")).alias("a"), names.analyse(c("other")).alias("b"))


@query("names_distinct", twin(f"SELECT id, {DISTINCT} AS apart FROM {SIDES}"))
def names_distinct(spark, d):
    return both_names(spark, d).select("id", names.distinct_things(c("a"), c("b")).alias("apart"))


def sim_sql() -> str:
    dice = dice_sql("sa", "sb")
    inside = "len(list_intersect(ah, bh))::DOUBLE / least(len(list_distinct(ah)), len(list_distinct(bh)))"
    return f"(SELECT id, CASE WHEN e THEN 0e0 ELSE dice END AS dice, CASE WHEN e THEN 0e0 ELSE inside END AS inside, CASE WHEN e THEN 0e0 ELSE inside * w END AS weighted FROM (SELECT id, len(ah) = 0 OR len(bh) = 0 AS e, {dice} AS dice, CASE WHEN len(ah) = 0 OR len(bh) = 0 THEN 0e0 ELSE {inside} END AS inside, CASE WHEN ahas OR bhas THEN 0.7e0 ELSE 0.95e0 END AS w FROM (SELECT *, array_to_string(ah, ' ') AS sa, array_to_string(bh, ' ') AS sb FROM {SIDES})))"


@query("name_similarity", twin(f"SELECT id, round(greatest(dice, weighted), 6) AS score, round(inside, 6) AS containment, weighted > dice AS carried FROM {sim_sql()}"))
def name_similarity(spark, d):
    s = both_names(spark, d).select("id", names.similarity(c("a"), c("b")).alias("s"))
    return s.select("id", F.round("s.score", 6).alias("score"), F.round("s.containment", 6).alias("containment"), "s.carried")


def titles(view_name: str, p: str, columns: str = "title, alt_title") -> str:
    """SQL of the analysed names of a view: one row a record and name, the main one first."""
    every = f"(SELECT * FROM (SELECT id, unnest([1, 2]) AS i, unnest([{columns}]) AS name FROM {view_name}) WHERE name IS NOT NULL)"
    return f"(SELECT id AS {p}id, i AS {p}i, {tokens_sql('head')} AS {p}h, has AS {p}has, CASE WHEN has THEN {tokens_sql('relation')} ELSE [] END AS {p}r, CASE WHEN has THEN {tokens_sql(OBJECT)} ELSE [] END AS {p}o, CASE WHEN street IS NULL THEN [] ELSE {NUMBERS} END AS {p}s FROM {analysed(every, 'name', ', i')})".replace(" AS as FROM", " AS as_ FROM")


INSIDE = "len(list_intersect(ah, bh))::DOUBLE / least(len(list_distinct(ah)), len(list_distinct(bh)))"


def name_scores(key: str, source: str) -> str:
    """SQL of key, ai, bi, apart, dice and weighted of the pairs of names in source."""
    both = f"SELECT {key}, ai, bi, {DISTINCT} AS apart, len(ah) = 0 OR len(bh) = 0 AS e, ah, bh, ahas OR bhas AS has, array_to_string(ah, ' ') AS sa, array_to_string(bh, ' ') AS sb FROM {source}"
    return f"(SELECT *, CASE WHEN e THEN 0e0 ELSE {dice_sql('sa', 'sb')} END AS dice, CASE WHEN e THEN 0e0 ELSE {INSIDE} * CASE WHEN has THEN 0.7e0 ELSE 0.95e0 END END AS weighted FROM ({both}))"


LISTS = name_scores("aid AS id", f"{titles('v_names', 'a', 'name, other')} JOIN {titles('(SELECT id - 1 AS id, name, other FROM v_names)', 'b', 'name, other')} ON bid = aid")


def name_lists(spark, d):
    """Two lists of analysed names for each id: its own two and those of the next."""
    both = both_names(spark, d).select("id", F.array("a", "b").alias("a"))
    return spread(both.join(both.select((c("id") - 1).alias("id"), c("a").alias("b")).hint("merge"), "id"), "id")


query("all_pairs_distinct", twin(f"SELECT id, bool_and(apart) AS apart FROM {LISTS} GROUP BY 1"))(lambda s, d: name_lists(s, d).select("id", names.all_pairs_distinct(c("a"), c("b")).alias("apart")))
query("best_name_similarity", twin(f"SELECT id, round(max(greatest(dice, weighted)), 6) AS score FROM {LISTS} GROUP BY 1"))(
    lambda s, d: name_lists(s, d).select("id", F.round(names.best_similarity(c("a"), c("b"))["score"], 6).alias("score"))
)

# classification ----------------------------------------------------------------------------------------------------

RULES = "".join(f" WHEN regexp_matches(name, {quoted('(?i)' + p)}) THEN {{{i}}}" for i, (_, p, _, _) in enumerate(classify.PLACE_RULES))


def rule_case(pick, battle, park, other) -> str:
    body = "".join(f" WHEN regexp_matches(name, {quoted('(?i)' + r[1])}) THEN {pick(r)}" for r in classify.PLACE_RULES)
    body += "".join(f" WHEN designation = '{k}' THEN {other(k, v)}" for k, v in classify.FALLBACK_KINDS.items())
    return f"CASE WHEN designation = 'registered_battlefield' THEN {battle} WHEN designation = 'registered_park_garden' THEN {park}{body} ELSE {other(None, 'unknown')} END"


KIND = rule_case(lambda r: f"'{r[2]}'", "'battlefield'", "'historic_landscape'", lambda k, v: f"'{v}'")
SURE = rule_case(lambda r: f"{r[3]}e0", "0.98e0", "0.9e0", lambda k, v: "0.3e0" if k else "0e0")
RULE = rule_case(lambda r: f"'{r[0]}'", "'designation:battlefield'", "'designation:park-garden'", lambda k, v: f"'generic-fallback:{k}'" if k else "'generic-fallback'")
INFERRED = lambda: classify.place_type(c("name"), c("designation"))
scalar("infer_place_type", "v_names", lambda: {"kind": INFERRED()["kind"], "confidence": INFERRED()["confidence"], "rule": INFERRED()["rule"]}, f"{KIND} AS kind, {SURE} AS confidence, {RULE} AS rule")
scalar("is_fallback", "v_names", lambda: {"fallback": classify.is_fallback(INFERRED()["rule"])}, f"starts_with({RULE}, 'generic-fallback') AS fallback")
scalar("normalise_grade", "v_designations", lambda: {"known": classify.grade(c("grade")), "warned": classify.grade(c("grade")).isNull() & c("grade").isNotNull()}, "CASE WHEN trim(grade) IN ('I','II*','II','A','B','C') THEN trim(grade) END AS known, grade IS NOT NULL AND trim(grade) NOT IN ('I','II*','II','A','B','C') AS warned")


def compatible_sql(a: str, b: str) -> str:
    kin = " OR ".join(f"({a} IN {any_of(g)} AND {b} IN {any_of(g)})" for g in classify.KIN)
    return f"({a} = {b} OR {a} = 'unknown' OR {b} = 'unknown' OR ({a} = 'structure' AND {b} IN {any_of(classify.BUILT)}) OR ({b} = 'structure' AND {a} IN {any_of(classify.BUILT)}) OR {kin})"


@query("types_compatible", twin(f"SELECT a.place_type AS a, b.place_type AS b, {compatible_sql('a.place_type', 'b.place_type')} AS fits FROM (SELECT DISTINCT place_type FROM v_places) a CROSS JOIN (SELECT DISTINCT place_type FROM v_candidates) b"))
def types_compatible(spark, d):
    """Whether each pair of the kinds in use fits; both sides are vocabularies of a fixed size."""
    a, b = (view(spark, d, v).select(c("place_type").alias(k)).distinct() for v, k in (("v_places", "a"), ("v_candidates", "b")))
    return a.crossJoin(F.broadcast(b)).select("a", "b", classify.types_compatible(c("a"), c("b")).alias("fits"))


scalar("role_predicate_map", "v_audit", lambda: {"predicate": F.when(c("action").isin("click", "view"), "built_by").when(c("action") == "purchase", "owned_by").otherwise("associated_with")}, "CASE WHEN action IN ('click', 'view') THEN 'built_by' WHEN action = 'purchase' THEN 'owned_by' ELSE 'associated_with' END AS predicate")


@query("build_facts", twin("SELECT DISTINCT entity_id, predicate, value FROM v_claims WHERE predicate <> 'postcode'"))
def build_facts(spark, d):
    """Facts of each record: one row a predicate and value, empty ones and repeats left out."""
    claims = view(spark, d, "v_claims").filter("predicate <> 'postcode'")
    facts = claims.groupBy("entity_id").agg(F.collect_set(F.struct("predicate", F.nullif("value", F.lit("")).alias("value"))).alias("f"))
    return facts.select("entity_id", F.explode("f").alias("f")).select("entity_id", "f.predicate", "f.value").filter("value IS NOT NULL")


PUBLISHABLE = ("inception_year", "official_website", "style", "architect")
query("publishable_predicate", twin("SELECT predicate, predicate IN ('inception_year', 'official_website', 'style', 'architect') AS registered, count(*) AS n FROM v_claims GROUP BY 1"))(
    lambda s, d: view(s, d, "v_claims").groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(s.createDataFrame([(x, True) for x in PUBLISHABLE], "predicate string, registered boolean")), "predicate", "left").select("predicate", F.coalesce("registered", F.lit(False)).alias("registered"), "n")
)


@query("enrich_lookup", twin(f"SELECT k.id, p.qid AS added, CASE WHEN lower(k.name) <> lower(p.slug) THEN p.slug END AS alternative, {distance_sql('k.lng', 'k.lat', 'p.lng', 'p.lat')} > 500 AS far FROM v_candidates k LEFT JOIN v_places p ON p.qid = k.qid"))
def enrich_lookup(spark, d):
    """Identifiers and names that a lookup by identifier adds, and whether its position is far off."""
    from ..functions import geo

    p = view(spark, d, "v_places").filter("qid IS NOT NULL").select(c("qid").alias("key"), c("qid").alias("added"), "slug", c("lng").alias("x"), c("lat").alias("y"))
    k = view(spark, d, "v_candidates").join(p, c("qid") == c("key"), "left")
    return k.select("id", "added", F.when(F.lower("name") != F.lower("slug"), c("slug")).alias("alternative"), (geo.haversine_m(c("lng"), c("lat"), c("x"), c("y")) > 500).alias("far"))


# temporal ----------------------------------------------------------------------------------------------------------

FRIEND = " OR ".join(f"regexp_matches(text, {quoted('(?i)' + p)})" for p in temporal.FALSE_FRIENDS)
SPELLED = " ".join(f"WHEN '{w}' THEN {10 + i}" for i, w in enumerate(temporal.SPELLED))
CENTURIES = f"""(SELECT id, k, n FROM (SELECT id, 1 AS k, CAST(unnest(regexp_extract_all(text, '\\bC(\\d{{1,2}})\\b', 1)) AS INTEGER) AS n FROM v_period_text
    UNION ALL SELECT id, 2, CAST(unnest(regexp_extract_all(text, '(?i)\\b(\\d{{1,2}})(?:st|nd|rd|th)[\\s-]century\\b', 1)) AS INTEGER) FROM v_period_text
    UNION ALL SELECT id, 3, CASE lower(w) {SPELLED} END FROM (SELECT id, unnest(regexp_extract_all(text, '(?i)\\b({'|'.join(temporal.SPELLED)})[\\s-]century\\b', 1)) AS w FROM v_period_text)) WHERE n BETWEEN 1 AND 21)"""
query("century_extract", twin(f"SELECT id, n FROM {CENTURIES}"))(lambda s, d: view(s, d, "v_period_text").select("id", F.explode(temporal.centuries(c("text"))).alias("n")))
scalar("period_false_positive", "v_period_text", lambda: {"veto": temporal.is_false_friend(c("text"))}, f"({FRIEND}) AS veto")
WORDS = " UNION ALL ".join(f"SELECT id, {i} AS o, '{k}' AS period, regexp_extract(text, {quoted('(?i)' + p)}, 0) AS hit FROM v_period_text WHERE regexp_matches(text, {quoted('(?i)' + p)}) AND (descriptive OR regexp_matches(text, {quoted('(?i)' + temporal.MONUMENT_NOUNS)}))" for i, (k, p) in enumerate(temporal.PERIOD_WORDS))
query("period_word_extract", twin(f"SELECT id, period, hit FROM ({WORDS})"))(
    lambda s, d: view(s, d, "v_period_text").select("id", F.explode(temporal.period_words(c("text"), c("descriptive"))).alias("x")).select("id", "x.period", c("x.text").alias("hit"))
)
OVER = "least(n * 100, p.end_year) - greatest((n - 1) * 100 + 1, p.start_year)"
SPANNED = f"(SELECT id, k, n, arg_max(pid, (ov, -o)) AS period FROM (SELECT c.id, c.k, c.n, p.id AS pid, p.display_order AS o, {OVER} AS ov FROM {CENTURIES} c, v_periods p WHERE p.id <> 'prehistory') WHERE ov > 0 GROUP BY 1, 2, 3)"


@query("temporal_claims", twin(f"""SELECT id, period, CAST(start_year AS INTEGER) AS start_year, CAST(end_year AS INTEGER) AS end_year, date_precision FROM (SELECT *, row_number() OVER (PARTITION BY id, period ORDER BY k, o) AS rn FROM (
    SELECT id, k, n AS o, period, (n - 1) * 100 + 1 AS start_year, n * 100 AS end_year, 'century' AS date_precision FROM {SPANNED} UNION ALL
    SELECT w.id, 9, w.o, w.period, p.start_year, p.end_year, 'period' FROM ({WORDS}) w JOIN v_periods p ON p.id = w.period)) WHERE rn = 1 AND id NOT IN (SELECT id FROM v_period_text WHERE {FRIEND})"""))
def temporal_claims(spark, d):
    claims = view(spark, d, "v_period_text").select("id", F.explode(temporal.claims(c("text"), c("descriptive"), PERIODS)).alias("x"))
    return claims.select("id", "x.period", "x.start_year", "x.end_year", c("x.precision").alias("date_precision"))


# rights ------------------------------------------------------------------------------------------------------------


def licence_sql(column: str) -> str:
    body = " ".join(f"WHEN regexp_matches({STRIP.format(column)}, {quoted('(?i)' + p)}) THEN '{k}'" for p, k in rights.LICENCES)
    return f"coalesce(CASE {body} END, 'UNKNOWN')"


CODE = licence_sql("licence_short")
CREATOR = f"coalesce({STRIP.format('artist')}, credit)"
SHOWN = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**rights.SHOWN, "UNSUPPORTED": "Not reusable"}.items()) + " ELSE 'Unknown' END"
MEDIA = f"(SELECT *, CASE WHEN NOT (starts_with(code, 'CC-BY') AND creator IS NULL) THEN concat_ws(', ', '\"' || title || '\"', 'by ' || creator, {SHOWN}, 'via Wikimedia Commons') END AS line FROM (SELECT *, {CODE} AS code, {CREATOR} AS creator FROM v_licences))"
REUSE = any_of(rights.SHOWN)
STATE = f"CASE WHEN media_url IS NULL OR page_url IS NULL THEN 'media_invalid' WHEN code = 'UNKNOWN' THEN 'media_rights_incomplete' WHEN code NOT IN {REUSE} THEN 'media_licence_unsupported' WHEN starts_with(code, 'CC-BY') AND creator IS NULL THEN 'media_creator_unknown' WHEN line IS NULL THEN 'media_rights_incomplete' WHEN depicts <> via_qid THEN 'media_association_review' ELSE 'media_ready' END"


def media(spark, d):
    """Media candidates with their licence, creator, attribution and state."""
    m = view(spark, d, "v_licences").withColumns({"code": rights.licence(c("licence_short")), "creator": F.coalesce(text.strip_html(c("artist")), c("credit"))})
    m = m.withColumn("line", rights.attribution(c("title"), c("creator"), c("code")))
    return m.withColumn("state", rights.state(c("media_url"), c("page_url"), c("creator"), c("code"), c("line"), c("depicts") == c("via_qid")))


query("licence_normalise", twin(f"SELECT id, {CODE} AS code FROM v_licences"))(lambda s, d: media(s, d).select("id", "code"))
query("licence_terms", twin(f"SELECT code, code IN {REUSE} AS reusable, starts_with(code, 'CC-BY') AS attribution, contains(code, '-SA-') AS share_alike, count(*) AS n FROM {MEDIA} GROUP BY 1"))(
    lambda s, d: media(s, d).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", rights.is_reusable(c("code")).alias("reusable"), rights.needs_attribution(c("code")).alias("attribution"), c("code").contains("-SA-").alias("share_alike"), "n")
)
query("build_attribution", twin(f"SELECT id, line FROM {MEDIA}"))(lambda s, d: media(s, d).select("id", "line"))
query("assess_rights", twin(f"SELECT id, {STATE} AS state FROM {MEDIA}"))(lambda s, d: media(s, d).select("id", "state"))
LINK = lambda: rights.association(c("depicts"), c("via_qid"), c("via_category"))
scalar("assess_association", "v_licences", lambda: {"outcome": LINK()["outcome"], "confidence": LINK()["confidence"]}, "CASE WHEN depicts = via_qid THEN 'media_match_confident' WHEN via_category <> '' THEN 'media_match_review' ELSE 'media_no_match' END AS outcome, CASE WHEN depicts = via_qid THEN 0.95e0 WHEN via_category <> '' THEN 0.5e0 ELSE 0e0 END AS confidence")
query("creator_extract", twin(f"SELECT id, creator, artist FROM {MEDIA}"))(lambda s, d: media(s, d).select("id", "creator", "artist"))
query("publish_media", twin(f"SELECT id, media_url, line, CASE WHEN {STATE} = 'media_ready' THEN 'published' ELSE 'refused' END AS outcome FROM {MEDIA}"))(
    lambda s, d: media(s, d).select("id", "media_url", "line", F.when(c("state") == "media_ready", "published").otherwise("refused").alias("outcome"))
)
query("review_media", twin(f"SELECT id, {STATE.replace('depicts <> via_qid', 'depicts <> via_qid AND id % 3 <> 0')} AS state FROM {MEDIA}"))(
    lambda s, d: media(s, d).select("id", rights.state(c("media_url"), c("page_url"), c("creator"), c("code"), c("line"), (c("depicts") == c("via_qid")) | (c("id") % 3 == 0)).alias("state"))
)
query("media_queue", twin(f"SELECT id, title, code, {STATE} AS state FROM {MEDIA} WHERE {STATE} <> 'media_ready' ORDER BY id LIMIT 100"))(
    lambda s, d: media(s, d).filter("state <> 'media_ready'").orderBy("id").limit(100).select("id", "title", "code", "state")
)

# matching ----------------------------------------------------------------------------------------------------------

FIELDS_SQL = """k.id AS l, p.id AS r, k.accuracy AS la, p.accuracy AS ra, k.place_type AS lt, p.place_type AS rt, k.type_confidence AS lc, p.type_confidence AS rc,
    k.postcode AS lp, p.postcode AS rp, k.town AS lw, p.town AS rw, k.source_id AS ls, p.source_id AS rs, k.designation AS ld, p.designation AS rd, k.title AS ln, p.title AS rn"""
METRES = distance_sql("k.lng", "k.lat", "p.lng", "p.lat")
NEAR = f"near AS (SELECT {FIELDS_SQL}, {METRES} AS metres FROM v_candidates k JOIN v_places p ON p.lat BETWEEN k.lat - 0.05e0 AND k.lat + 0.05e0 WHERE {METRES} <= 5000)"
SHARED = f"shared AS (SELECT {FIELDS_SQL}, {METRES} AS metres FROM v_candidates k JOIN v_places p ON p.qid = k.qid)"
CONFLICTS = f"concat_ws(',', CASE WHEN lc >= 0.7e0 AND NOT {compatible_sql('lt', 'rt')} THEN 'place_type' END, CASE WHEN metres > 500 THEN 'location' END, CASE WHEN lp <> rp THEN 'postcode' END)"


TITLES = f"ta AS {titles('v_candidates', 'a')}, tb AS {titles('v_places', 'b')}"


def named(name: str, pairs: str) -> str:
    """SQL of pairs with what their titles say: apart, sim and carried."""
    best = f"SELECT l, r, bool_and(apart) AS apart, max(greatest(dice, weighted)) AS sim, arg_max(weighted > dice, (greatest(dice, weighted), -ai, -bi)) AS carried FROM {name_scores('l, r', f'{pairs} JOIN ta ON aid = l JOIN tb ON bid = r')} GROUP BY 1, 2"
    return f"{name} AS (SELECT x.*, y.apart, y.sim, y.carried FROM {pairs} x JOIN ({best}) y ON y.l = x.l AND y.r = x.r)"


RADIUS = "least(greatest(50e0, la, coalesce(ra, 0e0)), 150e0)"
POST = "upper(regexp_replace({0}, '\\s+', '', 'g'))"
GENERIC_PAIR = f"({GENERIC_SQL.format(tokens_sql('ln'))} AND {GENERIC_SQL.format(tokens_sql('rn'))})"
REGISTER = "ls = rs AND l <> r AND ld = rd"
SIGNALS = f"""sig AS (SELECT *, CASE WHEN metres <= radius THEN 0.45e0 WHEN metres <= 250 THEN 0.3e0 WHEN metres <= 1000 THEN 0.1e0 ELSE -0.1e0 END AS s_distance, CASE WHEN sim >= 0.92e0 THEN CASE WHEN generic THEN 0.1e0 ELSE 0.4e0 END WHEN sim >= 0.75e0 THEN 0.2e0 WHEN sim >= 0.55e0 THEN 0.05e0 ELSE -0.2e0 END AS s_name,
    CASE WHEN lc >= 0.7e0 AND rc >= 0.7e0 AND {compatible_sql('lt', 'rt')} THEN 0.1e0 WHEN lc >= 0.7e0 AND NOT {compatible_sql('lt', 'rt')} THEN -0.35e0 ELSE 0e0 END AS s_type,
    CASE WHEN lp IS NULL OR rp IS NULL THEN 0e0 WHEN {POST.format('lp')} = {POST.format('rp')} THEN 0.2e0 ELSE -0.15e0 END AS s_postcode, CASE WHEN lower(lw) = lower(rw) THEN 0.05e0 ELSE 0e0 END AS s_town,
    {REGISTER} AS register_veto, {CONFLICTS} AS conflicts, (ld IN {any_of(classify.AREAS)}) <> (rd IN {any_of(classify.AREAS)}) AS area FROM (SELECT *, {RADIUS} AS radius, {GENERIC_PAIR} AS generic FROM pair)),
    scored AS (SELECT *, greatest(0e0, least(1e0, s_distance + s_name + s_type + s_postcode + s_town)) AS score FROM sig)"""
ALL = f"WITH {NEAR}, {TITLES}, {named('pair', 'near')}, {SIGNALS}"


def records(spark, d, name: str):
    """A view's records as the matcher takes them: named by their titles, with names analysed."""
    return op.prepared(view(spark, d, name).withColumns({"name": c("title"), "alt_names": F.array_compact(F.array("alt_title"))}))


def both_records(spark, d):
    return records(spark, d, "v_candidates"), records(spark, d, "v_places")


def pair_query(name: str, columns: dict, sql: str, where: str = "", only: str | None = None):
    """Near pairs with columns of them: the name of a column of pairs, and what is made of it."""

    def run(spark, d):
        return compared.compared(*both_records(spark, d), op.FARTHEST_M, tuple(k for k, _ in columns.values()), only).select("l", "r", *[f(c(k)).alias(x) for x, (k, f) in columns.items()])

    query(name, twin(f"{ALL} SELECT l, r, {sql} FROM scored {where}"))(run)


AS_IS = lambda x: x
pair_query("agreement_radius", {"radius": ("radius", AS_IS)}, "radius")
pair_query("distance_signal", {"weight": ("s_distance", AS_IS)}, "s_distance AS weight")
pair_query("name_signal", {"sim": ("sim", lambda x: F.round(x, 6)), "weight": ("s_name", AS_IS)}, "round(sim, 6) AS sim, s_name AS weight")
pair_query("type_signal", {"weight": ("s_type", AS_IS)}, "s_type AS weight")
pair_query("postcode_town_signal", {"postcode": ("s_postcode", AS_IS), "town": ("s_town", AS_IS)}, "s_postcode AS postcode, s_town AS town")
pair_query("register_veto", {"metres": ("metres", lambda x: F.round(x, 3))}, "round(metres, 3) AS metres", "WHERE register_veto", "register_veto")
pair_query("score_pair", {"score": ("score", lambda x: F.round(x, 9))}, "round(score, 9) AS score", "WHERE NOT register_veto AND NOT apart", "free")
pair_query("name_veto", {"metres": ("metres", lambda x: F.round(x, 3))}, "round(metres, 3) AS metres", "WHERE apart", "name_veto")
pair_query("collect_conflicts", {"conflicts": ("found", lambda x: F.get(F.array(*[F.array_join(op.conflicts_of(F.lit(n)), ",") for n in range(8)]), x))}, "conflicts")
pair_query("area_vs_structure", {"area": ("area", AS_IS)}, "area")


def near_count(spark, d):
    """How many near pairs there are, in one row (n)."""
    return compared.counted(view(spark, d, "v_candidates"), view(spark, d, "v_places"), op.FARTHEST_M, {})


@query("distance_veto", twin(f"WITH {NEAR} SELECT count(*) AS kept, (SELECT count(*) FROM v_candidates) * (SELECT count(*) FROM v_places) - count(*) AS vetoed FROM near"))
def distance_veto(spark, d):
    k, p = view(spark, d, "v_candidates"), view(spark, d, "v_places")
    sizes = k.agg(F.count(F.lit(1)).alias("a")).crossJoin(p.agg(F.count(F.lit(1)).alias("b")))
    return near_count(spark, d).crossJoin(sizes).select(c("n").alias("kept"), (c("a") * c("b") - c("n")).alias("vetoed"))


@query("shared_identifier", twin("SELECT k.id AS l, p.id AS r FROM v_candidates k JOIN v_places p ON k.qid = p.qid"))
def shared_identifier(spark, d):
    return op.shared_identifiers(view(spark, d, "v_candidates"), view(spark, d, "v_places"))


query("join_identifier", twin("SELECT k.id AS l, p.id AS r FROM v_candidates k JOIN v_places p ON k.qid = p.qid"))(shared_identifier)
UNION = f"WITH {NEAR} SELECT l, r FROM near UNION SELECT k.id, p.id FROM v_candidates k JOIN v_places p ON k.qid = p.qid"


def shortlist(spark, d):
    return op.shortlisted(view(spark, d, "v_candidates"), view(spark, d, "v_places"))


query("join_union_pairs", twin(UNION))(shortlist)
query("union_shortlist", twin(f"SELECT l, count(*) AS candidates FROM ({UNION}) GROUP BY 1"))(lambda s, d: shortlist(s, d).groupBy("l").agg(F.count(F.lit(1)).alias("candidates")))
DECIDED = f"""{ALL}, {SHARED}, {named('told', 'shared')}, by_id AS (SELECT l, arg_min(outcome, r) AS outcome, min(r) AS matched, arg_min(confidence, r) AS confidence FROM (SELECT l, r, CASE WHEN apart THEN 'MATCH_REVIEW' WHEN {CONFLICTS} <> '' THEN 'CONFLICT_REVIEW' ELSE 'MATCH_CONFIDENT' END AS outcome,
        CASE WHEN apart THEN 0.5e0 ELSE 1e0 END AS confidence FROM told WHERE NOT ({REGISTER})) GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS k FROM scored WHERE NOT register_veto AND NOT apart),
    best AS (SELECT b.*, s.score AS second FROM (SELECT * FROM ranked WHERE k = 1) b LEFT JOIN (SELECT l, score FROM ranked WHERE k = 2) s ON s.l = b.l),
    decided AS (SELECT v.id, coalesce(i.outcome, CASE WHEN score IS NULL OR score < 0.5e0 THEN 'NEW_CANONICAL' WHEN conflicts <> '' THEN 'CONFLICT_REVIEW' WHEN score >= 0.85e0 AND sim >= 0.9e0 AND NOT generic AND NOT (second IS NOT NULL AND score - second < 0.1e0) AND NOT area AND NOT carried AND metres <= radius THEN 'MATCH_CONFIDENT' ELSE 'MATCH_REVIEW' END) AS outcome,
        coalesce(i.matched, CASE WHEN score >= 0.5e0 THEN r END) AS matched, coalesce(i.confidence, score, 0e0) AS confidence FROM v_candidates v LEFT JOIN best ON best.l = v.id LEFT JOIN by_id i ON i.l = v.id)"""


def decided(spark, d):
    candidates, places = both_records(spark, d)
    return op.decided(candidates, compared.tallied(candidates, places, op.FARTHEST_M), op.identified_pairs(candidates, places))


query("match_decision", twin(f"{DECIDED} SELECT id, outcome, matched, round(confidence, 9) AS confidence FROM decided"))(lambda s, d: decided(s, d).withColumn("confidence", F.round("confidence", 9)))
query("run_report", twin(f"{DECIDED} SELECT outcome, count(*) AS n FROM decided GROUP BY 1"))(lambda s, d: decided(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
CLASS = "CASE WHEN outcome IN ('NEW_CANONICAL', 'MATCH_CONFIDENT') THEN 'AUTO_SAFE' WHEN outcome = 'REJECT_INVALID' THEN 'REJECTED' ELSE 'REVIEW_REQUIRED' END"


def policy(outcome):
    return F.when(outcome.isin("NEW_CANONICAL", "MATCH_CONFIDENT"), "AUTO_SAFE").when(outcome == "REJECT_INVALID", "REJECTED").otherwise("REVIEW_REQUIRED")


query("publication_policy", twin(f"{DECIDED} SELECT id, {CLASS} AS class, CASE WHEN outcome IN ('NEW_CANONICAL', 'MATCH_CONFIDENT') THEN 'approved' ELSE 'needs_review' END AS state FROM decided"))(
    lambda s, d: decided(s, d).select("id", policy(c("outcome")).alias("class"), F.when(policy(c("outcome")) == "AUTO_SAFE", "approved").otherwise("needs_review").alias("state"))
)
query("review_cause", twin(f"{DECIDED} SELECT CASE WHEN outcome = 'CONFLICT_REVIEW' THEN 'sources disagree' WHEN outcome = 'MATCH_REVIEW' THEN 'not distinctive' ELSE 'none' END AS cause, count(*) AS n FROM decided GROUP BY 1"))(
    lambda s, d: decided(s, d).groupBy(F.when(c("outcome") == "CONFLICT_REVIEW", "sources disagree").when(c("outcome") == "MATCH_REVIEW", "not distinctive").otherwise("none").alias("cause")).agg(F.count(F.lit(1)).alias("n"))
)
#: What pairs are counted by: the columns it asks for, and which pairs count.
WORK = {
    "by_register": (("register_veto",), lambda p: p._register == 1), "by_name": (("name_veto", "register_veto"), lambda p: p.name_veto & (p._register == 0)),
    "beyond_1km": ((), lambda p: p.metres > 1000),
}
query("match_work_stats", twin(f"{ALL} SELECT count(*) AS comparisons, count(*) FILTER (WHERE register_veto) AS by_register, count(*) FILTER (WHERE apart AND NOT register_veto) AS by_name, count(*) FILTER (WHERE metres > 1000) AS beyond_1km FROM scored"))(
    lambda s, d: compared.counted(*both_records(s, d), op.FARTHEST_M, WORK).select(c("n").alias("comparisons"), *WORK)
)


@query("candidate_stats", twin(f"WITH {NEAR} SELECT (SELECT count(*) FROM v_candidates) * (SELECT count(*) FROM v_places) AS possible, count(*) AS candidates, round(1e0 - count(*) * 1e0 / ((SELECT count(*) FROM v_candidates) * (SELECT count(*) FROM v_places)), 6) AS pruned FROM near"))
def candidate_stats(spark, d):
    k, p = view(spark, d, "v_candidates"), view(spark, d, "v_places")
    sizes = k.agg(F.count(F.lit(1)).alias("a")).crossJoin(p.agg(F.count(F.lit(1)).alias("b"))).select((c("a") * c("b")).alias("possible"))
    return near_count(spark, d).crossJoin(sizes).select("possible", c("n").alias("candidates"), F.round(1 - c("n") / c("possible"), 6).alias("pruned"))


@query("exhaustive_vs_bounded", twin(f"""WITH bounded AS (SELECT k.id AS l, p.id AS r FROM v_candidates k JOIN v_places p ON p.lat BETWEEN k.lat - 0.05e0 AND k.lat + 0.05e0 WHERE {METRES} <= 5000 AND k.id % 50 = 0),
    every AS (SELECT k.id AS l, p.id AS r FROM v_candidates k, v_places p WHERE {METRES} <= 5000 AND k.id % 50 = 0)
    SELECT (SELECT count(*) FROM bounded) AS bounded, (SELECT count(*) FROM every) AS exhaustive, (SELECT count(*) FROM (SELECT * FROM bounded EXCEPT SELECT * FROM every)) + (SELECT count(*) FROM (SELECT * FROM every EXCEPT SELECT * FROM bounded)) AS differences"""))
def exhaustive_vs_bounded(spark, d):
    """Pairs and decisions by blocking, and by comparing a stated set of queries with all places, block by block; no decision may differ.

    The queries are the candidates whose id is divisible by 50. Both counts and both decisions come from one pass over
    the pairs of either way.
    """
    candidates, places = both_records(spark, d)
    asked = candidates.filter("id % 50 = 0")
    shared = op.identified_pairs(asked, places)
    checkpoint_folder(spark)
    bounded, every = (way(asked, places, op.FARTHEST_M).checkpoint() for way in (compared.tallied, compared.tallied_of_all))
    one, two = op.decided(asked, bounded, shared), op.decided(asked, every, shared)
    pairs = lambda df, n: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(n))
    odd = one.exceptAll(two).union(two.exceptAll(one)).agg(F.count(F.lit(1)).alias("differences"))
    return pairs(bounded, "bounded").crossJoin(pairs(every, "exhaustive")).crossJoin(odd)


query("source_pair_relation", twin(f"WITH {NEAR} SELECT l, r, CASE WHEN ls IS NOT DISTINCT FROM rs THEN 'SAME_SOURCE' ELSE 'CROSS_SOURCE' END AS relation FROM near"))(
    lambda s, d: compared.compared(view(s, d, "v_candidates"), view(s, d, "v_places"), op.FARTHEST_M, ("same_source",)).select("l", "r", F.when(c("same_source"), "SAME_SOURCE").otherwise("CROSS_SOURCE").alias("relation"))
)
query("same_source_overlap", twin(f"WITH {NEAR} SELECT l, r, CASE WHEN l = r THEN 'REPEATED_ENTRY' WHEN ld <> rd THEN 'MULTI_DESIGNATION' ELSE 'DISTINCT_ENTRIES' END AS overlap FROM near WHERE ls = rs"))(
    lambda s, d: op.near_pairs(view(s, d, "v_candidates"), view(s, d, "v_places"), op.FARTHEST_M, keep=("source_id", "designation")).filter("l_source_id = r_source_id").select("l", "r", F.when(c("l") == c("r"), "REPEATED_ENTRY").when(c("l_designation") != c("r_designation"), "MULTI_DESIGNATION").otherwise("DISTINCT_ENTRIES").alias("overlap"))
)
