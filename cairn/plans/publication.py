"""Queries on comparison, publication, governance and sources."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, items, names
from ..functions.text import let
from ..operators import compare as cmp
from ..operators import publish as op
from ..operators.ranks import ordered_digest
from ..operators.reports import unique_slugs
from ..operators.spread import spread
from .basics import c, digest_sql, distance_sql
from .catalog import query
from .matching import compatible_sql
from .resolution import RESOLVED
from .substrate import twin, view


# comparison of candidates (new) with the place of the same number (known) --------------------------------------------

BOTH = """sides AS (SELECT p.id, p.name AS pn, k.name AS kn, p.place_type AS pt, k.place_type AS kt, p.type_confidence AS pc, k.type_confidence AS kc, p.qid AS pq, k.qid AS kq, p.designation AS pd, k.designation AS kd,
    p.accuracy AS pa, k.accuracy AS ka, %s AS metres, CASE WHEN p.id %% 5 = 0 THEN NULL ELSE 1700 + p.id %% 90 END AS py, CASE WHEN p.id %% 7 = 0 THEN NULL ELSE 1700 + p.id %% 77 END AS ky,
    CASE WHEN p.id %% 4 = 0 THEN NULL ELSE 'https://www.h' || p.id %% 9 || '.example/a' END AS pw, CASE WHEN p.id %% 6 = 0 THEN NULL ELSE 'http://h' || p.id %% 8 || '.example/b' END AS kw FROM v_places p JOIN v_candidates k ON p.id = k.id)""" % distance_sql("p.lng", "p.lat", "k.lng", "k.lat")


def both(spark, d):
    p, k = view(spark, d, "v_places").alias("p"), view(spark, d, "v_candidates").alias("k")
    i = c("p.id")
    return spread(p.join(k, i == c("k.id")), "p.id").select(
        i, c("p.name").alias("pn"), c("k.name").alias("kn"), c("p.place_type").alias("pt"), c("k.place_type").alias("kt"), c("p.type_confidence").alias("pc"), c("k.type_confidence").alias("kc"),
        c("p.qid").alias("pq"), c("k.qid").alias("kq"), c("p.designation").alias("pd"), c("k.designation").alias("kd"), c("p.accuracy").alias("pa"), c("k.accuracy").alias("ka"),
        geo.haversine_m(c("p.lng"), c("p.lat"), c("k.lng"), c("k.lat")).alias("metres"), F.when(i % 5 != 0, 1700 + i % 90).alias("py"), F.when(i % 7 != 0, 1700 + i % 77).alias("ky"),
        F.when(i % 4 != 0, F.concat(F.lit("https://www.h"), i % 9, F.lit(".example/a"))).alias("pw"), F.when(i % 6 != 0, F.concat(F.lit("http://h"), i % 8, F.lit(".example/b"))).alias("kw"),
    )


ids = lambda x: F.array_compact(F.array(c(x)))
FIELDS = {
    "cmp_identifiers": (lambda: cmp.identifiers(ids("pq"), ids("kq")), "CASE WHEN kq IS NOT NULL THEN CASE WHEN pq IS NULL THEN 'COMPLEMENTARY' WHEN pq = kq THEN 'AGREEMENT' ELSE 'CONFLICT' END END"),
    "cmp_name": (lambda: let(F.struct(names.analyse(c("pn")).alias("p"), names.analyse(c("kn")).alias("k")), lambda s: cmp.name(names.similarity(s["p"], s["k"])["score"])), "CASE WHEN pn = kn THEN 'AGREEMENT' ELSE 'COMPLEMENTARY' END"),
    "cmp_type": (lambda: cmp.kind(c("pt"), c("pc"), c("kt"), c("kc")), f"CASE WHEN kc >= 0.7e0 THEN CASE WHEN pc < 0.7e0 THEN 'COMPLEMENTARY' WHEN {compatible_sql('pt', 'kt')} THEN 'AGREEMENT' ELSE 'CONFLICT' END END"),
    "cmp_position": (lambda: cmp.position(geo.positions_conflict(c("metres"), c("pa"), c("ka"))), "CASE WHEN metres > pa + ka + 25e0 THEN 'CONFLICT' ELSE 'AGREEMENT' END"),
    "cmp_inception": (lambda: cmp.year(c("py"), c("ky")), "CASE WHEN ky IS NOT NULL THEN CASE WHEN py IS NULL THEN 'COMPLEMENTARY' WHEN abs(py - ky) <= 25 THEN 'AGREEMENT' ELSE 'CONFLICT' END END"),
    "cmp_website": (lambda: cmp.website(c("pw"), c("kw")), "CASE WHEN kw IS NOT NULL THEN CASE WHEN pw IS NULL THEN 'COMPLEMENTARY' WHEN replace(regexp_extract(pw, '//([^/]+)', 1), 'www.', '') = regexp_extract(kw, '//([^/]+)', 1) THEN 'AGREEMENT' ELSE 'CONFLICT' END END"),
    "cmp_designations": (lambda: cmp.designation(F.array("pd"), c("kd")), "CASE WHEN pd = kd THEN 'AGREEMENT' ELSE 'COMPLEMENTARY' END"),
}
for _key, (_column, _sql) in FIELDS.items():
    query(_key, twin(f"WITH {BOTH} SELECT id, {_sql} AS outcome FROM sides"))(lambda s, d, x=_column: both(s, d).select("id", x().alias("outcome")))
LISTED = "[" + ", ".join(sql for _, sql in FIELDS.values()) + "]"
query("cmp_outcome", twin(f"WITH {BOTH} SELECT id, CASE WHEN list_contains({LISTED}, 'CONFLICT') THEN 'CONFLICT' WHEN list_contains({LISTED}, 'COMPLEMENTARY') THEN 'COMPLEMENTARY' ELSE 'AGREEMENT' END AS outcome FROM sides"))(
    lambda s, d: both(s, d).select("id", cmp.overall(F.array_compact(F.array(*[x() for x, _ in FIELDS.values()]))).alias("outcome"))
)
query("field_difference", twin(f"WITH {BOTH} SELECT id, CASE WHEN kq IS NULL THEN 'missing' WHEN pq IS NULL THEN 'complementary' WHEN pq = kq THEN 'agreement' ELSE 'conflict' END AS qid, CASE WHEN kt IS NULL THEN 'missing' WHEN pt IS NULL THEN 'complementary' WHEN pt = kt THEN 'agreement' ELSE 'conflict' END AS kind FROM sides"))(
    lambda s, d: both(s, d).select("id", cmp.for_review(c("pq"), c("kq")).alias("qid"), cmp.for_review(c("pt"), c("kt")).alias("kind"))
)

# publication -------------------------------------------------------------------------------------------------------

STAGED = """staged AS (SELECT k.id, k.source_id, CASE WHEN k.id % 8 = 0 THEN 'needs_review' ELSE 'approved' END AS state, coalesce(x.n, 0) AS unresolved, k.id % 50 = 1 AS published, CASE WHEN k.id % 9 = 0 THEN k.id * 3 END AS matched, p.id AS target
    FROM v_candidates k LEFT JOIN (SELECT place_id, count(*) AS n FROM v_temporal WHERE status <> 'approved' GROUP BY 1) x ON x.place_id = k.id LEFT JOIN v_places p ON p.id = CASE WHEN k.id % 9 = 0 THEN k.id * 3 END)"""
GATE = "CASE WHEN published THEN 'already_published' WHEN state <> 'approved' THEN 'refused: not approved' WHEN unresolved > 0 THEN 'refused: unresolved conflict' WHEN source_id IS NULL THEN 'refused: no provenance' WHEN matched IS NOT NULL AND target IS NULL THEN 'refused: match target missing' ELSE 'published' END"


def staged(spark, d):
    k = view(spark, d, "v_candidates").select("id", "source_id", "name", "place_type")
    open_ = view(spark, d, "v_temporal").filter("status <> 'approved'").groupBy(c("place_id").alias("id")).agg(F.count(F.lit(1)).alias("unresolved"))
    k = k.join(open_, "id", "left").withColumns({"unresolved": F.coalesce("unresolved", F.lit(0)), "state": F.when(c("id") % 8 == 0, "needs_review").otherwise("approved"), "published": c("id") % 50 == 1, "matched": F.when(c("id") % 9 == 0, c("id") * 3)})
    return k.join(view(spark, d, "v_places").select(c("id").alias("target")), c("matched") == c("target"), "left")


query("publish_gate", twin(f"WITH {STAGED} SELECT id, {GATE} AS verdict FROM staged"))(lambda s, d: staged(s, d).select("id", op.gate(None).alias("verdict")))
query("publication_log", twin(f"WITH {STAGED} SELECT split_part({GATE}, ':', 1) AS status, count(*) AS n FROM staged GROUP BY 1"))(
    lambda s, d: staged(s, d).groupBy(F.split(op.gate(None), ":")[0].alias("status")).agg(F.count(F.lit(1)).alias("n"))
)


@query("publish_place", twin(f"WITH {STAGED}, ok AS (SELECT * FROM staged WHERE {GATE} = 'published') SELECT id, CASE WHEN matched IS NULL THEN 'created' ELSE 'attached' END AS action, CASE WHEN matched IS NULL THEN 'place-' || id % 100 || CASE WHEN k = 1 THEN '' ELSE '-' || k END END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY matched IS NULL, id % 100 ORDER BY id) AS k FROM ok)"))
def publish_place(spark, d):
    """New places with a slug of their own, and candidates attached to the place they match."""
    ok = staged(spark, d).filter(op.gate(None) == "published")
    new = unique_slugs(ok.filter("matched IS NULL").select("id", F.concat(F.lit("place-"), c("id") % 100).alias("base")), "base", "id")
    return new.select("id", F.lit("created").alias("action"), "slug").unionByName(ok.filter("matched IS NOT NULL").select("id", F.lit("attached").alias("action"), F.lit(None).cast("string").alias("slug")))


OLD = "SELECT entity_id, predicate, source_id, min(value) AS value, min(ordinal) AS ordinal FROM v_claims WHERE ordinal <= 2 GROUP BY 1, 2, 3"
NEW = "SELECT entity_id, predicate, source_id, max(value) AS value, max(ordinal) AS ordinal FROM v_claims WHERE ordinal >= 2 GROUP BY 1, 2, 3"
KEY = ["entity_id", "predicate", "source_id"]


def versions(spark, d):
    claims = view(spark, d, "v_claims")
    side = lambda keep, f: claims.filter(keep).groupBy(*KEY).agg(f("value").alias("value"), f("ordinal").alias("ordinal"))
    return side("ordinal <= 2", F.min), side("ordinal >= 2", F.max)


UPSERTED = f"SELECT coalesce(b.entity_id, a.entity_id) AS entity_id, coalesce(b.predicate, a.predicate) AS predicate, coalesce(b.source_id, a.source_id) AS source_id, coalesce(b.value, a.value) AS value, coalesce(b.ordinal, a.ordinal) AS ordinal FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.entity_id = b.entity_id AND a.predicate = b.predicate AND a.source_id = b.source_id"
query("upsert_source_record", twin(UPSERTED))(lambda s, d: op.upsert(*versions(s, d), KEY, "ordinal"))


@query("replay_idempotent", twin(f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS changed FROM ({UPSERTED})"))
def replay_idempotent(spark, d):
    """Rows after an upsert, and how many a second run of it changes."""
    old, new = versions(spark, d)
    once = op.upsert(old, new, KEY, "ordinal")
    return op.replayed(once, op.upsert(once, new, KEY, "ordinal"))


FACTS = "facts AS (SELECT entity_id, predicate, source_id, min(value) AS value, min(ordinal) AS ordinal FROM v_claims WHERE predicate <> 'postcode' GROUP BY 1, 2, 3)"


def facts(spark, d):
    return view(spark, d, "v_claims").filter("predicate <> 'postcode'").groupBy(*KEY).agg(F.min("value").alias("value"), F.min("ordinal").alias("ordinal")).withColumn("o", F.struct("ordinal", "source_id"))


query("publish_facts", twin(f"WITH {FACTS} SELECT entity_id, predicate, source_id, value, row_number() OVER (PARTITION BY entity_id, predicate ORDER BY ordinal, source_id) = 1 AS is_preferred FROM facts"))(
    lambda s, d: op.first_preferred(facts(s, d), ["entity_id", "predicate"], "o").select(*KEY, "value", "is_preferred")
)
PROMOTED = f"WITH {FACTS}, f1 AS (SELECT *, row_number() OVER (PARTITION BY entity_id, predicate ORDER BY ordinal, source_id) = 1 AS p, CASE WHEN source_id % 3 = 0 THEN source_id END AS promoted FROM facts), f2 AS (SELECT *, max(promoted) OVER (PARTITION BY entity_id, predicate) AS last FROM f1)"
STANDS = "CASE WHEN predicate IN ('inception_year', 'official_website') THEN coalesce(promoted = last, false) OR (last IS NULL AND p) ELSE promoted IS NOT NULL OR p END"


def promoted(spark, d):
    f = op.first_preferred(facts(spark, d), ["entity_id", "predicate"], "o").withColumn("promoted", F.when(c("source_id") % 3 == 0, c("source_id")))
    return op.preferred_after(f, ["entity_id", "predicate"], "promoted", c("predicate").isin("inception_year", "official_website"))


query("apply_preference", twin(f"{PROMOTED} SELECT entity_id, predicate, source_id, {STANDS} AS is_preferred FROM f2"))(lambda s, d: promoted(s, d).select(*KEY, "is_preferred"))
query("single_preferred", twin(f"{PROMOTED} SELECT predicate, max(n) AS most FROM (SELECT entity_id, predicate, count(*) FILTER (WHERE {STANDS}) AS n FROM f2 GROUP BY 1, 2) GROUP BY 1"))(
    lambda s, d: promoted(s, d).groupBy("entity_id", "predicate").agg(F.count_if("is_preferred").alias("n")).groupBy("predicate").agg(F.max("n").alias("most"))
)
query("publish_relationships", twin("SELECT DISTINCT subject_id, predicate, object_id FROM v_edges WHERE subject_type = 'place' AND object_id IN (SELECT id FROM v_people)"))(
    lambda s, d: view(s, d, "v_edges").filter("subject_type = 'place'").join(view(s, d, "v_people").select(c("id").alias("object_id")), "object_id", "left_semi").select("subject_id", "predicate", "object_id").distinct()
)


@query("resolve_person", twin("SELECT m.id, CASE WHEN a.id IS NOT NULL THEN a.id::VARCHAR WHEN b.id IS NOT NULL THEN b.id::VARCHAR ELSE 'person:' || substr(sha256(m.slug), 1, 12) END AS person_id, CASE WHEN a.id IS NOT NULL THEN 'external id' WHEN b.id IS NOT NULL THEN 'slug' ELSE 'created' END AS found_by FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'X' || id END AS external_id, 'supplier-' || lpad((id % 150)::VARCHAR, 9, '0') AS slug FROM v_places) m LEFT JOIN v_people a ON 'X' || a.id = m.external_id LEFT JOIN v_people b ON b.slug = m.slug"))
def resolve_person(spark, d):
    mentions = view(spark, d, "v_places").select("id", F.when(c("id") % 3 == 0, F.concat(F.lit("X"), c("id"))).alias("external_id"), F.concat(F.lit("supplier-"), F.lpad((c("id") % 150).cast("string"), 9, "0")).alias("slug"))
    people = view(spark, d, "v_people").select("id", "slug", F.concat(F.lit("X"), c("id")).alias("external_id"))
    return op.resolve_people(mentions, people).select("id", "person_id", "found_by")


query("attach_by_source_record", twin("SELECT k.id, min(p.id) AS place_id FROM v_candidates k JOIN v_places p ON p.qid = k.qid GROUP BY 1"))(
    lambda s, d: view(s, d, "v_candidates").join(view(s, d, "v_places").select("qid", c("id").alias("place_id")), "qid").groupBy("id").agg(F.min("place_id").alias("place_id"))
)


@query("preview_candidate", twin(f"""WITH {STAGED} SELECT id, '{{"action":"' || CASE WHEN {GATE} <> 'published' THEN {GATE} WHEN matched IS NULL THEN 'create' ELSE 'attach' END || '"' || coalesce(',"matched":' || matched, '') || ',"unresolved":' || unresolved || ',"blockers":[' || CASE WHEN unresolved > 0 THEN '"conflicts"' ELSE '' END || ']}}' AS preview FROM staged"""))
def preview_candidate(spark, d):
    """What publishing each candidate would do, as a document; nothing is written."""
    s = staged(spark, d).withColumn("verdict", op.gate(None))
    action = F.when(c("verdict") != "published", c("verdict")).when(c("matched").isNull(), "create").otherwise("attach")
    return s.select("id", F.to_json(F.struct(action.alias("action"), "matched", "unresolved", F.filter(F.array(F.when(c("unresolved") > 0, "conflicts")), lambda x: x.isNotNull()).alias("blockers"))).alias("preview"))


DECISION = "CASE action WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'needs_review' WHEN 'click' THEN 'approved' ELSE 'published' END"
EDITORS = "('editor', 'moderator', 'admin')"
DECISIONS = f"told AS (SELECT a.id AS decision_id, a.target_id AS candidate_id, {DECISION} AS decision, a.id % 1000 AS actor, coalesce(p.role IN {EDITORS}, false) AS editor, a.moment FROM v_audit a LEFT JOIN v_profiles p ON p.user_id = a.id % 1000)"
REVIEWED = f"""{DECISIONS}, verdicts AS (SELECT d.*, s.state AS first, CASE WHEN NOT editor THEN 'refused: not an editor' WHEN decision NOT IN ('approved', 'rejected', 'needs_review') THEN 'refused: not a reviewer''s decision' WHEN s.id IS NULL THEN 'refused: no such candidate' WHEN s.published THEN 'refused: already published' END AS refused
    FROM told d LEFT JOIN staged s ON s.id = d.candidate_id), replayed AS (SELECT *, coalesce(last_value(CASE WHEN refused IS NULL THEN decision END IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY moment, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first) AS prior FROM verdicts)"""


def decisions_asked(spark, d):
    """Reviewers' decisions: one for each event, on the candidate it names, by an actor with a role."""
    actions = {"purchase": "approved", "error": "rejected", "view": "needs_review", "click": "approved"}
    chosen = F.coalesce(F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])[c("action")], F.lit("published"))
    roles = view(spark, d, "v_profiles").select(c("user_id").alias("actor"), c("role").isin("editor", "moderator", "admin").alias("editor"))
    asked = view(spark, d, "v_audit").select(c("id").alias("decision_id"), c("target_id").alias("candidate_id"), chosen.alias("decision"), (c("id") % 1000).alias("actor"), "moment")
    return asked.join(roles, "actor", "left").withColumn("editor", F.coalesce("editor", F.lit(False)))


query("review_candidate", twin(f"WITH {STAGED}, {REVIEWED} SELECT decision_id, candidate_id, actor, refused IS NULL AS accepted, coalesce(refused, 'review:' || prior || '->' || decision) AS entry, CASE WHEN refused IS NULL THEN decision ELSE prior END AS state FROM replayed"))(
    lambda s, d: op.review(staged(s, d), decisions_asked(s, d))
)
OUTCOME = "CASE CAST(id % 6 AS INTEGER) WHEN 0 THEN 'keep_canonical' WHEN 1 THEN 'accept_source_value' WHEN 2 THEN 'keep_both' WHEN 3 THEN 'reject_source' WHEN 4 THEN 'defer' ELSE 'unheard_of' END"
query("resolve_conflict", twin(f"""WITH {DECISIONS}, asked AS (SELECT decision_id, 1 + candidate_id % 400 AS conflict_id, {OUTCOME.replace('id % 6', 'decision_id % 6')} AS outcome, moment FROM told WHERE editor),
    last AS (SELECT conflict_id, arg_max(outcome, (moment, decision_id)) AS outcome, count(*) AS n FROM asked WHERE outcome <> 'unheard_of' GROUP BY 1)
    SELECT t.id, t.start_year AS existing_value, t.end_year AS incoming_value, outcome AS resolution, coalesce(n, 0) AS times, CASE WHEN outcome = 'accept_source_value' THEN t.end_year ELSE t.start_year END AS shown, CASE WHEN outcome IS NULL OR outcome = 'defer' THEN 'needs_review' ELSE 'approved' END AS state
    FROM v_temporal t LEFT JOIN last ON conflict_id = t.id WHERE t.status <> 'approved'"""))(
    lambda s, d: op.resolve(
        view(s, d, "v_temporal").filter("status <> 'approved'").select("id", c("start_year").alias("existing_value"), c("end_year").alias("incoming_value")),
        decisions_asked(s, d).select(c("decision_id").alias("resolution_id"), (1 + c("candidate_id") % 400).alias("conflict_id"), F.expr(OUTCOME.replace("id % 6", "decision_id % 6")).alias("outcome"), "editor", "moment"),
    )
)
query("change_role", twin("""WITH asked AS (SELECT a.id AS change_id, a.id % 700 AS actor_id, a.target_id AS user_id, CASE WHEN a.id % 7 = 0 THEN 'owner' ELSE 'editor' END AS role FROM v_audit a),
    told AS (SELECT x.*, u.role AS was, CASE WHEN u.role IS NULL THEN 'refused: no such user' WHEN x.actor_id = x.user_id THEN 'refused: own role' WHEN coalesce(a.role, '') <> 'admin' THEN 'refused: not an administrator' WHEN x.role = 'owner' THEN 'refused: no such role' ELSE 'changed' END AS verdict
    FROM asked x LEFT JOIN v_profiles a ON a.user_id = x.actor_id LEFT JOIN v_profiles u ON u.user_id = x.user_id) SELECT change_id, user_id, verdict, CASE WHEN verdict = 'changed' THEN role ELSE was END AS role FROM told"""))(
    lambda s, d: op.change_roles(view(s, d, "v_profiles"), view(s, d, "v_audit").select(c("id").alias("change_id"), (c("id") % 700).alias("actor_id"), c("target_id").alias("user_id"), F.when(c("id") % 7 == 0, "owner").otherwise("editor").alias("role")))
)
#: Changes among a few users, who make and unmake administrators.
ASKED = """asked AS (SELECT id AS change_id, id * 31 % 97 AS actor_id, target_id AS user_id, CASE id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'user' WHEN 2 THEN 'owner' ELSE 'editor' END AS role, row_number() OVER (ORDER BY id) AS i FROM v_audit)"""
#: The walk carries the administrators as a list, change by change.
REPLAYED = twin(f"""WITH {ASKED}, ok AS MATERIALIZED (SELECT x.*, u.role AS was, u.user_id IS NOT NULL AS known FROM asked x LEFT JOIN v_profiles u ON u.user_id = x.user_id),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, (SELECT list(CAST(user_id AS BIGINT)) FROM v_profiles WHERE role = 'admin' AND user_id < 100) AS admins, false AS granted
    UNION ALL SELECT o.i, CASE WHEN NOT (known AND actor_id <> user_id AND list_contains(admins, actor_id) AND o.role <> 'owner') THEN admins WHEN o.role = 'admin' THEN list_append(list_filter(admins, lambda a: a <> user_id), user_id)
        ELSE list_filter(admins, lambda a: a <> user_id) END, list_contains(admins, actor_id) FROM walk w JOIN ok o ON o.i = w.i + 1),
    told AS (SELECT o.*, CASE WHEN NOT known THEN 'refused: no such user' WHEN actor_id = user_id THEN 'refused: own role' WHEN NOT granted THEN 'refused: not an administrator' WHEN role = 'owner' THEN 'refused: no such role' ELSE 'changed' END AS verdict FROM ok o JOIN walk USING (i))
    SELECT change_id, user_id, verdict, coalesce(last_value(CASE WHEN verdict = 'changed' THEN role END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), was) AS role FROM told""").replace("WITH ", "WITH RECURSIVE ", 1)
query("role_replay", REPLAYED)(
    lambda s, d: op.replay_roles(view(s, d, "v_profiles"), view(s, d, "v_audit").select(c("id").alias("change_id"), (c("id") * 31 % 97).alias("actor_id"), c("target_id").alias("user_id"), F.when(c("id") % 5 == 0, "admin").when(c("id") % 5 == 1, "user").when(c("id") % 5 == 2, "owner").otherwise("editor").alias("role")))
)
BADGES = (("first-steps", 1, None), ("explorer", 20, None), ("castles", 3, "castle"), ("churches", 4, "church"))
query("badge_criteria", twin("""WITH visits AS (SELECT a.target_id AS user_id, p.id AS place_id, p.place_type FROM v_audit a JOIN v_places p ON p.id = a.id % 400 WHERE a.action = 'view'),
    rules AS (SELECT * FROM (VALUES ('first-steps', 1, NULL), ('explorer', 20, NULL), ('castles', 3, 'castle'), ('churches', 4, 'church')) AS t(badge_id, place_count, kind))
    SELECT user_id, badge_id FROM visits, rules WHERE kind IS NULL OR kind = place_type GROUP BY 1, 2, place_count HAVING count(DISTINCT place_id) >= place_count"""))(
    lambda s, d: op.badges_earned(
        view(s, d, "v_audit").filter("action = 'view'").select(c("target_id").alias("user_id"), (c("id") % 400).alias("place_id")).join(view(s, d, "v_places").select(c("id").alias("place_id"), "place_type"), "place_id"),
        F.broadcast(s.createDataFrame([(a, n, k) for a, n, k in BADGES], "badge_id string, place_count int, place_type string")),
    )
)
query("user_writes", twin("SELECT user_id, place_id, max(moment) AS moment, count(*) AS times FROM (SELECT target_id AS user_id, id % 300 AS place_id, moment FROM v_audit WHERE action IN ('signup', 'click')) GROUP BY 1, 2"))(lambda s, d: wishlist(s, d))


def wishlist(spark, d):
    """A wishlist after two rounds of writes: a wish that is there already is renewed, and its visits are counted."""
    writes = view(spark, d, "v_audit").filter("action IN ('signup', 'click')").select(c("target_id").alias("user_id"), (c("id") % 300).alias("place_id"), "moment", "action")
    key = ["user_id", "place_id"]
    first = writes.filter("action = 'signup'").groupBy(*key).agg(F.max("moment").alias("moment"), F.count(F.lit(1)).alias("times"))
    again = writes.filter("action = 'click'").groupBy(*key).agg(F.max("moment").alias("moment"), F.count(F.lit(1)).alias("times"))
    known = again.join(first.select(*key, c("moment").alias("m"), c("times").alias("n")), key, "left")
    return op.upsert(first, known.select(*key, F.greatest("moment", "m").alias("moment"), (c("times") + F.coalesce("n", F.lit(0))).alias("times")), key)


query("review_queue", twin(f"SELECT k.id, p.name AS matched_name, coalesce(x.n, 0) AS unresolved, round({distance_sql('k.lng', 'k.lat', 'p.lng', 'p.lat')}, 3) AS metres FROM v_candidates k LEFT JOIN (SELECT * FROM v_places WHERE status = 'approved') p ON p.qid = k.qid LEFT JOIN (SELECT place_id, count(*) AS n FROM v_temporal WHERE status <> 'approved' GROUP BY 1) x ON x.place_id = k.id ORDER BY unresolved DESC, k.id LIMIT 200"))(
    lambda s, d: _queue(s, d)
)


def _queue(spark, d):
    p = view(spark, d, "v_places").filter("status = 'approved' AND qid IS NOT NULL").select("qid", c("name").alias("matched_name"), c("lng").alias("x"), c("lat").alias("y"))
    k = view(spark, d, "v_candidates").join(p, "qid", "left")
    open_ = view(spark, d, "v_temporal").filter("status <> 'approved'").groupBy(c("place_id").alias("id")).agg(F.count(F.lit(1)).alias("unresolved"))
    k = k.join(open_, "id", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(0)))
    return k.orderBy(F.desc("unresolved"), "id").limit(200).select("id", "matched_name", "unresolved", F.round(geo.haversine_m(c("lng"), c("lat"), c("x"), c("y")), 3).alias("metres"))


query("decision_history", twin("SELECT a.id, a.action, p.role FROM v_audit a JOIN v_profiles p ON p.user_id = a.target_id WHERE a.action IN ('purchase', 'signup') ORDER BY a.moment DESC, a.id LIMIT 500"))(
    lambda s, d: view(s, d, "v_audit").filter("action IN ('purchase', 'signup')").join(view(s, d, "v_profiles"), c("target_id") == c("user_id")).orderBy(F.desc("moment"), "id").limit(500).select("id", "action", "role")
)
query("polymorphic_integrity", twin("SELECT id, 'object' AS side, 'person' AS kind FROM v_edges WHERE object_type = 'person' AND object_id NOT IN (SELECT id FROM v_people) UNION ALL SELECT id, 'subject', 'person' FROM v_edges WHERE subject_type = 'person' AND subject_id NOT IN (SELECT id FROM v_people) UNION ALL SELECT id, 'subject', 'place' FROM v_edges WHERE subject_type = 'place' AND subject_id NOT IN (SELECT id FROM v_places) UNION ALL SELECT id, 'object', 'place' FROM v_edges WHERE object_type = 'place' AND object_id NOT IN (SELECT id FROM v_places)"))(
    lambda s, d: op.missing_ends(view(s, d, "v_edges"), {"place": view(s, d, "v_places"), "person": view(s, d, "v_people")})
)
#: Which kinds each predicate may join.
ALLOWED = (("built_by", "place", "person"), ("owned_by", "place", "person"), ("associated_with", "place", "person"), ("associated_with", "person", "place"))
query("relationship_type_check", twin("SELECT id, predicate FROM v_edges WHERE NOT ((subject_type = 'place' AND object_type = 'person') OR (predicate = 'associated_with' AND subject_type = 'person' AND object_type = 'place'))"))(
    lambda s, d: view(s, d, "v_edges").join(F.broadcast(s.createDataFrame(ALLOWED, "predicate string, subject_type string, object_type string")), ["predicate", "subject_type", "object_type"], "left_anti").select("id", "predicate")
)
query("publishable_hint", twin(f"WITH {STAGED} SELECT id, NOT published AND {GATE} = 'published' AS publishable FROM staged"))(
    lambda s, d: staged(s, d).select("id", (~c("published") & (op.gate(None) == "published")).alias("publishable"))
)

# sources -----------------------------------------------------------------------------------------------------------

LAYERS = (("castle", "listed_building", "ListDate"), ("church", "listed_building", "ListDate"), ("monument", "scheduled_monument", "SchedDate"), ("industrial_site", "conservation_area", "DesigDate"))
query("src_layer_registry", twin("SELECT p.id, x.designation, x.date_field FROM v_places p JOIN (VALUES " + ", ".join(str(x) for x in LAYERS) + ") AS x(layer, designation, date_field) ON x.layer = p.place_type"))(
    lambda s, d: view(s, d, "v_places").select("id", c("place_type").alias("layer")).join(F.broadcast(s.createDataFrame(LAYERS, "layer string, designation string, date_field string")), "layer").select("id", "designation", "date_field")
)


@query("src_sparql_collapse", twin("SELECT entity_id, arg_min(value, (ordinal, source_id, value)) AS first_value, arg_max(source_id, (ordinal, source_id, value)) AS last_source, string_agg(DISTINCT predicate, '|' ORDER BY predicate) AS predicates FROM v_claims GROUP BY 1"))
def src_sparql_collapse(spark, d):
    """One item for each entity: the first value, the last source and the set of predicates of its bindings."""
    order = F.struct("ordinal", "source_id", "value")
    items = view(spark, d, "v_claims").groupBy("entity_id").agg(F.min_by("value", order).alias("first_value"), F.max_by("source_id", order).alias("last_source"), F.collect_set("predicate").alias("p"))
    return items.select("entity_id", "first_value", "last_source", F.array_join(F.array_sort("p"), "|").alias("predicates"))


@query("checksum_manifest", twin(digest_sql("slug", "chr(10)")))
def checksum_manifest(spark, d):
    """Digest of the slugs of each type's places in order, and how many there are."""
    places = view(spark, d, "v_places")
    return ordered_digest(places, ["place_type"], ["id"], c("slug")).join(places.groupBy("place_type").agg(F.count(F.lit(1)).alias("n")), "place_type")


@query("tier_multiset_prefix", twin("SELECT id, target_id FROM (SELECT id, target_id, row_number() OVER (PARTITION BY target_id ORDER BY id) AS k FROM v_audit) a JOIN (SELECT target_id AS t, count(*) AS need FROM v_audit WHERE id < 3000 GROUP BY 1) m ON m.t = a.target_id WHERE k <= need"))
def tier_multiset_prefix(spark, d):
    """Rows of the keys of a manifest's first entries, each key as often as the entries repeat it."""
    audit = view(spark, d, "v_audit").select("id", "target_id")
    need = audit.filter("id < 3000").groupBy(c("target_id").alias("t")).agg(F.count(F.lit(1)).alias("need"))
    numbered = audit.withColumn("k", F.row_number().over(Window.partitionBy("target_id").orderBy("id")))
    return numbered.join(need, c("target_id") == c("t")).filter("k <= need").select("id", "target_id")


def register_layers(spark, path: str, lines: bool = False):
    """Features of register layer files (a document each, or one a line): one row each, those without a whole-number entry or a name left out."""
    from ..sources.remote import register_entries

    schema = "layers array<struct<layerId int, layerName string, features array<struct<attributes map<string, string>>>>>"
    layers = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("layers").alias("l"))
    rows = layers.select(c("l.layerId").alias("layer"), F.explode("l.features.attributes").alias("a")).select("layer", F.to_json("a").alias("attributes"))
    return register_entries(rows)


@query("src_nhle_layers", twin("SELECT CASE WHEN id % 2 = 0 THEN 0 ELSE 6 END AS layer, id AS entry, name FROM v_names WHERE id % 5 <> 0"))
def src_nhle_layers(spark, d):
    """The reader on layer files: the names are written as a register's layers and read again, those of a bad entry left out."""
    from ..operators.checkpoints import shared_folder

    entry = F.when(c("id") % 5 == 0, F.concat(F.lit("x"), "id")).otherwise(c("id").cast("string"))
    features = view(spark, d, "v_names").groupBy((c("id") % 2).alias("odd"), F.floor(c("id") / 1000)).agg(F.collect_list(F.struct(F.struct(entry.alias("ListEntry"), c("name").alias("Name")).alias("attributes"))).alias("features"))
    layer = F.struct(F.when(c("odd") == 0, 0).otherwise(6).alias("layerId"), F.lit("entries").alias("layerName"), "features")
    path = f"{shared_folder(spark)}/cairn-layers-{uuid.uuid4().hex}"
    features.select(F.to_json(F.struct(F.array(layer).alias("layers")))).write.text(path)
    return register_layers(spark, path, lines=True).select("layer", "entry", "name")


@query("src_contract", twin("""SELECT 'events' AS source, count(*) AS records, CAST(0 AS BIGINT) AS in_box FROM events UNION ALL SELECT 'orders', count(*), 0 FROM orders
    UNION ALL SELECT 'customers', count(*), count(*) FILTER (WHERE lng BETWEEN -2e0 AND -1e0 AND lat BETWEEN 53.5e0 AND 54e0) FROM v_places"""))
def src_contract(spark, d):
    """The registered sources, each with its rows read through the common contract, and those in a box."""
    from ..sources import SOURCES

    out = None
    for name, reader in SOURCES.items():
        count = lambda options, n: reader(spark, {"dir": d} | options).agg(F.count(F.lit(1)).alias(n))  # noqa: B023, E731
        part = count({}, "records").crossJoin(count({"box": (-2.0, 53.5, -1.0, 54.0)}, "in_box")).select(F.lit(name).alias("source"), "records", "in_box")
        out = part if out is None else out.unionByName(part)
    return out


@query("normalise_nhle")
def normalise_nhle(spark, d):
    """Register rows as candidates with their warnings, or the reason they are rejected."""
    from ..functions import classify, text

    rows = view(spark, d, "v_grid").join(view(spark, d, "v_names").select("id", "name", "designation"), "id")
    w = geo.osgb36_to_wgs84(geo.grid_to_osgb36(c("easting"), c("northing")))
    kind = classify.place_type(c("name"), c("designation"))
    rows = rows.withColumns({"w": w, "kind": kind, "tidy": text.tidy_name(c("name"))})
    return rows.select("id", "tidy", "kind.kind", "kind.confidence", "w.lng", "w.lat", F.when(c("w").isNull(), "position outside the grid").alias("rejected"), F.array_join(text.alternative_names(c("name"), c("tidy")), "|").alias("alternatives"))


#: Class labels and designation labels of the items, by id.
ITEM_CLASSES = ("castle", "Church building ", "tea room", "railway station", "mill")
ITEM_LABELS = ("Grade I listed building", "listed building", "locally listed", "Registered battlefield")
ITEMS = f"""items AS (SELECT id, qid, CASE id % 5 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ITEM_CLASSES))} END AS c1, CASE (id + 3) % 5 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ITEM_CLASSES))} END AS c2,
    CASE id % 4 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ITEM_LABELS))} END AS d1, CASE id % 8 WHEN 0 THEN 'listed building' END AS d2, CASE WHEN id % 18 = 0 THEN NULL WHEN id % 42 = 0 THEN 95e0 ELSE lat END AS lat, lng,
    CASE WHEN id % 24 <> 0 THEN (id % 7) / 1000e0 END AS precision FROM v_candidates WHERE qid IS NOT NULL)"""
_KIND = lambda x: f"CASE lower(trim({x})) " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in items.CLASSES.items()) + " END"
_MARK = lambda x: f"CASE lower(trim({x})) " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in items.DESIGNATION_LABELS.items()) + " END"
_METRES = f"greatest(coalesce(precision * 111320e0, 25e0), 25e0)"


@query("normalise_wikidata", twin(f"""WITH {ITEMS}, told AS (SELECT *, {_KIND('c1')} AS k1, {_KIND('c2')} AS k2, {_MARK('d1')} AS m1, {_MARK('d2')} AS m2, {_METRES} AS metres FROM items)
    SELECT qid, coalesce(k1, k2, 'unknown') AS place_type, CASE WHEN coalesce(k1, k2) IS NULL THEN 0e0 ELSE 0.85e0 END AS type_confidence, coalesce('instance-of:' || lower(trim(CASE WHEN k1 IS NOT NULL THEN c1 WHEN k2 IS NOT NULL THEN c2 END)), 'unmapped') AS rule,
    round(metres, 1) AS accuracy_m, CASE WHEN metres > 250 THEN 'approximate' ELSE 'source' END AS method, concat_ws('|', m1, CASE WHEN m2 IS DISTINCT FROM m1 THEN m2 END) AS designations,
    concat_ws('|', CASE WHEN coalesce(k1, k2) IS NULL THEN 'no class is mapped' END, CASE WHEN precision IS NOT NULL AND metres > precision * 111320e0 + 1e-6 THEN 'stated precision is no measured accuracy' END) AS warnings,
    CASE WHEN lat IS NULL OR lng IS NULL THEN 'no position' WHEN abs(lat) > 90 OR abs(lng) > 180 THEN 'impossible position' END AS rejected FROM told"""))
def normalise_wikidata(spark, d):
    """Items as candidates: kind by the first mapped class, distinct designations, accuracy by stated precision, or why they are rejected."""
    of = lambda values, x: F.element_at(F.array(*map(F.lit, values)), (x + 1).cast("int"))
    k = view(spark, d, "v_candidates").filter("qid IS NOT NULL")
    raw = k.select(
        "qid", c("name").alias("label"), F.lit(None).cast("array<string>").alias("aliases"), F.when(c("id") % 18 == 0, None).when(c("id") % 42 == 0, 95.0).otherwise(c("lat")).alias("lat"), c("lng").alias("lon"),
        F.when(c("id") % 24 != 0, c("id") % 7 / 1000.0).alias("precision"), F.array(of(ITEM_CLASSES, c("id") % 5), of(ITEM_CLASSES, (c("id") + 3) % 5)).alias("instance_of"),
        F.array_compact(F.array(of(ITEM_LABELS, c("id") % 4), F.when(c("id") % 8 == 0, "listed building"))).alias("designations"), F.array(c("id").cast("string")).alias("register_ids"),
    )
    joined = [F.array_join(x, "|").alias(x) for x in ("designations", "warnings")]
    return items.normalise_items(raw).select("qid", "place_type", "type_confidence", "rule", "accuracy_m", "method", *joined, "rejected")


@query("sequential_resolution", RESOLVED)
def sequential_resolution(spark, d):
    """Records decided in order against those that became canonical before them, by the matcher's own score."""
    from ..operators.matching import resolve_in_order
    from .matching import records

    return resolve_in_order(records(spark, d, "v_candidates")).select("id", "outcome", "matched")


@query("validate_search")
def validate_search(spark, d):
    """What the search schema says to some inputs."""
    from ..operators.requests import SearchRequest

    said = []
    for wanted in ({}, {"words": "x" * 201}, {"radius_m": 0.0}, {"limit": 500}, {"offset": -1}, {"words": "hall", "radius_m": 5000.0}):
        said.append((json.dumps(wanted)[:60], "; ".join(SearchRequest(**wanted).problems()) or "ok"))
    return spark.createDataFrame(said, "input string, verdict string")
