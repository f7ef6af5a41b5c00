"""Publication of staged candidates into claim tables: set-based and idempotent.

Every function takes the current table and the staged rows and returns the next version; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpoint_folder
from .ranks import cumulated


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The old table with the new rows in; a key that both have takes the new row, but for the columns in ``keep``.

    Of new rows with one key the last in order counts. Null keys are equal to each other. Rows travel as one column, so
    their columns may have any names.
    """
    row = F.struct(*old.columns)
    keys = lambda p: [F.col(k).alias(f"{p}{i}") for i, k in enumerate(key)]
    names = lambda p: [f"{p}{i}" for i in range(len(key))]
    a = old.select(*keys("a"), row.alias("old"))
    b = new.select(*keys("b"), row.alias("new"), *([F.col(order).alias("at")] if order else []))
    if order:
        b = b.groupBy(*names("b")).agg(F.max_by("new", F.struct("at")).alias("new"))
    both = a.join(b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(names("a"), names("b"), strict=True)], "full")

    def value(c: str) -> Column:
        first, second = ("old", "new") if c in keep else ("new", "old")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.`{c}`")).otherwise(F.col(f"{second}.`{c}`")).alias(c)

    return both.select(*[value(c) for c in old.columns])


def replayed(once: DataFrame, again: DataFrame) -> DataFrame:
    """(n, changed): rows of a table, and how many rows of it and of what a second run made of it the other lacks.

    Repeats count. One aggregate compares the two, by how often each has a row.
    """
    names = [f"__{i}" for i in range(len(once.columns))]
    side = lambda df, sign: df.select(once.columns).toDF(*names).withColumn("__sign", F.lit(sign))
    rows = side(once, 1).unionByName(side(again, -1)).groupBy(*names).agg(F.sum("__sign").alias("more"), F.count_if(F.col("__sign") > 0).alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.abs("more")), F.lit(0)).alias("changed"))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old table and the new rows whose key it lacks."""
    lacking = new.select(*old.columns).join(old.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct(), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left_anti")
    return old.unionByName(lacking)


def gate(staged: DataFrame) -> Column:
    """Why a staged row isn't published, the first reason; published if none. Needs state, unresolved, source_id, published, matched and target."""
    c = F.col
    return (
        F.when(c("published"), "already_published").when(c("state") != "approved", "refused: not approved").when(c("unresolved") > 0, "refused: unresolved conflict")
        .when(c("source_id").isNull(), "refused: no provenance").when(c("matched").isNotNull() & c("target").isNull(), "refused: match target missing").otherwise("published")
    )


def first_preferred(facts: DataFrame, key: list[str], order: str) -> DataFrame:
    """facts with is_preferred on the first claim of each key."""
    return facts.withColumn("is_preferred", F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1)


def preferred_after(facts: DataFrame, key: list[str], promoted: str, single: Column) -> DataFrame:
    """facts with is_preferred after promotions, replayed by their order: in a single-valued predicate the last one stands."""
    last = F.max(promoted).over(Window.partitionBy(*key))
    stands = F.when(single, F.coalesce(F.col(promoted) == last, F.lit(False)) | (last.isNull() & F.col("is_preferred"))).otherwise(F.col(promoted).isNotNull() | F.col("is_preferred"))
    return facts.withColumn("is_preferred", stands)


def resolve_people(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """mentions with person_id: by source and external id, else by slug, else a new id from the slug; and how it was found."""
    by_id = people.select(F.col("external_id").alias("x"), F.col("id").alias("by_id")).filter("x IS NOT NULL")
    by_slug = people.groupBy(F.col("slug").alias("g")).agg(F.min("id").alias("by_slug"))
    joined = mentions.join(by_id, F.col("external_id") == F.col("x"), "left").join(by_slug, F.col("slug") == F.col("g"), "left")
    made = F.concat(F.lit("person:"), F.sha2(F.col("slug"), 256).substr(1, 12))
    how = F.when(F.col("by_id").isNotNull(), "external id").when(F.col("by_slug").isNotNull(), "slug").otherwise("created")
    return joined.select(*mentions.columns, F.coalesce(F.col("by_id").cast("string"), F.col("by_slug").cast("string"), made).alias("person_id"), how.alias("found_by"))


def missing_ends(edges: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """(id, side, kind) of edges that point at an entity that doesn't exist."""
    out = None
    for side in ("subject", "object"):
        for kind, table in entities.items():
            odd = edges.filter(F.col(f"{side}_type") == kind).join(table.select(F.col("id").alias(f"{side}_id")), f"{side}_id", "left_anti").select("id", F.lit(side).alias("side"), F.lit(kind).alias("kind"))
            out = odd if out is None else out.unionByName(odd)
    return out


REVIEWABLE = ("approved", "rejected", "needs_review")


def review(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(decision_id, candidate_id, actor, accepted, entry, state): the audit row of each decision, replayed in order.

    Candidates have id, state and published; decisions have decision_id, candidate_id, decision, actor, editor and
    moment. A decision is refused if its actor is no editor, if it names a state that reviewers can't choose, if there
    is no such candidate, or if that is published. An accepted one records the state before and after it; ``state`` is
    the candidate's state then.
    """
    c = F.col
    known = candidates.select(c("id").alias("candidate_id"), c("state").alias("first"), "published")
    told = decisions.join(known, "candidate_id", "left")
    refused = (
        F.when(~c("editor"), "refused: not an editor").when(~c("decision").isin(*REVIEWABLE), "refused: not a reviewer's decision")
        .when(c("first").isNull(), "refused: no such candidate").when(c("published"), "refused: already published")
    )
    told = told.withColumn("refused", refused)
    earlier = Window.partitionBy("candidate_id").orderBy("moment", "decision_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(c("refused").isNull(), c("decision")), ignorenulls=True).over(earlier), c("first"))
    told = told.withColumn("before", before)
    entry = F.coalesce("refused", F.concat(F.lit("review:"), "before", F.lit("->"), "decision"))
    return told.select("decision_id", "candidate_id", "actor", c("refused").isNull().alias("accepted"), entry.alias("entry"), F.when(c("refused").isNull(), c("decision")).otherwise(c("before")).alias("state"))


def reviewed(candidates: DataFrame, audit: DataFrame) -> DataFrame:
    """candidates with the state that the last accepted decision gave them."""
    last = audit.filter("accepted").groupBy(F.col("candidate_id").alias("__candidate")).agg(F.max_by("state", "decision_id").alias("__state"))
    out = candidates.join(last, F.col("id") == F.col("__candidate"), "left")
    return out.withColumn("state", F.coalesce("__state", "state")).drop("__candidate", "__state")


OUTCOMES = ("keep_canonical", "accept_source_value", "keep_both", "reject_source", "defer")


def resolve(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """conflicts with what the last valid resolution made of them; both original values stay.

    Conflicts have id, existing_value and incoming_value; resolutions have resolution_id, conflict_id, outcome, editor
    and moment. One whose actor is no editor, or with an outcome that there isn't, changes nothing. The shown value is
    the incoming one if it was accepted, else the existing one; a conflict is open while unresolved or deferred.
    """
    c = F.col
    valid = resolutions.filter(c("editor") & c("outcome").isin(*OUTCOMES))
    last = valid.groupBy(c("conflict_id").alias("__conflict")).agg(F.max(F.struct("moment", "resolution_id", "outcome")).alias("__last"), F.count(F.lit(1)).alias("__n"))
    out = conflicts.join(last, c("id") == c("__conflict"), "left")
    outcome = c("__last.outcome")
    return out.select(
        *conflicts.columns, outcome.alias("resolution"), F.coalesce("__n", F.lit(0)).alias("times"),
        F.when(outcome == "accept_source_value", c("incoming_value")).otherwise(c("existing_value")).alias("shown"),
        F.when(outcome.isNull() | (outcome == "defer"), "needs_review").otherwise("approved").alias("state"),
    )


ROLES = ("user", "contributor", "editor", "moderator", "admin")


def change_roles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """(change_id, user_id, verdict, role): what becomes of asked changes of roles, each on its own.

    Profiles have user_id and role; changes have change_id, actor_id, user_id and role. Only an administrator changes
    roles, nobody changes their own, and a role must be one of ROLES; a refused change leaves the role as it is.
    """
    c = F.col
    actors = profiles.select(c("user_id").alias("actor_id"), c("role").alias("actor_role"))
    users = profiles.select("user_id", c("role").alias("now"))
    told = changes.join(actors, "actor_id", "left").join(users, "user_id", "left")
    verdict = (
        F.when(c("now").isNull(), "refused: no such user").when(c("actor_id") == c("user_id"), "refused: own role").when(F.coalesce("actor_role", F.lit("")) != "admin", "refused: not an administrator")
        .when(~c("role").isin(*ROLES), "refused: no such role").otherwise("changed")
    )
    return told.withColumn("verdict", verdict).select("change_id", "user_id", "verdict", F.when(c("verdict") == "changed", c("role")).otherwise(c("now")).alias("role"))


#: Changes of roles that are replayed in one task.
CHANGES_AT_ONCE = 100_000


def _roles_held(asks: DataFrame, steps: DataFrame) -> DataFrame:
    """asks with ``has``, the role that ``who`` has when one is made: that of their last step (user_id, at, role) before it.

    Places in the order (``at``) are cut into cells of equal size. A user's last role of each cell is carried on to the
    cells after it, a row each; inside a cell the user's asks and steps are walked in order. So a busy user's changes
    are dealt like any others, and each is read once, however many steps there are.
    """
    c = F.col
    cell = F.floor(c("at") / CHANGES_AT_ONCE)
    asks = asks.withColumns({"__cell": cell, "__step": F.lit(0), "__role": F.lit(None).cast("string")})
    steps = steps.select(c("user_id").alias("who"), "at", cell.alias("__cell"), F.lit(1).alias("__step"), c("role").alias("__role"))
    left = steps.groupBy("who", "__cell").agg(F.max_by("__role", "at").alias("__left"))
    cells = asks.groupBy("who", "__cell").agg(F.lit(None).cast("string").alias("__left")).unionByName(left).groupBy("who", "__cell").agg(F.max("__left").alias("__left"))
    carried = F.last("__left", ignorenulls=True).over(Window.partitionBy("who").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    # a cell begins with a step of what is carried into it: a union, as sizes that joins are taken to have grow in rounds
    begins = cells.select("who", (c("__cell") * CHANGES_AT_ONCE).alias("at"), "__cell", F.lit(-1).alias("__step"), carried.alias("__role"))
    walked = Window.partitionBy("who", "__cell").orderBy("at", "__step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asks.unionByName(steps, allowMissingColumns=True).unionByName(begins, allowMissingColumns=True)
    return rows.withColumn("has", F.last("__role", ignorenulls=True).over(walked)).filter("__step = 0").drop("__cell", "__step", "__role")


def replay_roles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """(change_id, user_id, verdict, role): asked changes of roles in order of change_id, each judged by the roles that the
    ones before it left.

    Verdicts are those of change_roles(); role is the user's after the change. Who is an administrator when depends on
    the accepted changes, and these on who is; so rounds start from the first roles and go on until no verdict changes.
    A round settles at least the changes whose actors' roles the round before had settled. Rounds handle only changes of
    users who act themselves, as no other's role decides a verdict; the rest is judged once, at the end.
    """
    c = F.col
    users = profiles.select("user_id", F.lit(True).alias("known"))
    told = cumulated(changes.select("change_id", "actor_id", "user_id", "role").join(users, "user_id", "left"), ["change_id"], name="at")
    refused = F.when(c("known").isNull(), "refused: no such user").when(c("actor_id") == c("user_id"), "refused: own role")
    told = told.withColumn("refused", refused).drop("known").checkpoint()
    first = profiles.select("user_id", F.lit(-1).cast("long").alias("at"), "role")
    actors = told.select(c("actor_id").alias("user_id")).distinct()
    may = told.filter(c("refused").isNull() & c("role").isin(*ROLES))
    judged = may.join(actors, "user_id", "left_semi").select("at", c("actor_id").alias("who"), "user_id", "role", F.lit(False).alias("ok"))
    start = first.join(actors, "user_id", "left_semi").checkpoint()
    while True:
        steps = start.unionByName(judged.filter("ok").select("user_id", "at", "role"))
        now = _roles_held(judged, steps).withColumn("now", F.coalesce(c("has") == "admin", F.lit(False))).checkpoint()
        judged = now.select("at", "who", "user_id", "role", c("now").alias("ok"))
        if now.filter("ok <> now").isEmpty():
            break
    heard = _roles_held(told.withColumn("who", c("actor_id")), steps)
    verdict = F.coalesce("refused", F.when(F.coalesce("has", F.lit("")) != "admin", "refused: not an administrator").when(~c("role").isin(*ROLES), "refused: no such role"), F.lit("changed"))
    heard = heard.withColumn("verdict", verdict).select("change_id", "at", c("user_id").alias("who"), "verdict", "role").checkpoint()
    out = _roles_held(heard, first.unionByName(heard.filter("verdict = 'changed'").select(c("who").alias("user_id"), "at", "role")))
    return out.select("change_id", c("who").alias("user_id"), "verdict", F.when(c("verdict") == "changed", c("role")).otherwise(c("has")).alias("role"))


def badges_earned(visits: DataFrame, criteria: DataFrame) -> DataFrame:
    """(user_id, badge_id) of users who meet a badge's criteria.

    Visits have user_id, place_id and place_type; criteria have badge_id, place_count and place_type (null: any). A
    place counts once, however often it is visited. Criteria are a registry; users meet them by counts of their kinds.
    """
    kinds = visits.groupBy("user_id", "place_type").agg(F.countDistinct("place_id").alias("n"))
    every = visits.groupBy("user_id").agg(F.countDistinct("place_id").alias("n")).select("user_id", F.lit(None).cast("string").alias("place_type"), "n")
    rules = criteria.select("badge_id", F.col("place_type").alias("kind"), "place_count")
    return kinds.unionByName(every).join(rules, F.col("place_type").eqNullSafe(F.col("kind")) & (F.col("n") >= F.col("place_count"))).select("user_id", "badge_id").distinct()
