"""Entity resolution: scores of candidate pairs, and the decision on each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, geo, names
from ..functions.text import postcode_key
from . import compared
from .blocking import identifier_pairs, near_pairs
from .checkpoints import checkpoint_folder
from .rules import CONFIDENT, CONFIDENT_NAME, CONFLICT_M, FARTHEST_M, NEAR_TIE, RADIUS_M, REVIEW, TYPED
from .spread import spread

FIELDS = ("names", "packed", "generic", "accuracy", "place_type", "asked_kin", "given_kin", "type_confidence", "postcode", "town", "source_id", "designation")


def prepared(records: DataFrame) -> DataFrame:
    """Records with all that pairs are scored on, made once a record: analysed names, the main one first, whether that is generic, and the kin of its kind.

    Records have a name and alt_names (array, may be null).
    """
    every = F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>")))
    every = F.array_compact(every)
    return spread(records, "id").withColumns({"names": F.transform(every, names.analyse), "packed": F.transform(every, names.packed), "generic": names.is_generic(F.col("name")), "asked_kin": classify.asked_kin(F.col("place_type")), "given_kin": classify.given_kin(F.col("place_type"))})


def agreement_radius(a: Column, b: Column) -> Column:
    return F.least(F.greatest(F.lit(RADIUS_M[0]), a, F.coalesce(b, F.lit(0.0))), F.lit(RADIUS_M[1]))


def distance_signal(metres: Column, radius: Column) -> Column:
    return F.when(metres <= radius, 0.45).when(metres <= 250, 0.3).when(metres <= 1000, 0.1).otherwise(-0.1)


def name_signal(score: Column, generic: Column) -> Column:
    return F.when(score >= 0.92, F.when(generic, 0.1).otherwise(0.4)).when(score >= 0.75, 0.2).when(score >= 0.55, 0.05).otherwise(-0.2)


def type_signal(ours: Column, theirs: Column, compatible: Column) -> Column:
    return F.when((ours >= TYPED) & (F.coalesce(theirs, F.lit(0.0)) >= TYPED) & compatible, 0.1).when((ours >= TYPED) & ~compatible, -0.35).otherwise(0.0)


def postcode_signal(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.0).when(postcode_key(a) == postcode_key(b), 0.2).otherwise(-0.15)


def town_signal(a: Column, b: Column) -> Column:
    return F.when(F.lower(a) == F.lower(b), 0.05).otherwise(0.0)


def same_register(source_a: Column, source_b: Column, record_a: Column, record_b: Column, kind_a: Column, kind_b: Column) -> Column:
    """Two entries of one register that share a designation: different things by the register's own account."""
    return (source_a == source_b) & (record_a != record_b) & F.coalesce(kind_a == kind_b, F.lit(False))


def pairs_of(candidates: DataFrame, places: DataFrame, metres: float = FARTHEST_M) -> DataFrame:
    """Near pairs of prepared records, with both sides' fields as l_ and r_ columns."""
    return near_pairs(candidates, places, metres, keep=FIELDS)


def identifier_keys(external: Column | None = None, references: Column | None = None, **schemes: Column) -> Column:
    """What a record can be found by: its external identifiers, an array of (scheme, value); its designations' references,
    which any register may have given; and single columns of one scheme. Empty and null ones are left out, each is once."""
    found = [F.array(F.concat(F.lit(f"ext:{k}:"), F.nullif(F.trim(x.cast("string")), F.lit("")))) for k, x in schemes.items()]
    if external is not None:
        found.append(F.transform(external, lambda x: F.concat(F.lit("ext:"), x["scheme"], F.lit(":"), F.nullif(F.trim(x["value"]), F.lit("")))))
    if references is not None:
        found.append(F.transform(references, lambda x: F.concat(F.lit("ref:"), F.nullif(F.trim(x), F.lit("")))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, none) for x in found]))) if found else none


def keyed(records: DataFrame) -> DataFrame:
    """(id, keys) of records: their own keys, or those of their qid where they have no such column."""
    return records.select("id", "keys" if "keys" in records.columns else identifier_keys(qid=F.col("qid")).alias("keys"))


def shared_identifiers(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """(l, r) of pairs that share an identifier of any scheme or a designation's reference, at any distance."""
    return identifier_pairs(keyed(candidates), keyed(places))


def shortlisted(candidates: DataFrame, places: DataFrame, metres: float = FARTHEST_M) -> DataFrame:
    """(l, r) of pairs that are near or share an identifier, each once.

    Near pairs are distinct, and so are those that share an identifier; of these only the ones that aren't near are
    added, so the near pairs, which are far more, are never dealt again to find repeats.
    """
    point = lambda df, side: df.select(F.col("id").alias(side), F.struct("lng", "lat").alias(f"{side}p")).hint("merge")
    told = shared_identifiers(candidates, places).join(point(candidates, "l"), "l").join(point(places, "r"), "r")
    apart = geo.haversine_m(F.col("lp.lng"), F.col("lp.lat"), F.col("rp.lng"), F.col("rp.lat"))
    far = told.filter(~F.coalesce(apart <= metres, F.lit(False)))
    return compared.compared(candidates, places, metres, ()).unionByName(far.select("l", "r"))


def identified_pairs(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of prepared records that share an identifier, with both sides' fields and their distance."""
    kept = ("id", "lng", "lat", *FIELDS)
    a = candidates.select(*[F.col(k).alias("l" if k == "id" else f"l_{k}") for k in kept])
    b = places.select(*[F.col(k).alias("r" if k == "id" else f"r_{k}") for k in kept])
    pairs = shared_identifiers(candidates, places).join(a.hint("merge"), "l").join(b.hint("merge"), "r")  # files of few bytes hold many rows
    metres = geo.haversine_m(F.col("l_lng"), F.col("l_lat"), F.col("r_lng"), F.col("r_lat"))
    return pairs.withColumn("metres", metres).drop("l_lng", "l_lat", "r_lng", "r_lat")


def vetoes(pairs: DataFrame) -> DataFrame:
    """pairs with what forbids a match, and the fields on which one would disagree."""
    c = F.col
    return pairs.withColumns({
        "name_veto": names.all_pairs_distinct(c("l_names"), c("r_names")),
        "register_veto": same_register(c("l_source_id"), c("r_source_id"), c("l"), c("r"), c("l_designation"), c("r_designation")),
        "compatible": classify.kinds_fit(c("l_place_type"), c("r_place_type"), c("l_asked_kin"), c("r_given_kin")),
    }).withColumn("conflicts", conflicts(c("l_type_confidence"), c("compatible"), c("metres"), c("l_postcode"), c("r_postcode")))


def signals(pairs: DataFrame) -> DataFrame:
    """pairs with every signal, the vetoes, and the score: signals added in order, kept within 0 and 1."""
    c = F.col
    named = names.with_best_similarity(vetoes(pairs), "l_names", "r_names").withColumns({
        "generic": c("l_generic") & c("r_generic"),
        "radius": agreement_radius(c("l_accuracy"), c("r_accuracy")),
        "area": classify.is_area(c("l_designation")) != classify.is_area(c("r_designation")),
    })
    named = named.withColumns({
        "s_distance": distance_signal(c("metres"), c("radius")), "s_name": name_signal(c("sim.score"), c("generic")),
        "s_type": type_signal(c("l_type_confidence"), c("r_type_confidence"), c("compatible")),
        "s_postcode": postcode_signal(c("l_postcode"), c("r_postcode")), "s_town": town_signal(c("l_town"), c("r_town")),
    })
    total = c("s_distance") + c("s_name") + c("s_type") + c("s_postcode") + c("s_town")
    return named.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).drop("l_names", "r_names")


def conflicts(confidence: Column, compatible: Column, metres: Column, postcode_a: Column, postcode_b: Column) -> Column:
    """Fields on which a match would disagree: one of the eight lists there are, looked up by what was found."""
    found = {"place_type": (confidence >= TYPED) & ~compatible, "location": metres > CONFLICT_M, "postcode": postcode_a != postcode_b}
    return conflicts_of(sum((F.when(x, 2**i).otherwise(0) for i, x in enumerate(found.values())), F.lit(0)))


def conflicts_of(found: Column) -> Column:
    """The list of conflicts that has this number: a bit for each field, the first the least."""
    fields = ("place_type", "location", "postcode")
    return F.get(F.array(*[F.array(*[F.lit(k) for i, k in enumerate(fields) if n >> i & 1]).cast("array<string>") for n in range(2 ** len(fields))]), found)


def identified(pairs: DataFrame) -> DataFrame:
    """(l, said) of candidates that share an identifier with a place: what the first such place by id says.

    Names that denote different things send it to review, other disagreements to conflict review; else it is a match.
    """
    c = F.col
    outcome = F.when(c("name_veto"), "MATCH_REVIEW").when(F.size("conflicts") > 0, "CONFLICT_REVIEW").otherwise("MATCH_CONFIDENT")
    said = F.struct(outcome.alias("outcome"), c("r").alias("matched"), F.when(c("name_veto"), 0.5).otherwise(1.0).alias("confidence"))
    return vetoes(pairs).filter(~c("register_veto")).groupBy("l").agg(F.min_by(said, "r").alias("said"))


def tallied(scored: DataFrame) -> DataFrame:
    """(l, r, score, odd, sure, n) of scored pairs: each that no veto removes and that scores REVIEW or more, and one row
    of each candidate for all its others, with r null, the best score that no veto removes, and how many they are.

    Below REVIEW the best score is all that decisions ask for, so pairs are counted where they are made and never sorted.
    ``odd``: the sides disagree; ``sure``: all that a confident match asks for but the score and the runner-up; both are
    null for the row of the others.
    """
    c = F.col
    kept = ~c("name_veto") & ~c("register_veto") & (c("metres") <= FARTHEST_M)
    sure = (c("sim.score") >= CONFIDENT_NAME) & ~c("generic") & ~c("area") & ~c("sim.carried") & (c("metres") <= c("radius"))
    pairs = scored.select("l", "r", F.when(kept, c("score")).alias("score"), (F.size("conflicts") > 0).alias("odd"), sure.alias("sure"))
    high = c("score") >= REVIEW
    return pairs.groupBy("l", F.when(high, c("r")).alias("r")).agg(
        F.max("score").alias("score"), F.bool_or(F.when(high, c("odd"))).alias("odd"), F.bool_or(F.when(high, c("sure"))).alias("sure"), F.count(F.lit(1)).alias("n")
    )


def decisions(candidates: DataFrame, scored: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, outcome, matched, confidence) of each candidate, from all its scored pairs; see decided()."""
    return decided(candidates, tallied(scored), shared)


def decided(candidates: DataFrame, tallies: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, outcome, matched, confidence) of each candidate.

    A shared identifier decides first, at any distance. Else the best of the scored pairs that no veto removes, of
    equals the first place; a runner-up within NEAR_TIE, a conflict or a failed gate sends the candidate to review.
    """
    order = Window.partitionBy("l").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("r"))
    ranked = tallies.filter("score IS NOT NULL").withColumn("k", F.row_number().over(order)).filter("k <= 2")
    best = ranked.groupBy("l").agg(F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"), F.max_by(F.struct("r", "score", "odd", "sure"), -F.col("k")).alias("b"))
    b, tie = F.col("b"), F.col("second").isNotNull() & (F.col("b.score") - F.col("second") < NEAR_TIE)
    gates = (b["score"] >= CONFIDENT) & b["sure"] & ~tie
    outcome = F.when(b["score"].isNull() | (b["score"] < REVIEW), "NEW_CANONICAL").when(b["odd"], "CONFLICT_REVIEW").when(gates, "MATCH_CONFIDENT").otherwise("MATCH_REVIEW")
    by_id = identified(shared).withColumnRenamed("l", "s")
    out = candidates.select("id").join(best, F.col("id") == F.col("l"), "left").join(by_id, F.col("id") == F.col("s"), "left").withColumn("scored", outcome)
    said = F.col("said")
    return out.select(
        "id", F.coalesce(said["outcome"], "scored").alias("outcome"), F.coalesce(said["matched"], F.when(F.col("scored") != "NEW_CANONICAL", b["r"])).alias("matched"),
        F.coalesce(said["confidence"], b["score"], F.lit(0.0)).alias("confidence"),
    )


def not_canonical(links: DataFrame) -> tuple[DataFrame, int]:
    """(ids, rounds): records that an earlier canonical one holds back, of (l, r) links to earlier records.

    A record is canonical if none of its earlier linked ones is. Each round takes the records without an earlier one
    left as canonical, at once drops all that are linked to them, and goes on with the links among the rest: a clique
    ends in one round, whatever its size, and a decided record is not written again. Rounds end with a checkpoint.
    """
    checkpoint_folder(links.sparkSession)
    left = links.select("l", "r").distinct().checkpoint()
    gone: DataFrame = left.select(F.col("l").alias("id")).limit(0)
    rounds = 0
    while not left.isEmpty():
        first = left.select("r").distinct().join(left.select(F.col("l").alias("r")), "r", "left_anti")
        out = left.join(first, "r", "left_semi").select(F.col("l").alias("id")).distinct().checkpoint()
        left = left.join(out.withColumnRenamed("id", "l"), "l", "left_anti").join(out.withColumnRenamed("id", "r"), "r", "left_anti").checkpoint()
        gone, rounds = gone.unionByName(out), rounds + 1
    return gone, rounds


def resolve(rows: DataFrame, near: DataFrame | None = None, identified: DataFrame | None = None) -> DataFrame:
    """(id, outcome, matched, confidence) of prepared records decided in order of id, each against those that became
    canonical before it: earlier ones among rows, and the canonical records of earlier runs that are near or share an
    identifier with one of rows, if these are given.

    A record is held back by an earlier canonical one that it scores REVIEW or more with, or shares an identifier with;
    that settles which are canonical. Then all are decided together by their pairs with canonical ones.
    """
    checkpoint_folder(rows.sparkSession)
    least = REVIEW - NEAR_TIE - 1e-9  # a runner-up below that is no tie of one that scores REVIEW
    scored, told = compared.judged(rows, rows, FARTHEST_M, least, earlier=True), identified_pairs(rows, rows).filter(F.col("r") < F.col("l"))
    if near is not None:
        scored = scored.unionByName(compared.judged(rows, near, FARTHEST_M, least))
    if identified is not None:
        told = told.unionByName(identified_pairs(rows, identified))
    scored = scored.checkpoint()
    shared = vetoes(told).filter(~F.col("register_veto")).checkpoint()
    strong = scored.filter(F.col("score") >= REVIEW).select("l", "r").union(shared.select("l", "r"))
    gone, _ = not_canonical(strong)
    gone = gone.withColumnRenamed("id", "r").checkpoint()
    of_canonical = lambda df: df.join(gone, "r", "left_anti")
    return decided(rows, of_canonical(scored), of_canonical(shared))


def resolve_in_order(rows: DataFrame) -> DataFrame:
    """(id, outcome, matched, confidence) of prepared records, all in one run; see resolve()."""
    return resolve(rows)
