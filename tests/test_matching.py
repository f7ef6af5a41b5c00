"""The matcher's rules on small records, and ordered resolution against a plain replay."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import classify, names, text
from cairn.operators import matching as op
from cairn.plans.matching import records

from .conftest import SMALL

SCHEMA = "id long, name string, alt_names array<string>, lng double, lat double, accuracy double, place_type string, type_confidence double, postcode string, town string, source_id long, qid string, designation string"


def record(i, name, lng=-1.5, lat=53.9, alt=None, accuracy=10.0, kind="castle", sure=0.9, postcode=None, town=None, source=1, qid=None, designation="listed_building"):
    return (i, name, alt, lng, lat, accuracy, kind, sure, postcode, town, source, qid, designation)


def decide(spark, candidates, places):
    a, b = (op.prepared(spark.createDataFrame(x, SCHEMA)) for x in (candidates, places))
    rows = op.decisions(a, op.signals(op.pairs_of(a, b)), op.identified_pairs(a, b)).collect()
    return {r.id: (r.outcome, r.matched, round(r.confidence, 6)) for r in rows}


def test_rules(spark):
    places = [
        record(100, "Skelton Castle", qid="Q1", source=2), record(101, "Fountains Hall", lng=-1.0, qid="Q2", source=2), record(102, "2, High Street", lng=-0.5, qid="Q3", source=2),
        record(103, "Church of St Mary", lng=0.0, source=2), record(104, "Whitby Abbey", lng=0.5, source=2), record(105, "Bolton Priory", lng=-2.0, source=2), record(106, "Bolton Priory", lng=-2.0001, source=2),
        record(107, "Newby Hall", lng=-2.2, source=1, designation="listed_building"), record(108, "Old Works", lng=-2.4, source=2, alt=["Elsecar Colliery"]),
    ]
    far = {"lat": 56.0}
    candidates = [
        record(1, "Skelton Castle", **far, qid="Q1"),  # the identifier decides, but 230 km are a conflict
        record(2, "Fountains Hall", lng=-1.0, qid="Q2"),
        record(3, "8, High Street", lng=-0.5, qid="Q3"),  # names denote different things
        record(4, "Church of St Mary", lng=0.0),  # generic
        record(5, "Whitby Abbey Cross", lng=0.5),  # containment
        record(6, "Bolton Priory", lng=-2.0),  # two places score alike
        record(7, "Newby Hall", lng=-2.2, source=1),  # another entry of one register
        record(8, "Elsecar Colliery", lng=-2.4),  # by an alternative name
        record(9, "Nothing near", **far),
        record(10, "Skelton Castle", lng=-1.5),  # by name and place
    ]
    got = decide(spark, candidates, places)
    assert got[1] == ("CONFLICT_REVIEW", 100, 1.0) and got[2] == ("MATCH_CONFIDENT", 101, 1.0) and got[3] == ("MATCH_REVIEW", 102, 0.5)
    assert [got[i][:2] for i in (4, 5, 6, 7, 8, 9, 10)] == [
        ("MATCH_REVIEW", 103), ("MATCH_REVIEW", 104), ("MATCH_REVIEW", 105), ("NEW_CANONICAL", None), ("MATCH_CONFIDENT", 108), ("NEW_CANONICAL", None), ("MATCH_CONFIDENT", 100),
    ]


def test_nothing_to_match(spark):
    assert decide(spark, [record(1, "Skelton Castle")], []) == {1: ("NEW_CANONICAL", None, 0.0)}
    assert decide(spark, [], [record(1, "Skelton Castle")]) == {}


@pytest.fixture(scope="module")
def rows(spark):
    """Records in three crowded places, so that decisions depend on earlier ones."""
    k = records(spark, SMALL, "v_candidates").filter("id < 90")
    return k.withColumns({"lng": F.lit(-1.5) + F.col("id") % 3 + F.col("id") / 400000, "lat": F.lit(53.9)}).cache()


def test_resolution_in_order(spark, rows):
    scored = {(r.l, r.r): r for r in op.signals(op.pairs_of(rows, rows)).filter("r < l").collect()}
    shared = {}
    for r in op.vetoes(op.identified_pairs(rows, rows).filter("r < l")).filter("not register_veto").collect():
        shared.setdefault(r.l, []).append((r.r, "MATCH_REVIEW" if r.name_veto else "CONFLICT_REVIEW" if r.conflicts else "MATCH_CONFIDENT"))
    canonical, want = set(), {}
    for i in sorted(r.id for r in rows.select("id").collect()):
        told = sorted(x for x in shared.get(i, []) if x[0] in canonical)
        met = sorted((-r.score, r.r, r) for (left, _), r in scored.items() if left == i and r.r in canonical and not r.name_veto and not r.register_veto)
        if told:
            want[i] = (told[0][1], told[0][0])
            continue
        if not met or met[0][2].score < op.REVIEW:
            canonical.add(i)
            want[i] = ("NEW_CANONICAL", None)
            continue
        best = met[0][2]
        tie = len(met) > 1 and best.score - met[1][2].score < op.NEAR_TIE
        sure = best.score >= op.CONFIDENT and best.sim.score >= op.CONFIDENT_NAME and not (best.generic or tie or best.area or best.sim.carried) and best.metres <= best.radius
        want[i] = ("CONFLICT_REVIEW" if best.conflicts else "MATCH_CONFIDENT" if sure else "MATCH_REVIEW", best.r)
    got = {r.id: (r.outcome, r.matched) for r in op.resolve_in_order(rows).collect()}
    assert got == want and len({x for x, _ in want.values()}) > 1 and any(m is not None for _, m in want.values())


def test_only_canonical_records_are_matched(spark):
    """2 matches 1; 3 is like 2 alone, by another name of it, and 2 isn't canonical, so 3 is new; 4 is near enough to 3 for review."""
    rows = [
        record(1, "Skelton Castle", source=1), record(2, "Skelton Castle", alt=["Overton Priory Gatehouse"], source=2), record(3, "Overton Priory Gatehouse", source=3),
        record(4, "Overton Priory House", source=4, kind="unknown", sure=0.5),
    ]
    got = {r.id: (r.outcome, r.matched) for r in op.resolve_in_order(op.prepared(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1] == ("NEW_CANONICAL", None) and got[2] == ("MATCH_CONFIDENT", 1) and got[3] == ("NEW_CANONICAL", None) and got[4] == ("MATCH_REVIEW", 3), got


@pytest.mark.parametrize(
    "links, gone, most",
    [
        ([], set(), 0),
        ([(i, j) for i in range(60) for j in range(i)], set(range(1, 60)), 1),  # a clique ends at once
        ([(i, i - 1) for i in range(1, 9)], {1, 3, 5, 7}, 4),  # a chain takes a round for every other record
        ([(2, 1), (3, 2), (4, 2), (4, 3)], {2, 4}, 2),
        ([(i, 0) for i in range(1, 50)] + [(i, i - 1) for i in range(2, 50)], set(range(1, 50)), 1),
    ],
)
def test_rounds_of_canonical_records(spark, links, gone, most):
    got, rounds = op.not_canonical(spark.createDataFrame(links, "l long, r long"))
    assert {r.id for r in got.collect()} == gone and rounds <= most


def test_identifiers_of_all_schemes(spark):
    """Pairs that share only a designation's reference, or an identifier of any scheme, are found; the same value of another scheme is none."""
    schema = "id long, external array<struct<scheme: string, value: string>>, refs array<string>, qid string"
    a = spark.createDataFrame([(1, [("nhle", "100"), ("wd", " Q5 ")], None, None), (2, None, ["100", ""], "Q9"), (3, [("isni", "100"), ("x", None)], ["7"], None), (4, None, None, None)], schema)
    b = spark.createDataFrame([(10, [("nhle", "100")], ["7"], None), (11, [("wd", "Q5")], ["100"], "Q9"), (12, [("wd", "")], [""], None)], schema)
    keys = op.identifier_keys(F.col("external"), F.col("refs"), qid=F.col("qid")).alias("keys")
    got = sorted(map(tuple, op.shared_identifiers(a.select("id", keys), b.select("id", keys)).collect()))
    assert got == [(1, 10), (1, 11), (2, 11), (3, 10)]


def test_pairs_below_review_are_counted_not_ranked(spark):
    """However many places are near a candidate, what is ranked is its pairs of REVIEW or more and one row for all others."""
    places = [record(100 + i, f"Thing {i}", lng=-1.5 + i / 10000, kind="church", source=2) for i in range(200)] + [record(400, "Skelton Castle", source=2), record(401, "Skelton Castle", source=1)]
    a, b = (op.prepared(spark.createDataFrame(x, SCHEMA)) for x in ([record(1, "Skelton Castle"), record(2, "Nothing near", lat=56.0)], places))
    scored = op.signals(op.pairs_of(a, b))
    got = {(x.l, x.r): (round(x.score, 6), x.odd, x.sure, x.n) for x in op.tallied(scored).collect()}
    best = scored.filter("r NOT IN (400, 401)").agg(F.max("score")).first()[0]
    assert got == {(1, 400): (0.95, False, True, 1), (1, None): (round(best, 6), None, None, 201)}  # 401 is another entry of one register
    assert {(x.id, x.outcome, x.matched) for x in op.decisions(a, scored, op.identified_pairs(a, b)).collect()} == {(1, "MATCH_CONFIDENT", 400), (2, "NEW_CANONICAL", None)}


def test_shortlist_has_each_pair_once_and_deals_near_ones_no_more(spark):
    """Pairs near and identified, near alone, identified alone, and identified without a position."""
    places = [record(100, "A", qid="Q1"), record(101, "B"), record(102, "C", lat=56.0, qid="Q2"), record(103, "D", lng=None, qid="Q1"), record(104, "E", lat=56.0)]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in ([record(1, "A", qid="Q1"), record(2, "C", qid="Q2")], places))
    pairs = op.shortlisted(a, b)
    assert sorted(map(tuple, pairs.collect())) == [(1, 100), (1, 101), (1, 103), (2, 100), (2, 101), (2, 102)]
    top = pairs._jdf.queryExecution().optimizedPlan()
    assert "Union" in top.nodeName()  # nothing is grouped once all pairs are there


KINDS = [None, "", "unknown", "structure", "shed", "Castle", *sorted({k for group in (*classify.KIN, classify.BUILT) for k in group})]


def test_kinds_fit_as_types_are_compatible(spark):
    """Bits made once a record say what the lists of kinds say, nulls and kinds of no list included."""
    k = spark.createDataFrame([(x,) for x in KINDS], "k string")
    a = k.select(F.col("k").alias("a"), classify.asked_kin(F.col("k")).alias("asked"))
    b = k.select(F.col("k").alias("b"), classify.given_kin(F.col("k")).alias("given"))
    fit, plain = classify.kinds_fit(*map(F.col, ("a", "b", "asked", "given"))), classify.types_compatible(F.col("a"), F.col("b"))
    assert a.crossJoin(b).filter(~fit.eqNullSafe(plain)).count() == 0


def test_similarity_by_pairs_is_that_of_columns(spark):
    """Single names, compiled apart, and lists give the same; texts outside the first plane and repeats count as they should."""
    lists = [[], ["Skelton Castle"], ["Castle"], ["banana bandana", "anana"], ["2, High Street", "High Street"], ["Mill attached to Ash Hall"], ["Church of St Mary", "St Mary"], ["of the"], ["Mary Church St"]]
    rows = spark.createDataFrame([(x,) for x in lists], "n array<string>").withColumn("n", F.transform("n", names.analyse))
    pairs = rows.select(F.col("n").alias("a")).crossJoin(rows.select(F.col("n").alias("b")))
    got = names.with_best_similarity(pairs, "a", "b").withColumn("plain", names.best_similarity(F.col("a"), F.col("b")))
    assert got.filter(~F.col("sim").eqNullSafe(F.col("plain"))).count() == 0 and got.filter("sim.score = 1").count() >= 7
    texts = spark.createDataFrame([("😀😀😀", "😀😀"), ("aaaa", "aaa"), ("abab", "baba"), ("a", "b")], "a string, b string")
    assert [round(r[0], 6) for r in texts.select(text.dice(F.col("a"), F.col("b"))).collect()] == [round(x, 6) for x in (2 / 3, 4 / 5, 4 / 6, 0.0)]


def test_pair_projections_are_compiled(spark):
    """No method of the pairs' stages is over the 8,000 bytes of code that the JVM compiles; nor are conflicts or areas functions of arrays."""
    rows = op.prepared(spark.createDataFrame([record(1, "Skelton Castle")], SCHEMA))
    scored = op.signals(op.pairs_of(rows, rows))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else code is made as stages end
    try:
        for columns in (["score"], ["score", "register_veto", "name_veto"], ["conflicts", "area", "register_veto"], ["s_type"]):
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                scored.select("l", "r", *columns).explain(mode="codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    plan = scored.select("conflicts", "area", "register_veto")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"filter\(array|forall\(array|arrays_overlap", plan)
