"""Pairs compared inside groups against the same rules on pairs that are there already, on odd records."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import compared
from cairn.operators import matching as op
from cairn.plans import load
from cairn.plans.catalog import QUERIES

from .conftest import SMALL
from .test_matching import SCHEMA, record

load()
NAMES = [
    "Skelton Castle", "Castle", "banana bandana", "anana", "2, High Street", "8, High Street", "2 and 4 High Street", "High Street", "Mill attached to Ash Hall", "Ash Hall", "Mill north of Ash Hall", "Mill south of Ash Hall",
    "Church of St Mary", "St Mary", "of the", "", "Mary Church St", "Église d'Ash; a ruin", "Barn at Ash Farm", "Ash Farm", "Ash Farm Ash Farm", "Barn 10 metres east of Barn", "x", "y", "Old 12", "😀 Hall",
]
COLUMNS = ("metres", "radius", "s_distance", "sim", "s_name", "s_type", "s_postcode", "s_town", "score", "name_veto", "register_veto", "area", "found")


def odd_records(n, seed):
    """Records with lists of names, some empty, and with any field missing."""
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    return [
        record(i, some(*NAMES), lng=-1.5 + rng.uniform(-0.05, 0.05) * some(0.01, 0.1, 1), lat=53.9 + rng.uniform(-0.05, 0.05) * some(0.01, 0.1, 1), alt=some(None, None, [], [some(*NAMES)], [some(*NAMES), None, some(*NAMES)]),
               accuracy=some(None, 3.0, 90.0, 900.0), kind=some(None, "castle", "unknown", "structure", "garden", "shed"), sure=some(None, 0.5, 0.9), postcode=some(None, "LS1 1AB", "ls1 1ab", "YO1 7HH"), town=some(None, "York", "YORK", "Leeds"),
               source=some(None, 1, 2), designation=some(None, "listed_building", "registered_park_garden"))
        for i in range(n)
    ] + [record(10**6, None, alt=None), record(10**6 + 1, "Castle", lng=None)]


@pytest.fixture(scope="module")
def sides(spark):
    frames = [op.prepared(spark.createDataFrame(odd_records(90, seed), SCHEMA)).cache() for seed in (1, 2)]
    scored = op.signals(op.pairs_of(*frames)).cache()
    return *frames, scored


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=lambda r: [(x is None, x) for x in r])


def test_groups_say_what_pairs_say(sides):
    """Every column of every pair, nulls, empty lists and lists of names included; the same pairs where some are asked for."""
    a, b, scored = sides
    got = compared.compared(a, b, 5000.0, COLUMNS)
    got = got.withColumn("found", F.array_join(op.conflicts_of(F.col("found")), ","))
    want = scored.select("l", "r", *[F.col("sim.score").alias(k) if k == "sim" else F.array_join("conflicts", ",").alias(k) if k == "found" else F.col(k) for k in COLUMNS])
    want = rows(want)
    assert rows(got) == want and len(want) > 4000
    for only, kept in (("register_veto", "register_veto"), ("name_veto", "name_veto"), ("free", "NOT register_veto AND NOT name_veto")):
        found = rows(compared.compared(a, b, 5000.0, ("score",), only))
        assert found == rows(scored.filter(kept).select("l", "r", "score")) and found
    assert rows(compared.compared(a, b, 5000.0, ())) == [r[:2] for r in want]


def test_tallies_of_groups(sides):
    """Decisions from what groups count are those from all pairs, by blocking and by comparing all with all."""
    a, b, scored = sides
    said = F.when(F.col("r").isNotNull(), F.coalesce("sure", F.lit(False)))  # what isn't known isn't sure
    want = rows(op.tallied(scored).withColumn("sure", said))
    assert rows(compared.tallied(a, b, 5000.0)) == rows(compared.tallied_of_all(a, b, 5000.0)) == want and any(r[1] is not None for r in want)
    high = op.tallied(scored).filter("r IS NOT NULL").select("l", "r", "score", "odd", F.coalesce("sure", F.lit(False)).alias("sure"))
    assert rows(compared.judged(a, b, 5000.0, op.REVIEW)) == rows(high)
    assert rows(compared.judged(a, a, 5000.0, 0.4, earlier=True).select("l", "r")) == rows(
        op.signals(op.pairs_of(a, a)).filter("r < l AND score >= 0.4 AND NOT name_veto AND NOT register_veto").select("l", "r")
    )
    near = scored.select(F.count(F.lit(1)), F.count_if("name_veto"))
    assert rows(compared.counted(a, b, 5000.0, {"apart": (("name_veto",), lambda p: p.name_veto)})) == rows(near)


def test_shared_elements_in_stretches_of_columns(monkeypatch):
    """Counts don't depend on how many columns a matrix has at most."""
    rng = random.Random(3)
    a, b = ([tuple(set(rng.choices(range(40), k=rng.randrange(12)))) for _ in range(n)] for n in (9, 13))
    want = [[len(set(x) & set(y)) for y in b] for x in a]
    for wide in (2048, 7, 1):
        monkeypatch.setattr(compared, "WIDE", wide)
        shared = compared.Shared(a, b)
        assert shared.counts(np.arange(9)).tolist() == want and shared.counts(np.array([4, 2])).tolist() == [want[4], want[2]]
    assert compared.Shared([], []).counts(np.arange(0)).shape == (0, 0) and compared.Shared([()], [(1,)]).counts(np.arange(1)).tolist() == [[0.0]]


@pytest.mark.parametrize("name", ["name_signal", "score_pair", "match_decision", "run_report", "review_cause", "publication_policy"])
def test_names_are_compared_in_groups(spark, name):
    """Names are compared once for each two that meet in a group, not for each pair of records."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "array_intersect" not in plan
