"""Numbers over whole orders, unique slugs, review and resolution, and the report sink."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from cairn.operators import publish, ranks, reports
from cairn.sources import write_report


def slugs_in_order(bases):
    used, out = set(), []
    for b in bases:
        n, slug = 1, b
        while slug in used:
            n += 1
            slug = f"{b}-{n}"
        used.add(slug)
        out.append(slug)
    return out


def test_unique_slugs(spark):
    rng = random.Random(1)
    chain = ["a" + "-2" * k for k in range(13)] * 2  # each second row takes the base of the next
    for bases in (chain, chain[::-1], ["a"] * 30 + [f"a-{i}" for i in range(2, 30)], [f"a-{i}" for i in range(2, 30, 3)] + ["a"] * 30, [rng.choice(["a", "a-2", "a-3", "a-2-2", "b"]) for _ in range(120)]):
        rows = spark.createDataFrame(list(enumerate(bases)), "id long, base string")
        got = [r.slug for r in reports.unique_slugs(rows, "base", "id").orderBy("id").collect()]
        assert got == slugs_in_order(bases)


def test_numbers_and_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, *map(float, range(40))]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    got = {r.i: r.rn for r in ranks.cumulated_within(df, ["k"], ["i"], name="rn").collect()}
    for key in ("x", "y", None):
        assert [got[i] for k, _, i in rows if k == key] == list(range(sum(k == key for k, _, _ in rows)))
    near = {r.k: (r.a, r.b) for r in ranks.nearest_rank(df, ["k"], "v", {"a": 50, "b": 99}).collect()}
    between = {r.k: (r.a, r.b) for r in ranks.interpolated(df, ["k"], "v", {"a": 50, "b": 99}).collect()}
    for key in ("x", "y", None):
        v = sorted(float(x) for k, x, _ in rows if k == key and x is not None)
        assert near[key] == tuple(v[max(1, math.ceil(p * len(v))) - 1] for p in (0.5, 0.99))
        at = [p * (len(v) - 1) for p in (0.5, 0.99)]
        want = [v[math.floor(x)] + (v[math.ceil(x)] - v[math.floor(x)]) * (x - math.floor(x)) for x in at]
        assert all(abs(a - b) < 1e-9 for a, b in zip(between[key], want, strict=True))
    assert [r.i for r in reports.even_sample(df, "i", 7).orderBy("i").collect()] == [math.floor(j * 500 / 7) for j in range(7)]
    assert ranks.cumulated(df.limit(0), ["i"]).count() == 0


def test_digests_depend_on_content_and_order(spark):
    rows = [("x" if i % 3 else "y", i, f"c{i}") for i in range(50)]
    made = lambda data: {r.k: r.digest for r in ranks.ordered_digest(spark.createDataFrame(data, "k string, i long, c string"), ["k"], ["i"], F.col("c"), chunk=7).collect()}
    first = made(rows)
    assert made(rows[::-1]) == first
    assert made([(k, i, "other" if i == 31 else c) for k, i, c in rows]) == first | {"x": made([(k, i, "other" if i == 31 else c) for k, i, c in rows])["x"]} != first
    assert made([(k, 100 - i, c) for k, i, c in rows])["x"] != first["x"]


def test_review_is_replayed(spark):
    candidates = spark.createDataFrame([(1, "pending", False), (2, "approved", True)], "id long, state string, published boolean")
    asked = [(1, 1, "approved", 7, True, 1), (2, 1, "rejected", 7, False, 2), (3, 1, "published", 7, True, 3), (4, 1, "needs_review", 7, True, 4), (5, 2, "rejected", 7, True, 5), (6, 9, "rejected", 7, True, 6)]
    audit = publish.review(candidates, spark.createDataFrame(asked, "decision_id long, candidate_id long, decision string, actor long, editor boolean, moment long"))
    said = {r.decision_id: r.entry for r in audit.collect()}
    assert said == {
        1: "review:pending->approved", 2: "refused: not an editor", 3: "refused: not a reviewer's decision", 4: "review:approved->needs_review", 5: "refused: already published", 6: "refused: no such candidate",
    }
    assert {r.id: r.state for r in publish.reviewed(candidates, audit).collect()} == {1: "needs_review", 2: "approved"}


def test_resolution_keeps_both_values(spark):
    conflicts = spark.createDataFrame([(i, i * 10, i * 10 + 1) for i in range(1, 5)], "id long, existing_value long, incoming_value long")
    told = [(1, 1, "accept_source_value", True, 1), (2, 1, "defer", True, 2), (3, 2, "accept_source_value", True, 1), (4, 3, "accept_source_value", False, 1), (5, 4, "nonsense", True, 1)]
    got = publish.resolve(conflicts, spark.createDataFrame(told, "resolution_id long, conflict_id long, outcome string, editor boolean, moment long")).collect()
    assert {r.id: (r.resolution, r.times, r.shown, r.state) for r in got} == {
        1: ("defer", 2, 10, "needs_review"), 2: ("accept_source_value", 1, 21, "approved"), 3: (None, 0, 30, "needs_review"), 4: (None, 0, 40, "needs_review"),
    }
    assert all((r.existing_value, r.incoming_value) == (r.id * 10, r.id * 10 + 1) for r in got)


def test_upsert_takes_any_column_names(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "b", 1)], "id long, old string, a0 long")
    new = spark.createDataFrame([(1, "c", 5), (1, "d", 4), (None, "e", 1), (2, "f", None)], "id long, old string, a0 long")
    assert {tuple(r) for r in publish.upsert(old, new, ["id"], order="a0").collect()} == {(1, "c", 5), (None, "e", 1), (2, "f", None)}
    assert {tuple(r) for r in publish.upsert(old, new, ["id"], order="a0", keep=("old",)).collect()} == {(1, "a", 5), (None, "b", 1), (2, "f", None)}


def test_report_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "n long, s string")
    write_report(df, f"{tmp_path}/report")
    assert [tuple(r) for r in spark.read.schema(df.schema).json(f"{tmp_path}/report").collect()] == [(1, "x")]
