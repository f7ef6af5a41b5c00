"""Batches matched against stored canonical records give what one run gives."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from cairn.operators import matching as op
from cairn.operators import versions
from cairn.plans.matching import records
from cairn.streaming import matched

from .conftest import SMALL
from .test_matching import SCHEMA, record


def by_id(df):
    return {r.id: (r.outcome, r.matched, round(r.confidence, 9)) for r in df.collect()}


def test_batches_equal_one_run(spark):
    """Crowded places, so that later batches match earlier ones; some match by identifiers alone, far off; one batch comes twice."""
    k = records(spark, SMALL, "v_candidates").filter("id < 120")
    k = k.withColumns({"lng": F.lit(-1.5) + F.col("id") % 3 + F.col("id") / 400000, "lat": F.lit(53.9)})
    k = k.withColumn("qid", F.when(F.col("id") % 9 == 0, F.concat(F.lit("Q"), F.col("id") % 4))).cache()
    root = tempfile.mkdtemp(prefix="spark-matched-")
    decide = matched.matcher(root, 16)
    for n, low in enumerate((0, 40, 80)):
        part = k.filter(F.col("id").between(low, low + 39))
        decide(part, n)
        if n == 1:
            before = versions.manifest(spark, f"{root}/places")
            decide(part, n)
            assert versions.manifest(spark, f"{root}/places") == before
    whole = by_id(op.resolve_in_order(k))
    assert by_id(matched.decisions(spark, root)) == whole
    far = [i for i, (_, m, _) in whole.items() if m is not None and m // 40 < i // 40]
    assert len(far) > 5  # matches of earlier batches' records


def test_only_touched_buckets_are_read_and_written(spark):
    root = tempfile.mkdtemp(prefix="spark-matched-")
    decide = matched.matcher(root, 32)
    decide(op.prepared(spark.createDataFrame([record(i, f"Hall {i}", lng=-1.5 + i, qid=f"Q{i}") for i in range(20)], SCHEMA)), 0)
    before = {t: versions.manifest(spark, f"{root}/{t}") for t in ("places", "keys")}
    got = decide(op.prepared(spark.createDataFrame([record(100, "Hall 3", lng=-1.5 + 3, source=2), record(101, "New Abbey", lng=40.0, source=2, qid="Q99"), record(102, "Hall 7", lng=60.0, source=2, qid="Q7")], SCHEMA)), 1)
    assert {r.id: (r.outcome, r.matched) for r in got.collect()} == {100: ("MATCH_REVIEW", 3), 101: ("NEW_CANONICAL", None), 102: ("CONFLICT_REVIEW", 7)}
    for t in ("places", "keys"):
        after = versions.manifest(spark, f"{root}/{t}")
        assert sum(after[b] != before[t].get(b) for b in after) == 1  # of the one new record
    assert decide(op.prepared(spark.createDataFrame([], SCHEMA)), 2).count() == 0


def test_decisions_over_the_antimeridian(spark):
    """A place on the other side of the antimeridian is near, in one run and in batches, and it is reported so."""
    rows = [record(1, "Skelton Castle", lng=179.9999, lat=-17.0, source=1), record(2, "Skelton Castle", lng=-179.9999, lat=-17.0, source=2)]
    a, b = (op.prepared(spark.createDataFrame([r], SCHEMA)) for r in rows)
    assert by_id(op.decisions(b, op.signals(op.pairs_of(b, a)), op.identified_pairs(b, a)))[2][:2] == ("MATCH_CONFIDENT", 1)
    decide = matched.matcher(tempfile.mkdtemp(prefix="spark-matched-"), 16)
    decide(a, 0)
    assert by_id(decide(b, 1))[2][:2] == ("MATCH_CONFIDENT", 1)
