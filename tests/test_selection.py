"""Percentiles by selection against sorted values, on distributions that range histograms find hard."""

from __future__ import annotations

import math
import random

import pytest

from cairn.operators import ranks

rng = random.Random(7)
VALUES = {
    "even": [rng.random() for _ in range(3000)],
    "magnitudes": [2.0 ** rng.randint(-1000, 1000) * rng.choice((1, -1)) for _ in range(800)],
    "one": [4.25] * 50,
    "two": [1.0] * 500 + [1.0000000001] * 499,
    "close": [1e9 + i * 1e-6 for i in range(2000)] + [-1e300, 1e300],
    "odd": [math.inf, -math.inf, 0.0, -1.0, 5.0, math.inf],
    "single": [3.0],
}
PERCENTS = {"a": 0, "b": 50, "c": 95, "d": 99.9, "e": 100}


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, v) for k, values in VALUES.items() for v in values] + [(None, 1.0), (None, 2.0), ("none", None)]
    rng.shuffle(made)
    return spark.createDataFrame(made, "k string, v double").repartition(5).cache()


def test_nearest_rank(rows):
    got = {r.k: r for r in ranks.nearest_rank(rows, ["k"], "v", PERCENTS).collect()}
    assert set(got) == {*VALUES, None}
    for k, values in VALUES.items():
        values = sorted(values)
        assert [got[k][x] for x in PERCENTS] == [values[max(1, math.ceil(p / 100.0 * len(values))) - 1] for p in PERCENTS.values()], k


def test_interpolated(rows):
    got = {r.k: r for r in ranks.interpolated(rows.filter("k <> 'odd'"), ["k"], "v", PERCENTS).collect()}
    for k, values in VALUES.items():
        if k == "odd":
            continue
        values = sorted(values)
        for x, p in PERCENTS.items():
            at = p / 100.0 * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert got[k][x] == low + (high - low) * (at - math.floor(at)), (k, x)


def test_selection_and_ranks_agree(rows, monkeypatch):
    one = sorted(map(tuple, ranks.interpolated(rows.filter("k <> 'odd'"), ["k"], "v", {"p": 90}).collect()), key=str)
    monkeypatch.setattr(ranks, "SELECTED", 2)
    assert ranks.selected(rows, ["k"], "v", lambda n: {0}) is None
    assert one == sorted(map(tuple, ranks.interpolated(rows.filter("k <> 'odd'"), ["k"], "v", {"p": 90}).collect()), key=str)


def test_without_keys_or_rows(spark, rows):
    assert ranks.interpolated(rows.limit(0), ["k"], "v", PERCENTS).count() == 0
    whole = ranks.nearest_rank(rows.filter("k = 'even'").select("v"), [], "v", {"p": 50}).collect()
    assert [r.p for r in whole] == [sorted(VALUES["even"])[1499]]
