"""Nearest neighbours and vector codes against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import neighbours, vector_codes

from ..conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, k long, x string, cell int, score double, code string"


def clashing(rows):
    return [(*r, 1, "x", 2, 0.5, "c") for r in rows]


def vectors(n, width=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)).astype(np.float32)
    return [(i, [float(c) for c in x[i]], int(i % 3) if i % 7 else None) for i in range(n)]


def odd_rows():
    """Nulls, zeros, components that are null or not finite, short and empty ones, copies, repeated rows, a null id."""
    rows = vectors(300)
    same = rows[5][1]
    more = [
        (400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [1.0, None] + [0.0] * 14, 2), (404, [math.nan] + [1.0] * 15, 2), (405, [math.inf] + [1.0] * 15, None),
        (406, [2.0, -1.0], 0), (None, rows[7][1], None), (None, rows[7][1], None), (420, [-0.0] * 16, 1), rows[40], rows[40], (440, [128 * c for c in rows[9][1]], 1), (460, [c / 64 for c in rows[9][1]], 1),
    ]
    return rows + more + [(i, same, 0) for i in range(1000, 1100)]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def nearest(rows, n=20, every=20):
    """{(query id, its vector): [(id, score)]} by all inner products."""
    kept = {(r[0], tuple(r[1]) + (0.0,) * (16 - len(r[1]))) for r in rows if usable(r[1]) and any(r[1])}
    ids = [k for k, _ in kept]
    x = np.array([v for _, v in kept], np.float64)
    out = {}
    for i, (k, v) in enumerate(kept):
        if k is not None and k % every == 0:
            s = np.cumsum(x * x[i], axis=1)[:, -1]
            order = sorted((j for j in range(len(ids)) if ids[j] != k), key=lambda j: (-s[j], ids[j] is None, ids[j] or 0))
            out[k, v] = [(ids[j], s[j]) for j in order[:n]]
    return out


def found(df):
    got = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    assert set(got) == {k for k, _ in want} and all(len(got[k]) == len(w) for (k, _), w in want.items())
    hits = sum(len({a for a, _ in got[k]} & {a for a, _ in w}) for (k, _), w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("pieces", [{}, {"least_points": 40, "most_points": 40}, {"least_points": 64, "sample": 100}])
def test_neighbours_of_odd_rows(spark, pieces):
    """One cell, many small cells, cells cut into pieces and blocks: all have nearly the neighbours of brute force."""
    rows = odd_rows()
    want = nearest(rows)
    got = found(neighbours.nearest_neighbours(spark.createDataFrame(clashing(rows), SCHEMA), **pieces))
    assert recall(got, want) >= 0.9
    scores = {k: dict(w) for (k, _), w in nearest(rows, n=10_000).items()}
    for k, g in got.items():
        assert all(scores[k][i] == s for i, s in g) and g == sorted(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))


def test_neighbours_are_all_found_when_sure(spark):
    """With a test that never holds before the end, copies and ties are those of brute force, to the row."""
    rows = odd_rows()
    got = found(neighbours.nearest_neighbours(spark.createDataFrame(clashing(rows), SCHEMA), sure=1 - 1e-15, least_points=50))
    assert got == {k: w for (k, _), w in nearest(rows).items()}


def test_few_and_no_neighbours(spark):
    rows = vectors(5)
    assert found(neighbours.nearest_neighbours(spark.createDataFrame(clashing(rows), SCHEMA))) == {k: w for (k, _), w in nearest(rows).items()}
    for few in ([], [(20, None, 1)], rows[:1]):
        assert neighbours.nearest_neighbours(spark.createDataFrame(clashing(few), SCHEMA)).count() == 0


def test_recall_of_the_query(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    ids, x = zip(*((r.vec_id, r.embedding) for r in df.collect()), strict=True)
    x, got, hits = np.array(x, np.float64), found(neighbours.nearest_neighbours(df)), 0
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            order = [ids[j] for j in np.argsort(-(x @ x[i])) if j != i][:20]
            hits += len({a for a, _ in got[ids[i]]} & set(order))
    assert len(got) == sum(i % 20 == 0 for i in ids) and hits / (20 * len(got)) >= 0.9


def test_chi_square():
    x = np.random.default_rng(1).chisquare(12, 200_000)
    for p in (0.1, 0.5, 0.95):
        assert abs(np.quantile(x, p) - neighbours.quantile(p, 12)) < 0.1 and abs(neighbours.chi_square(neighbours.quantile(p, 12), 12) - p) < 1e-9


def test_the_stopping_test_prunes(spark):
    """Verified points are few where neighbours are near, so the search doesn't read all."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((50, 32))
    x = np.repeat(centres, 40, 0) + 0.02 * rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a = neighbours.projection(33, 12)
    p = np.hstack([x, np.zeros((2000, 1))]) @ a
    tree = neighbours.Tree(p)
    seen = [own for near, own, _ in tree.incremental(p[0]) if near <= neighbours.quantile(0.95, 12) * 0.1]
    assert sum(map(len, seen)) < 1000 and set(range(40)) <= set(np.concatenate(seen).tolist())
    kept = neighbours.search(tree, x, np.ones(2000, int), 1.0, x[0], p[0], -np.inf, 21, neighbours.quantile(0.95, 12))
    assert len(set(kept.tolist()) & set(np.argsort(-(x @ x[0]))[:21].tolist())) >= 19


def lloyd(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd with Python's whole numbers."""
    kept = [r for r in rows if usable(r[1])]
    width = -(-max((len(r[1]) for r in kept), default=1) // parts)
    x = [[math.floor(1024 * c) for c in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    first = sorted(range(len(x)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i]))[:entries]
    books = [[x[i][p * width : (p + 1) * width] for i in first] for p in range(parts)]
    part = lambda i, p: x[i][p * width : (p + 1) * width]
    square = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [[min((square(part(i, p), c), j) for j, c in enumerate(books[p])) for p in range(parts)] for i in range(len(x))]
        for p in range(parts) if n < rounds else ():
            for j in range(len(books[p])):
                own = [part(i, p) for i in range(len(x)) if at[i][p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    error = [sum(e for e, _ in a) for a in at]
    by_label = collections.Counter()
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in a), e, by_label[r[2]], digest) for r, a, e in zip(kept, at, error, strict=True)), key=str)


@pytest.mark.parametrize("entries, width", [(256, 16), (8, 16), (5, 6)])
def test_codes_are_those_of_plain_lloyd(spark, entries, width):
    rows = odd_rows() if width == 16 else vectors(120, width, 3)
    got = vector_codes.vector_codes(spark.createDataFrame(clashing(rows), SCHEMA), n_entries=entries)
    assert sorted(map(tuple, got.collect()), key=str) == lloyd(rows, entries=entries)


def test_codes_of_ties_and_hot_vectors(spark):
    """Few values, so that distances tie and entries coincide; the lower index wins in every round."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 8) / 1024], 1) for i in range(400)] + [(1000 + i, [0.001] * 8, None) for i in range(300)]
    got = vector_codes.vector_codes(spark.createDataFrame(clashing(rows), SCHEMA), n_entries=40)
    assert sorted(map(tuple, got.collect()), key=str) == lloyd(rows, entries=40)


def test_codes_of_few_and_odd_rows(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(3, [1.0, 2.0], 1), (1, [-1.5, 0.25, 4.0], None), (2, [], 1), (4, None, 1), (5, [1e20, 0.0], 1)]
    got = vector_codes.vector_codes(spark.createDataFrame(clashing(few), SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == lloyd(few[:3])  # components beyond the range leave the row out


def test_bounds_leave_out_most_distances():
    """Near the end entries hardly move, and most rows need no distance at all."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, (16, 4))
    x = np.repeat(centres, 100, 0) + rng.integers(-5, 6, (1600, 4))
    entries = centres.astype(np.int64)
    at, best, upper, lower = vector_codes.first_assignment(x, entries)
    books = vector_codes.Codebooks(entries[None] + 1, entries[None])
    at2, best2, _, _ = vector_codes.next_assignment(x, entries + 1, at, upper, lower, books.moved[0], books.between[0])
    assert (best2 < 0).mean() > 0.9 and (at2 == vector_codes.squared(x, entries + 1).argmin(1)).all()
    for n in (0, 1, 2, 3, 24, 25, 26, 2**61 - 1, (2**30 - 1) ** 2):
        assert vector_codes.roots(np.array([n]))[0] == math.isqrt(n) and vector_codes.roots_up(np.array([n]))[0] == math.isqrt(n) + (math.isqrt(n) ** 2 < n)


def test_label_sums_of_the_query(spark):
    got = vector_codes.vector_codes(spark.read.parquet(f"{SMALL}/embeddings.parquet")).join(spark.read.parquet(f"{SMALL}/embeddings.parquet"), "vec_id")
    sums = got.groupBy("label").agg(F.sum("error").alias("e"), F.min("label_error").alias("a"), F.max("label_error").alias("b")).collect()
    assert sums and all(r.e == r.a == r.b for r in sums)
