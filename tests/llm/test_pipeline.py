"""The pipeline against a brute-force version, each stage on odd rows and empty tables, and the queries with SQL against it."""

from __future__ import annotations

import bisect
import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cairn.llm import mixing, near_duplicates, quality, queries
from cairn.llm.common import WordHashes

from ..conftest import SMALL
from .test_operators import PASSAGE, jump, measures

STAGES = dict(corpus_pipeline.STAGES)


def kept_by_rules(rows):
    out = []
    for k, t, s in rows:
        n, chars, symbols, dups, repeats = measures(t)
        lines = len([x for x in t.split("\n") if x.encode().strip()])
        bad = n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or 2 * dups > lines or 10 * t.count("!!") > 3 * n or chars < 2 * n or chars > 15 * n
        out += [] if bad else [(k, t, s)]
    return out


def one_of_each_class(rows):
    known = WordHashes()
    made = [near_duplicates.weighted_shingles(t, known) for _, t, _ in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_duplicates.probability_jaccard(*made[i], *made[j]) >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return [r for r in rows if r[0] in least.values()]


def without_items(rows, items):
    shingled = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items = [re.findall(r"\w+", t.lower()) for t in items]
    out = []
    for k, t, s in rows:
        words = re.findall(r"\w+", t.lower())
        have = set(shingled(words))
        found = False
        for item in items:
            own = shingled(item)
            if have & set(own):
                windows = (shingled(words[a : a + len(item)]) for a in range(max(1, len(words) - len(item) + 1)))
                found |= any(sum((own & w).values()) >= 0.8 * sum((own | w).values()) for w in windows)
        out += [] if found else [(k, t, s)]
    return out


def mixed(spark, rows):
    """(slot, doc_id) of what the mix takes, by walking the streams and the points slot by slot."""
    size = {k: len(t.encode().split()) for k, t, _ in rows}
    sizes = collections.Counter()
    for k, _, s in rows:
        sizes[s] += size[k]
    order = sorted(sizes, key=lambda s: [ord(c) for c in s])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and 3 * sizes[s] < level * weight[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}
    shares, ends, at = [int(target[s] * mixing.SHARES) for s in order], [], 0
    for x in shares:
        at += x
        ends.append(int(at / sum(shares) * mixing.RING))
    block = mixing.block_size(sum(sizes.values()))
    step, slots = mixing.golden_step(mixing.RING), collections.defaultdict(list)
    for i in range(-(-sum(sizes.values()) // block)):
        slots[order[bisect.bisect_right(ends, i * step % mixing.RING)]].append(i)
    stop = {s: min(len(slots[s]) * block, 3 * sizes[s]) for s in order}
    ids = spark.createDataFrame([(k, n) for k, n in size.items()], "doc_id long, size long")
    h = {r.doc_id: r.h for r in ids.select("doc_id", F.xxhash64(F.lit(42), "doc_id", "size", F.lit(1).cast("long")).alias("h")).collect()}
    out = []
    for s in order:
        stream, start = sorted((h[k], k) for k, _, x in rows if x == s), 0
        for _, k in stream:
            for p in range(mixing.MOST):
                begin = start + p * sizes[s]
                words = min(size[k], stop[s] - begin)
                if words > 0 and 2 * words >= size[k]:
                    out.append((slots[s][begin // block], k))
            start += size[k]
    return sorted(out)


def test_pipeline_against_brute_force(spark):
    rows = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = mixed(spark, without_items(one_of_each_class(kept_by_rules(rows)), items))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(k for _, k in want)
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17)) for r in got)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]
    assert docs.filter("shard < 0 or shard > 15").count() == 0


LONG = " ".join(f"w{i % 701}x{i}" for i in range(20000))
PROSE = " ".join(f"prose{i}" for i in range(60))
ODD = [
    (None, None, None), (1, None, "a"), (2, "", None), (3, PROSE, None), (3, PROSE, None), (None, PROSE + " end", "a"), (4, LONG, "a"), (5, LONG.replace("w5x", "v5x"), "b"), (6, PASSAGE, "b"), (None, PASSAGE, None), (7, "é€😀 ünï " * 9, "b"),
    (8, " ".join(f"k{i}" for i in range(40)), "c"), (8, " ".join(f"m{i}" for i in range(40)), "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, repeats, a shared id, long and wide texts, and columns whose names operators might use."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    clashing = {c: F.lit(f"own {c}") for c in ("row", "words", "slot", "shard", "e", "k", "n", "w", "l", "r1", "first", "digest", "band", "copies", "n_words", "fail_bits")}
    return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text")} | clashing)


@pytest.fixture(scope="module")
def with_benchmark(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, PASSAGE), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def seen(df):
    return collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_odd_rows(spark, odd, with_benchmark, name):
    out = STAGES[name](spark, odd, with_benchmark)
    assert set(odd.columns) <= set(out.columns) and (name == "sharding" or out.columns == odd.columns)
    kept = [c for c in odd.columns if c.startswith("own") or c not in ("doc_id", "text", "source", "lang", "n_chars", "shard")]
    assert all(r[c] == f"own {c}" for r in out.collect() for c in kept)
    got, rows = seen(out), seen(odd)
    if name == "quality":
        assert got == collections.Counter({r: n for r, n in rows.items() if len((r[1] or "").split()) >= 20 and r[0] != 7 and "word" not in r[1]} | {r: n for r, n in rows.items() if r[1] == PASSAGE and kept_by_rules([r])})
    if name == "near_duplicates":
        assert sum(n for (_, t, _), n in got.items() if t and t.startswith("prose0")) == 1 and got[(3, PROSE, None)] == 1
        assert [k for k, t, _ in got if t == PASSAGE] == [6] and sum(n for (k, _, _), n in got.items() if k in (4, 5)) == 1
        assert got[(8, ODD[11][1], "c")] == got[(8, ODD[12][1], "c")] == 1 and got[(7, ODD[10][1], "b")] == 1
    if name == "decontamination":
        assert got == collections.Counter({r: n for r, n in rows.items() if r[1] != PASSAGE})
    if name == "mixing":
        assert set(got) <= {r for r in rows if r[1]} and got[(8, ODD[11][1], "c")] + got[(8, ODD[12][1], "c")] >= 2
    if name == "sharding":
        assert got == rows


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_an_empty_table(spark, odd, with_benchmark, name):
    assert STAGES[name](spark, odd.limit(0), with_benchmark).count() == 0


def test_ledger_policies_are_registered():
    assert set(quality.BASE_RULES) <= set(quality.POLICIES["v2"]) < set(quality.POLICIES["v3"])


def test_run_is_registered(spark):
    entry = __spark_entry__.queries()
    assert entry["pipeline"] is corpus_pipeline.run and set(queries.QUERIES) <= set(entry)


def test_oracles(spark):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SMALL)
        run = con.execute(sql)
        columns = [x[0] for x in run.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(run.fetchall()) == sorted(tuple(r[c] for c in columns) for r in df.collect())
