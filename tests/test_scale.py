"""Plans that hold at any size: what is broadcast, and how rows are dealt."""

from __future__ import annotations

from cairn.operators import blocking, publish, spread
from cairn.plans import load
from cairn.plans.catalog import QUERIES

from .test_blocking import SCHEMA, near, places

load()


def broadcasts(plan):
    """Column names of each table that a plan broadcasts."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return broadcasts(plan.initialPlan())
    found = []
    if "BroadcastExchange" in plan.nodeName():
        out = plan.output()
        found.append({out.apply(i).name() for i in range(out.size())})
    children = plan.children()
    return found + [x for i in range(children.size()) for x in broadcasts(children.apply(i))]


def test_no_side_of_near_pairs_is_broadcast(spark, tmp_path):
    """However few bytes its file has: bytes don't tell rows, and a side's copies are many times its rows."""
    a, b = places(600, 7, 0.9), places(700, 8, 0.9)
    for name, rows in (("a", a), ("b", b)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}")
    for most in (50, 2000):
        pairs = blocking.near_pairs(*[spark.read.parquet(f"{tmp_path}/{x}") for x in "ab"], 2000.0, keep=("name",), most=most)
        sides = [x for x in broadcasts(pairs._jdf.queryExecution().executedPlan()) if x & {"x1", "x2", "l", "r", "l_name", "r_name"}]
        assert not sides
        assert sorted((r.l, r.r) for r in pairs.collect()) == near(a, b, 2000.0)


def test_no_side_of_identified_pairs_is_broadcast(spark, tmp_path):
    """What shares an identifier is joined by it, on sides of any number of rows in files of few bytes."""
    rows = [(i, f"Customer#{i}", i % 25, 1.0 * i, "BUILDING") for i in range(600)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("shared_identifier", "join_union_pairs", "review_cause"):
        pairs = QUERIES[name](spark, str(tmp_path))
        assert not [x for x in broadcasts(pairs._jdf.queryExecution().executedPlan()) if x & {"key", "l", "r", "lp", "rp"}]
    found = sorted(map(tuple, QUERIES["shared_identifier"](spark, str(tmp_path)).collect()))
    assert found == [(i, i) for i in range(600) if i % 12 == 0]


def test_costly_rows_are_dealt_over_all_tasks(spark, tmp_path):
    """A small file of names is one task's input, but its names are analysed in as many tasks as shuffles have."""
    parts = [(i, f"part {i}", "b", "t", i % 50, 1.0) for i in range(200)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("names_distinct", "name_similarity", "analyse_name"):
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_aggregates_that_hold_their_keys_have_tasks_by_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    dealt = spread.spread_by_count(rows, "k", most=50)
    assert dealt.rdd.getNumPartitions() == 20 and spread.spread_by_count(rows, "k").rdd.getNumPartitions() == 4
    assert max(map(len, dealt.rdd.glom().collect())) < 100


def test_replayed_counts_repeats_and_nulls(spark):
    ddl = "k long, v string"
    once = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], ddl)
    again = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (3, "d")], ddl)
    assert tuple(publish.replayed(once, again).first()) == (4, 4)  # one a, one c, two d
    assert tuple(publish.replayed(once, once).first()) == (4, 0) and tuple(publish.replayed(once.limit(0), once.limit(0)).first()) == (0, 0)
