"""Incremental ingestion publishes each batch once, and a replay changes nothing."""

from __future__ import annotations

import tempfile

from cairn.sources import SOURCES, read_staging, write_staging
from cairn.streaming import ingest as stream

from .conftest import SMALL

SCHEMA = "source_id string, source_record_id string, name string, modified timestamp"


def test_ingest_and_replay(spark):
    root = tempfile.mkdtemp(prefix="spark-stream-")
    rows = SOURCES["events"](spark, {"dir": SMALL}).select("source_id", "source_record_id", "name", "modified")
    rows.limit(100).coalesce(1).write.parquet(f"{root}/in/a")
    stream.ingest(spark, f"{root}/in/*", f"{root}/table", SCHEMA, f"{root}/state").awaitTermination()
    assert stream.current(spark, f"{root}/table", SCHEMA).count() == 100
    rows.limit(100).coalesce(1).write.parquet(f"{root}/in/b")
    stream.ingest(spark, f"{root}/in/*", f"{root}/table", SCHEMA, f"{root}/state").awaitTermination()
    assert stream.versions(spark, f"{root}/table")[-1] == 2
    assert stream.current(spark, f"{root}/table", SCHEMA).count() == 100
    whole = {tuple(r) for r in stream.current(spark, f"{root}/table", SCHEMA).collect()}
    assert stream.expire(spark, f"{root}/table") > 0 == stream.expire(spark, f"{root}/table")
    assert {tuple(r) for r in stream.current(spark, f"{root}/table", SCHEMA).collect()} == whole


def test_a_batch_rewrites_only_its_buckets(spark):
    root = tempfile.mkdtemp(prefix="spark-stream-")
    publish = stream.publisher(root, SCHEMA, buckets=16)
    rows = SOURCES["events"](spark, {"dir": SMALL}).select("source_id", "source_record_id", "name", "modified")
    publish(rows, 0)
    one = rows.filter("source_record_id = '7'").selectExpr("source_id", "source_record_id", "'renamed' AS name", "modified")
    publish(one, 1)
    publish(one, 1)  # a batch that runs again
    assert sum(n.startswith("bucket=") for n in stream._listed(spark, f"{root}/v2")) == 1
    got = {r.source_record_id: r.name for r in stream.current(spark, root, SCHEMA).collect()}
    assert got == {r.source_record_id: r.name for r in rows.collect()} | {"7": "renamed"}


def test_staging_round_trip(spark):
    root = tempfile.mkdtemp(prefix="spark-staging-")
    rows = spark.createDataFrame([(1, 'a "quoted", cell'), (2, "plain")], "id long, cell string")
    for form in ("csv", "parquet"):
        write_staging(rows, f"{root}/{form}", form)
        assert sorted(map(tuple, read_staging(spark, f"{root}/{form}", "id long, cell string", form).collect())) == sorted(map(tuple, rows.collect()))


def test_source_options(spark):
    every = SOURCES["events"](spark, {"dir": SMALL})
    assert every.count() > SOURCES["events"](spark, {"dir": SMALL, "since": "2999-01-01"}).count() == 0
