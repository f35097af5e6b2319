"""Streams over finite input equal their batch forms, but for windows still open."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from streamloom.operators import guard, joins, topology, windows
from streamloom.sources import files, messages
from streamloom.streaming import stateful


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_tumbling_stream(rocks, sf, tmp_path):
    spark = rocks
    e = messages.from_events(messages.table(spark, sf, "events")).select("topic", "ts", "event_id")
    out = stateful.tumbling_counts(stream_of(spark, e, tmp_path / "in"), "1 hour", ["topic"], "10 minutes")
    stateful.run_available(out, "tumbled", str(tmp_path / "cp"))
    got = {(r.topic, r.window_start, r.n) for r in spark.table("tumbled").collect()}
    newest = e.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    batch = windows.tumbling(e, "1 hour", ["topic"])
    want = {(r.topic, r.window_start, r.n) for r in batch.collect() if r.window_end <= newest}
    assert got == want


def test_stateful_dedup_and_pairs(rocks, tmp_path):
    spark = rocks
    rows = [(k, i, (i * 37) % 100, "L" if i % 3 else "R") for i, k in enumerate("abab" * 12)]
    df = spark.createDataFrame(rows, "key string, id long, ts_ns long, side string")
    found = stateful.dedup(stream_of(spark, df.select("key", "id", "ts_ns"), tmp_path / "d"), 20)
    stateful.run_available(found, "kept", str(tmp_path / "cp1"))
    assert sorted(r.id for r in spark.table("kept").collect()) == sorted(r.id for r in guard.dedup_windowed(df, "key", 20).collect())
    pairs = stateful.pair_join(stream_of(spark, df, tmp_path / "p"), 9)
    stateful.run_available(pairs, "paired", str(tmp_path / "cp2"))
    batch = joins.pair_join(df.where("side = 'L'"), df.where("side = 'R'"), "key", 9).where("left_id is not null and right_id is not null")
    assert sorted(map(tuple, spark.table("paired").collect())) == sorted(map(tuple, batch.collect()))


def test_topology_stream_resumes(spark, sf, tmp_path):
    e = messages.from_events(messages.table(spark, sf, "events")).select("topic", "ts", "event_id", "value", "partition_id")
    half = e.where("event_id % 2 = 0")
    half.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    t = topology.Topology("t").source("events.click").filter(F.col("value") > 10).sink("out")
    args = (stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    t.start_stream(*args).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    e.where("event_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
    t.start_stream(*args).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == e.where("topic = 'events.click' and value > 10").count() > first
    assert rows.select("event_id").distinct().count() == rows.count()


def test_stored_log(spark, sf, tmp_path):
    log = messages.log(spark, sf)
    files.write_log(log, str(tmp_path / "log"))
    back = files.read_log(spark, str(tmp_path / "log"))
    assert back.count() == log.count()
    plan = back.where("topic = 'events.click' and offset = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "events.click" in plan
    files.backup(spark, str(tmp_path / "log"), str(tmp_path / "copy"))
    files.append_jsonl(log.select("event_id", "payload"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == files.read_log(spark, str(tmp_path / "copy")).count()
