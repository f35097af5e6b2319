"""The message log: an envelope view over event tables, and reads by offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators.ordered import numbered
from ..schema import epoch_ns

PARTITIONS = 8
DAY_NS = 86_400_000_000_000
#: Defaults and bounds of a fetch request and of a listing.
FETCH_LIMIT, FETCH_MOST = 100, 10_000
PAGE_LIMIT, PAGE_MOST = 100, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Events as messages, without offsets; narrow, so filters reach the scan.

    Topic is the event's type, routing key its user, payload its JSON; priority, TTL, delay and retry
    fields are fixed functions of the event's id.
    """
    e = F.col("event_id")
    key = F.col("user_id").cast("string")
    return events.select(
        "event_id",
        "ts",
        epoch_ns(F.col("ts")).alias("ts_ns"),
        F.concat(F.lit("events."), F.col("event_type")).alias("topic"),
        key.alias("routing_key"),
        hashing.partition_for(key, partitions).cast("long").alias("partition_id"),
        F.col("props").alias("payload"),
        F.col("value"),
        F.col("user_id"),
        F.col("event_type"),
        (e % 10).cast("int").alias("priority"),
        F.when(e % 3 == 0, F.lit(DAY_NS)).otherwise(F.lit(0).cast("long")).alias("ttl_ns"),
        F.when(e % 5 == 0, epoch_ns(F.col("ts")) + F.lit(3_600_000_000_000)).otherwise(F.lit(0).cast("long")).alias("deliver_at_ns"),
        (e % 4).cast("int").alias("max_retries"),
    )


def with_offsets(messages: DataFrame) -> DataFrame:
    """Dense offsets from 0 in each topic partition, in order of arrival (time, then id).

    By prefix sums over the hours' counts: a partition of a busy topic is sorted an hour at a time.
    """
    return numbered(messages, ["topic", "partition_id"], F.date_trunc("hour", F.col("ts")), ["ts", "event_id"], "offset")


def log(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    return with_offsets(from_events(table(spark, sf_dir, "events"), partitions))


def read_range(log: DataFrame, topic: str, partition: int, start: int, end: int, most: int) -> DataFrame:
    """Up to ``most`` messages of one partition with offsets from ``start`` to ``end``, in order."""
    here = (F.col("topic") == topic) & (F.col("partition_id") == partition) & F.col("offset").between(start, end)
    return log.where(here).orderBy("offset").limit(most)


def read_at(log: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("partition_id") == partition) & (F.col("offset") == offset))


def fetch(log: DataFrame, topic: str, partition: int = 0, start: int = 0, limit: int = FETCH_LIMIT) -> DataFrame:
    """A fetch request: defaults and cap as published; each row carries ``next_offset``."""
    rows = read_range(log, topic, partition, start, 2**62, max(1, min(limit, FETCH_MOST)))
    return rows.withColumn("next_offset", F.max("offset").over(Window.partitionBy()) + 1)


def listing(df: DataFrame, order: str, offset: int = 0, limit: int = PAGE_LIMIT) -> DataFrame:
    """A page of a listing, ordered by name."""
    return df.orderBy(order).offset(max(0, offset)).limit(max(1, min(limit, PAGE_MOST)))


def topic_source(log: DataFrame, topic: str, partitions: list[int] | None = None) -> DataFrame:
    """The messages of a topic, of all or the named partitions."""
    here = F.col("topic") == topic
    return log.where(here if partitions is None else here & F.col("partition_id").isin(partitions))


def topic_sink(messages: DataFrame, topic: str, partitions: int = PARTITIONS) -> DataFrame | None:
    """Messages republished to a topic, partitioned and numbered anew; an empty topic discards them."""
    if not topic:
        return None
    moved = messages.withColumn("topic", F.lit(topic)).withColumn("partition_id", hashing.partition_for(F.col("routing_key"), partitions).cast("long"))
    return with_offsets(moved)


def round_robin(messages: DataFrame, partitions: int, order: list[Column | str] | None = None) -> DataFrame:
    """Partitions of messages without a key: one after the other within a topic, counting those alone.

    The order is total within a topic, so a topic's messages are numbered by range: a prefix sum over
    the counts of (topic, hour) and a row number within the hour; no task holds a whole topic.
    """
    placed = numbered(messages, ["topic"], F.date_trunc("hour", F.col("ts")), order or ["ts", "event_id"], "_number")
    return placed.withColumn("partition_id", F.pmod(F.col("_number"), F.lit(partitions)).cast("long")).drop("_number")


def watermarks(log: DataFrame) -> DataFrame:
    """Per topic partition the first and the last offset and the number of messages."""
    return log.groupBy("topic", "partition_id").agg(F.min("offset").alias("log_start"), F.max("offset").alias("high_watermark"), F.count(F.lit(1)).alias("n"))
