"""The publish path as one plan: each message gets the first status that applies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import maintenance
from ..operators.routing import small
from ..schema import MAX_MESSAGE_BYTES

BATCH_MOST = 1000


@dataclass
class Rules:
    """What a publish is held against; column rules are over the message."""

    most_bytes: int = MAX_MESSAGE_BYTES
    rate: int = 0
    default_ttl_ns: int = 0
    violations: Column | None = None
    now_ns: int = 0


def publish(messages: DataFrame, topics: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``status``, ``partition_id`` and ``ttl_ns``.

    In order: too_large, no_topic, duplicate (same producer and sequence seen before, among messages that
    passed so far), rate_limited (more than ``rate`` a second in a topic), invalid (schema), delayed (its
    time has not come; queue topics only), accepted.
    ``messages``: event_id, ts, ts_ns, topic, routing_key, payload, producer_id, seq, ttl_ns,
    deliver_at_ns.  ``topics``: topic, mode, partitions.
    """
    known = messages.join(small(topics.select("topic", "mode", "partitions")), "topic", "left")
    known = known.withColumn("_a", F.when(F.octet_length("payload") > rules.most_bytes, "too_large").when(F.col("mode").isNull(), "no_topic"))
    # rows that failed already stand aside: they neither count as seen nor use up the rate
    named = F.col("_a").isNull() & F.col("producer_id").isNotNull() & F.col("seq").isNotNull()
    # unnamed rows, most of a log, are no key of their own: they spread over all tasks
    apart = F.when(~named, F.xxhash64("event_id", "ts_ns"))
    seen = Window.partitionBy("producer_id", "seq", apart).orderBy("ts_ns", "event_id")
    known = known.withColumn("_b", F.when(named & (F.row_number().over(seen) > 1), "duplicate"))
    passed = F.col("_a").isNull() & F.col("_b").isNull()
    if rules.rate:
        second = Window.partitionBy("topic", F.date_trunc("second", F.col("ts")), passed).orderBy("ts_ns", "event_id")
        known = known.withColumn("_c", F.when(passed & (F.row_number().over(second) > rules.rate), "rate_limited"))
    else:
        known = known.withColumn("_c", F.lit(None).cast("string"))
    invalid = F.when(F.size(rules.violations) > 0, "invalid") if rules.violations is not None else F.lit(None).cast("string")
    held = F.when((F.col("deliver_at_ns") > rules.now_ns) & F.col("mode").isin("queue", "unified"), "delayed")
    status = F.coalesce("_a", "_b", "_c", invalid, held, F.lit("accepted"))
    return known.select(
        *[c for c in messages.columns if c not in ("partition_id", "ttl_ns")],
        maintenance.effective_ttl(F.col("ttl_ns"), rules.default_ttl_ns).alias("ttl_ns"),
        F.when(F.col("partitions").isNotNull() & (F.col("routing_key") != ""), hashing.murmur3(F.col("routing_key")) % F.col("partitions")).alias("partition_id"),
        status.alias("status"),
    )


def batch_status(published: DataFrame, batch: str) -> DataFrame:
    """Per batch: the messages that got through, those that did not, and the answer: 200, 207 or 500.

    A batch has ``BATCH_MOST`` messages at most; a longer one is answered with 400.
    """
    ok = F.col("status").isin("accepted", "delayed", "duplicate")
    n = published.groupBy(batch).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    code = F.when(F.col("ok") + F.col("failed") > BATCH_MOST, 400).when(F.col("failed") == 0, 200).when(F.col("ok") == 0, 500).otherwise(207)
    return n.withColumn("code", code.cast("int"))
