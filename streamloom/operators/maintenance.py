"""Log maintenance: compaction, tombstones, TTL, retention and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
#: Ages after which messages leave the hot and the warm tier, and the log.
HOT_NS, WARM_NS, COLD_NS = HOUR_NS, 24 * HOUR_NS, 7 * 24 * HOUR_NS


def compact(log: DataFrame) -> DataFrame:
    """The last record of each routing key of a partition, and every record without a key; offsets stay."""
    keys = ["topic", "partition_id", "routing_key"]
    keyed = log.where("routing_key <> ''")
    last = keyed.groupBy(*keys).agg(F.max("offset").alias("offset"))
    return keyed.join(last, [*keys, "offset"], "left_semi").unionByName(log.where("routing_key = '' or routing_key is null"))


def latest(versions: DataFrame, key: list[str], value: str, version: Column, deleted: str) -> DataFrame:
    """The newest value of each key; keys whose newest version is deleted are hidden."""
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(F.col(value), F.col(deleted).alias("_gone")), version).alias("_v"))
    return newest.where(~F.col("_v._gone")).select(*key, F.col(f"_v.{value}").alias(value))


def effective_ttl(ttl_ns: Column, default_ns: int) -> Column:
    """A message's TTL, or the topic's default if it has none."""
    return F.when((ttl_ns == 0) & F.lit(default_ns > 0), F.lit(default_ns)).otherwise(ttl_ns)


def is_expired(ts_ns: Column, ttl_ns: Column, now_ns: int) -> Column:
    return (ttl_ns != 0) & (ts_ns + ttl_ns < F.lit(now_ns))


def expired_prefix(log: DataFrame, now_ns: int) -> DataFrame:
    """Expired messages before the first live one of their partition: what can be cut off the log's start."""
    gone = is_expired(F.col("ts_ns"), F.col("ttl_ns"), now_ns)
    first = log.groupBy("topic", "partition_id").agg(F.min(F.when(~gone, F.col("offset"))).alias("_live"))
    return log.join(first, ["topic", "partition_id"]).where(F.col("_live").isNull() | (F.col("offset") < F.col("_live"))).drop("_live")


def expire(log: DataFrame, now_ns: int, action: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(live messages, dead letters): expired messages are dropped or become dead letters."""
    gone = is_expired(F.col("ts_ns"), F.col("ttl_ns"), now_ns)
    dead = log.where(gone if action == "dlq" else F.lit(False)).withColumn("reason", F.lit("expired"))
    return log.where(~gone), dead


def retain_bytes(segments: DataFrame, most: int, keys: tuple[str, ...] = ("topic", "partition_id")) -> DataFrame:
    """Segments (keys, segment, bytes) that stay: the newest ones that fit, and the last one always."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("segment"))
    held = segments.withColumn("_sum", F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(newest))
    return held.where((F.col("_sum") <= most) | (F.col("_r") == 1)).drop("_sum", "_r")


def retain_segments(segments: DataFrame, most: int, keys: tuple[str, ...] = ("topic", "partition_id")) -> DataFrame:
    """The newest ``most`` segments (one at least)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("segment"))
    return segments.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= max(1, most)).drop("_r")


def tier(ts_ns: Column, now_ns: int, hot: int = HOT_NS, warm: int = WARM_NS, cold: int = COLD_NS) -> Column:
    """hot, warm, cold or purged by age."""
    age = F.lit(now_ns) - ts_ns
    return F.when(age <= hot, F.lit("hot")).when(age <= warm, F.lit("warm")).when(age <= cold, F.lit("cold")).otherwise(F.lit("purged"))


def tier_bytes(log: DataFrame, size: Column, now_ns: int, **ages: int) -> DataFrame:
    """Messages and bytes of each tier."""
    return log.groupBy(tier(F.col("ts_ns"), now_ns, **ages).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
