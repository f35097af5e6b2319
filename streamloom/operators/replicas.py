"""Cluster health: failure suspicion, in-sync replicas, replication lag, audit counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUSPECT = 8.0


def suspicion(heartbeats: DataFrame, now_ns: int, least_sd_ns: float = 1e8, first_ns: float = 1e9) -> DataFrame:
    """Phi of each node: (silence - mean interval) / deviation / ln 10, never negative.

    The deviation is the sample's, at least ``least_sd_ns``.  With fewer than two intervals ``first_ns``
    stands for the mean and ``least_sd_ns`` for the deviation.  Above 8 a node is suspect.
    """
    line = Window.partitionBy("node").orderBy("at_ns")
    steps = heartbeats.withColumn("step", F.col("at_ns") - F.lag("at_ns").over(line))
    own = steps.groupBy("node").agg(F.max("at_ns").alias("last_ns"), F.count("step").alias("n"), F.avg("step").alias("m"), F.stddev_samp("step").alias("s"))
    few = F.col("n") < 2
    mean = F.when(few, F.lit(first_ns)).otherwise(F.col("m"))
    sd = F.when(few, F.lit(least_sd_ns)).otherwise(F.greatest(F.col("s"), F.lit(least_sd_ns)))
    phi = F.greatest((F.lit(now_ns) - F.col("last_ns") - mean) / sd / math.log(10), F.lit(0.0))
    return own.select("node", "n", F.round(phi, 4).alias("phi"), (phi > SUSPECT).alias("suspect"))


def in_sync(replicas: DataFrame, most_lag: int) -> DataFrame:
    """Adds ``in_sync`` to replicas (topic, partition_id, node, leader_offset, offset, active)."""
    lag = F.col("leader_offset") - F.col("offset")
    return replicas.withColumn("lag", lag).withColumn("in_sync", (lag <= most_lag) & F.col("active"))


def quorum(replicas: DataFrame) -> DataFrame:
    """Per partition the number of replicas in sync and whether they are more than half."""
    own = replicas.groupBy("topic", "partition_id").agg(F.count(F.lit(1)).alias("replicas"), F.count_if("in_sync").alias("in_sync"))
    return own.withColumn("has_quorum", F.col("in_sync") > F.floor(F.col("replicas") / 2))


def geo_lag(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per topic partition how far the remote side is behind the local one.

    ``local``: topic, partition_id, offset; ``remote``: with the offsets that were sent.
    """
    a = local.groupBy("topic", "partition_id").agg(F.max("offset").alias("local_offset"))
    b = remote.groupBy("topic", "partition_id").agg(F.max("offset").alias("remote_offset"))
    sent = F.coalesce("remote_offset", F.lit(-1).cast("long"))
    return a.join(b, ["topic", "partition_id"], "left").select("topic", "partition_id", "local_offset", sent.alias("remote_offset"), (F.col("local_offset") - sent).alias("lag"))


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("category", "action", "result").agg(F.count(F.lit(1)).alias("n"))
