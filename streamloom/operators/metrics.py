"""Counters, gauges, rates, and the published alerts and panels as queries over samples or messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import label_key


def counters(samples: DataFrame) -> DataFrame:
    """Sum of the deltas per name and label set."""
    return samples.groupBy("name", label_key(F.col("labels")).alias("labels")).agg(F.sum("value").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    """The last value per name and label set."""
    return samples.groupBy("name", label_key(F.col("labels")).alias("labels")).agg(F.max_by("value", F.col("ts")).alias("value"))


def rate(messages: DataFrame, window: str, seconds: int, keys: list[str], n: Column | None = None) -> DataFrame:
    """Messages a second in each window of event time and key."""
    count = F.count(F.lit(1)) if n is None else F.sum(n)
    out = messages.groupBy(F.window("ts", window), *keys).agg(count.cast("long").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", F.round(F.col("n") / seconds, 6).alias("per_second"))


def counter_rate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Increase a second between a counter's samples (ts_ns, value); a fall is a restart from 0."""
    line = Window.partitionBy(*keys).orderBy("ts_ns")
    before, then = F.lag("value").over(line), F.lag("ts_ns").over(line)
    grown = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return samples.withColumn("per_second", F.when(then.isNotNull() & (F.col("ts_ns") > then), grown / ((F.col("ts_ns") - then) / 1e9)))


def silent_windows(messages: DataFrame, minutes: int) -> DataFrame:
    """Windows between the first and the last message that have none (a full row of windows, counted)."""
    size = f"{minutes} minutes"
    counted = messages.groupBy(F.window("ts", size).start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    ends = counted.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {size}"))).alias("window_start"))
    return spine.join(counted, "window_start", "left_anti")


def drop_ratio(messages: DataFrame, window: str, went_out: Column, most: float) -> DataFrame:
    """Windows in which more than ``most`` of the messages that came in did not go out."""
    w = messages.groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n_in"), F.count_if(went_out).alias("n_out"))
    share = (F.col("n_in") - F.col("n_out")) / F.nullif(F.col("n_in"), F.lit(0))
    return w.select(F.col("window.start").alias("window_start"), "n_in", "n_out", F.round(share, 6).alias("ratio")).where(share > most)


def over(df: DataFrame, column: str, most: float) -> DataFrame:
    """Rows above a threshold: lag, queue depth, connections."""
    return df.where(F.col(column) > most)


def down(heartbeats: DataFrame, now_ns: int, after_ns: int = 60_000_000_000, node: str = "node") -> DataFrame:
    """Nodes without a heartbeat for longer than ``after_ns``."""
    return heartbeats.groupBy(node).agg(F.max("at_ns").alias("last_ns")).where(F.lit(now_ns) - F.col("last_ns") > after_ns)


def growth(messages: DataFrame, window: str, seconds: int, size: Column, most_per_day: float) -> DataFrame:
    """Windows whose growth, carried on for a day, passes ``most_per_day`` bytes."""
    w = messages.groupBy(F.window("ts", window)).agg(F.sum(size).cast("long").alias("bytes"))
    daily = F.col("bytes") * (86400 // seconds)
    return w.select(F.col("window.start").alias("window_start"), "bytes", daily.alias("per_day")).where(daily > most_per_day)


def jumps(df: DataFrame, time: str, value: str, most: float) -> DataFrame:
    """Rows whose value rose by more than ``most`` since the one before."""
    step = F.col(value) - F.lag(value).over(Window.orderBy(time))
    return df.withColumn("rise", step).where(F.col("rise") > most)


def load_summary(df: DataFrame, keys: list[str], latency: str) -> DataFrame:
    """Count, throughput, least, greatest, mean and 99th percentile (the discrete one) per key."""
    spent = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.count(F.lit(1)) / F.nullif(spent, F.lit(0.0)), 6).alias("per_second"),
        F.min(latency).alias("least"),
        F.max(latency).alias("greatest"),
        F.round(F.avg(F.col(latency).cast("decimal(20,6)")), 4).cast("double").alias("mean"),
        F.expr(f"percentile_disc(0.99) within group (order by {latency})").alias("p99"),
    )


def usage(messages: DataFrame, keys: list[str], size: Column, published: Column) -> DataFrame:
    """Per tenant: messages, bytes in and out, publishes and fetches, last activity."""
    return messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.when(published, size).otherwise(0)).cast("long").alias("bytes_in"),
        F.sum(F.when(published, 0).otherwise(size)).cast("long").alias("bytes_out"),
        F.count_if(published).alias("publishes"),
        F.count_if(~published).alias("fetches"),
        F.max("ts").alias("last_activity"),
    )
