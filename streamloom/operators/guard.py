"""What may pass: idempotent producers, rate limits, quotas, back-pressure."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import whole
from .ordered import fold, segments

WINDOW_NS = 300_000_000_000
#: Back-pressure starts at this share of the memory; a consumer is slow after so long, and evicted after so many ticks.
PRESSURE, SLOW_NS, TICK_NS, TICKS = 0.85, 30_000_000_000, 10_000_000_000, 3


def producer_key(headers: Column) -> tuple[Column, Column]:
    """Producer id and sequence from the headers; a null sequence takes no part in deduplication."""
    text = lambda name: F.element_at(headers, F.lit(name)).cast("string")
    return text("x-producer-id"), text("x-producer-seq").try_cast("bigint")


def dedup_unbounded(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first sighting of each key, in order of arrival."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in order]), [*key, *order], "left_semi")


def anchored(window_ns: int) -> Callable[[], Callable[[dict], Iterator[dict]]]:
    """The rule for one key: a sighting less than the window after the last *accepted* one is a duplicate."""

    def start() -> Callable[[dict], Iterator[dict]]:
        anchor: int | None = None

        def step(row: dict) -> Iterator[dict]:
            nonlocal anchor
            if row and (anchor is None or row["ts_ns"] - anchor >= window_ns):
                anchor = row["ts_ns"]
                yield {"key": row["key"], "id": row["id"], "ts_ns": row["ts_ns"]}

        return step

    return start


def dedup_windowed(df: DataFrame, key: str, window_ns: int = WINDOW_NS) -> DataFrame:
    """Accepted sightings (key, id, ts_ns).  ``df``: the key's column, id, ts_ns; arrival: time, then id.

    A pause as long as the window begins anew whatever came before, so keys are cut there.
    """
    slim = df.select(F.col(key).cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts_ns").cast("long").alias("ts_ns"))
    return fold(segments(slim, ["key"], "ts_ns", window_ns - 1), ["key", "_segment"], ["ts_ns", "id"], anchored(window_ns), "key string, id long, ts_ns long")


def last_sequence(sightings: DataFrame, producer: str = "producer_id", seq: str = "seq") -> DataFrame:
    return sightings.groupBy(producer).agg(F.max(seq).alias("last_seq"))


def per_second(df: DataFrame, key: str, most: Column, order: list[str]) -> DataFrame:
    """Adds ``attempt`` (its number within the key's second) and ``allowed``; denied attempts count too.

    ``most`` of 0 means no limit.
    """
    second = Window.partitionBy(key, F.date_trunc("second", F.col("ts"))).orderBy(*order)
    return df.withColumn("attempt", F.row_number().over(second).cast("long")).withColumn("allowed", (most == 0) | (F.col("attempt") <= most))


def bucket(rate: int, global_rate: int) -> Callable[[], Callable[[dict], Iterator[dict]]]:
    """Token buckets, one for all and one a topic: burst = rate, refilled by whole seconds gone by, and a
    topic's refusal still costs a token of the bucket for all."""

    def start() -> Callable[[dict], Iterator[dict]]:
        state: dict[str | None, list[int]] = {}

        def take(name: str | None, most: int, now: int) -> bool:
            tokens, last = state.setdefault(name, [most, now])
            whole = (now - last) // 1_000_000_000
            if whole > 0:
                tokens, last = min(most, tokens + whole * most), now
            state[name] = [tokens - (tokens > 0), last]
            return tokens > 0

        def step(row: dict) -> Iterator[dict]:
            if row:
                ok = (not global_rate or take(None, global_rate, row["ts_ns"])) and (not rate or take(row["topic"], rate, row["ts_ns"]))
                yield {"id": row["id"], "topic": row["topic"], "allowed": ok}

        return step

    return start


def token_bucket(df: DataFrame, rate: int, global_rate: int = 0) -> DataFrame:
    """Exact token buckets: id, topic, allowed.  ``df``: id, topic, ts_ns.

    With topic buckets alone each topic is a sequence of its own, cut where it rests long enough to be
    full again.  A bucket for all makes the whole log one sequence, by its nature: it is cut only where
    everything rested.
    """
    slim = df.select(F.col("id").cast("long").alias("id"), "topic", F.col("ts_ns").cast("long").alias("ts_ns")).withColumn("_all", F.lit(0) if global_rate else F.xxhash64("topic"))
    key = ["_all"]
    # after two whole seconds any bucket is full; the buckets' refill marks then begin anew as well
    cut = segments(slim, key, "ts_ns", 2_000_000_000)
    return fold(cut, [*key, "_segment"], ["ts_ns", "id"], bucket(rate, global_rate), "id long, topic string, allowed boolean")


def under_pressure(used: Column, most: Column) -> Column:
    return used > most * PRESSURE


def slow_consumers(deliveries: DataFrame, now_ns: int) -> DataFrame:
    """Per consumer how long its last delivery is ago, the ticks that counted it slow, and whether it goes.

    ``deliveries``: consumer, at_ns."""
    last = deliveries.groupBy("consumer").agg(F.max("at_ns").alias("last_ns"))
    idle = F.lit(now_ns) - F.col("last_ns")
    ticks = F.when(idle > SLOW_NS, whole(idle - SLOW_NS, TICK_NS) + 1).otherwise(0).cast("long")
    return last.withColumn("idle_ns", idle).withColumn("ticks", ticks).withColumn("evict", F.col("ticks") >= TICKS)


def connections(events: DataFrame, most: int, key: str = "node") -> DataFrame:
    """Open connections after each event (+1 open, -1 close; key, seq, delta) and whether it was within the cap."""
    running = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("open", F.sum("delta").over(running).cast("long")).withColumn("allowed", (F.col("delta") <= 0) | (F.col("open") <= most))


def over_storage(usage: DataFrame) -> DataFrame:
    """Adds ``over``: the tenant's bytes have reached its quota (0: none)."""
    return usage.withColumn("over", (F.col("max_storage_bytes") > 0) & (F.col("bytes") >= F.col("max_storage_bytes")))
