"""Queue semantics over a log of deliveries, acks and nacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import fold

MESSAGE = ("topic", "partition_id", "offset")
VISIBILITY_NS = 30_000_000_000


def pending(events: DataFrame) -> DataFrame:
    """Messages delivered and not acknowledged: their last delivery, and how often they were refused."""
    kind = lambda k: F.col("event") == k
    state = events.groupBy(*MESSAGE).agg(
        F.max(F.when(kind("deliver"), F.col("at_ns"))).alias("delivered_ns"),
        F.count_if(kind("ack")).alias("_acks"),
        F.count_if(kind("nack")).alias("nacks"),
    )
    return state.where("_acks = 0 and delivered_ns is not null").drop("_acks")


def visibility_expired(pending: DataFrame, now_ns: int, timeout_ns: int = VISIBILITY_NS) -> DataFrame:
    """Pending messages due for another delivery."""
    return pending.where(F.lit(now_ns) - F.col("delivered_ns") > timeout_ns)


def after_nack(refused: DataFrame) -> DataFrame:
    """``action`` for refused messages: dlq once the refusals reach ``max_retries`` (if above 0), else redeliver."""
    spent = (F.col("max_retries") > 0) & (F.col("nacks") >= F.col("max_retries"))
    return refused.withColumn("action", F.when(spent, F.lit("dlq")).otherwise(F.lit("redeliver")))


def ready(messages: DataFrame, now_ns: int, mode: str = "queue") -> DataFrame:
    """Messages whose time has come; a stream ignores delays."""
    return messages if mode == "stream" else messages.where(F.col("deliver_at_ns") < now_ns)


def delayed(messages: DataFrame, now_ns: int) -> DataFrame:
    return messages.where(F.col("deliver_at_ns") >= now_ns)


def drain_order(messages: DataFrame) -> DataFrame:
    """Adds ``place`` (from 1): the order in which a topic's waiting messages leave, by priority, then offset.

    Numbered by range like ``round_robin``: prefix sums over the counts of (topic, priority, partition).
    """
    level = F.least(F.col("priority"), F.lit(9))
    rows = messages.withColumn("_level", level)
    counts = rows.groupBy("topic", "_level", "partition_id").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("topic").orderBy(F.desc("_level"), "partition_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("topic", "_level", "partition_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("topic", "_level", "partition_id").orderBy("offset")
    return rows.withColumn("_r", F.row_number().over(inside)).join(starts, ["topic", "_level", "partition_id"]).withColumn("place", (F.col("_start") + F.col("_r")).cast("long")).drop("_level", "_r", "_start")


def dispatch_round_robin(messages: DataFrame, consumers: list[str]) -> DataFrame:
    """Messages of a topic partition dealt to consumers in turn, without a limit on what they hold."""
    turn = (F.col("offset") % len(consumers)).cast("int")
    return messages.withColumn("consumer", F.element_at(F.array(*[F.lit(c) for c in consumers]), turn + 1))


def dispatcher(consumers: list[str], prefetch: int, priority: bool, most: dict[str, int]) -> Callable[[], Callable[[dict], Iterator[dict]]]:
    """The dispatch rule for one topic, fed its events in order: publish, ack, nack.

    A message goes to the next consumer in turn with a free slot (and, with ``priority``, whose limit
    allows it); an ack or nack frees the slot.  With none free it waits - with ``priority`` in ten
    levels, the highest first and each in order - and goes out when a slot opens.
    """

    def start() -> Callable[[dict], Iterator[dict]]:
        held = {c: 0 for c in consumers}
        owner: dict[int, str] = {}
        levels: list[list[int]] = [[] for _ in range(10)]
        turn = 0

        def give(message: int, level: int) -> str | None:
            nonlocal turn
            for k in range(len(consumers)):
                c = consumers[(turn + k) % len(consumers)]
                if held[c] < prefetch and (not priority or level <= most.get(c, 9)):
                    turn = (turn + k + 1) % len(consumers)
                    held[c] += 1
                    owner[message] = c
                    return c
            return None

        def step(row: dict) -> Iterator[dict]:
            if not row:
                return
            if row["event"] == "publish":
                levels[min(row["priority"], 9) if priority else 0].append(row["message"])
            elif row["message"] in owner:
                held[owner.pop(row["message"])] -= 1
            for level in range(9, -1, -1):
                while levels[level] and (c := give(levels[level][0], level)):
                    yield {"topic": row["topic"], "seq": row["seq"], "message": levels[level].pop(0), "consumer": c}

        return step

    return start


def dispatch(events: DataFrame, consumers: list[str], prefetch: int, priority: bool = False, most: dict[str, int] | None = None) -> DataFrame:
    """Who gets which message when (``seq`` of the event that let it go), with slots.

    ``events``: topic, seq, event (publish, ack, nack), message, priority.  A topic's queue is one
    sequence by nature; topics run side by side, and only waiting and held messages are in memory.
    """
    return fold(events, ["topic"], ["seq"], dispatcher(consumers, prefetch, priority, most or {}), "topic string, seq long, message long, consumer string")


def to_dlq(messages: DataFrame, reason: str, topic: str, at: str) -> DataFrame:
    """Copies for a dead-letter topic with the headers that tell where they come from."""
    told = F.create_map(
        F.lit("original-topic"), F.col("topic"),
        F.lit("death-reason"), F.lit(reason),
        F.lit("death-count"), F.col("nacks").cast("string"),
        F.lit("first-death-time"), F.lit(at),
        F.lit("original-routing-key"), F.col("routing_key"),
    )
    return messages.withColumn("headers", F.map_concat(F.map_filter(F.col("headers"), lambda k, _: ~F.array_contains(F.map_keys(told), k)), told)).withColumn("topic", F.lit(topic))


def depth(pending: DataFrame) -> DataFrame:
    """Pending messages of each topic."""
    return pending.groupBy("topic").agg(F.count(F.lit(1)).alias("depth"))
