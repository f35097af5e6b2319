"""Dead letters: conditions, transforms, preview, replay and export."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import valid_dlq_topic
from ..sources.files import as_json
from .ordered import numbered

MAX_RETRIES = 3
LONGEST_PATTERN = 256

Step = Callable[[DataFrame], DataFrame]


def push(entries: DataFrame, enabled: bool = True) -> DataFrame:
    """Entries numbered from 1 within their topic, by failure time; invalid topics are passed over."""
    valid = entries.where(valid_dlq_topic(F.col("topic")) & F.lit(enabled))
    return numbered(valid, ["topic"], F.date_trunc("hour", F.col("failed_at")), ["failed_at", "event_id"], "id").withColumn("id", F.col("id") + 1)


def should_dlq(retries: Column, most: int = MAX_RETRIES) -> Column:
    return retries >= most


# ---------------------------------------------------------------- conditions


def every() -> Column:
    return F.lit(True)


def reason_is(reason: str) -> Column:
    return F.col("reason") == reason


def min_retries(n: int) -> Column:
    return F.col("retries") >= n


def failed_between(start, end) -> Column:
    """Both ends included."""
    return F.col("failed_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def reason_matches(pattern: str) -> Column:
    """A regular expression found anywhere; an empty, overlong or invalid one matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.col("reason").rlike(pattern) if 0 < len(pattern) <= LONGEST_PATTERN else F.lit(False)


def payload_contains(text: str) -> Column:
    return F.coalesce(F.contains(F.col("payload").cast("string"), F.lit(text)), F.lit(False))


def all_of(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


def parse(request: dict) -> Column:
    """A request's keys reason, min_retries, reason_pattern and payload_contains, all of which must hold."""
    made = {"reason": reason_is, "min_retries": lambda n: min_retries(int(n)), "reason_pattern": reason_matches, "payload_contains": payload_contains}
    return all_of(*[made[k](v) for k, v in request.items() if k in made and v not in (None, "", 0)])


# ---------------------------------------------------------------- transforms


def add_header(name: str, value: str) -> Step:
    return lambda d: d.withColumn("headers", F.map_concat(F.map_filter("headers", lambda k, _: k != name), F.create_map(F.lit(name), F.lit(value))))


def remove_header(name: str) -> Step:
    return lambda d: d.withColumn("headers", F.map_filter("headers", lambda k, _: k != name))


def update_payload(payload: Column) -> Step:
    return lambda d: d.withColumn("payload", payload)


def set_routing_key(key: str) -> Step:
    return lambda d: d.withColumn("routing_key", F.lit(key))


def add_metadata(at: str) -> Step:
    """Four headers that tell the entry's past; ``at`` is the time of replay."""
    told = {"dlq-id": F.col("id").cast("string"), "dlq-reason": F.col("reason"), "dlq-retries": F.col("retries").cast("string"), "dlq-replay-at": F.lit(at)}
    entries = F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)])
    return lambda d: d.withColumn("headers", F.map_concat(F.map_filter("headers", lambda k, _: ~k.isin(list(told))), entries))


def chain(*steps: Step) -> Step:
    return lambda d: functools.reduce(lambda x, f: f(x), steps, d)


# ---------------------------------------------------------------- reads and replay


def peek(dlq: DataFrame, topic: str, limit: int = 0) -> DataFrame:
    """The oldest entries of a topic; all for a limit of 0 or less."""
    rows = dlq.where(F.col("topic") == topic).orderBy("id")
    return rows.limit(limit) if limit > 0 else rows


def pop(dlq: DataFrame, topic: str, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(the oldest ``n`` entries of a topic, what stays)."""
    here = F.col("topic") == topic
    r = dlq.where(here).select(F.col("id").alias("_id")).orderBy("_id").limit(n)
    taken = dlq.where(here).join(F.broadcast(r), F.col("id") == F.col("_id"), "left_semi")
    rest = dlq.join(F.broadcast(r), here & (F.col("id") == F.col("_id")), "left_anti")
    return taken, rest


def sizes(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("topic").agg(F.count(F.lit(1)).alias("entries"))


def clear(dlq: DataFrame, topic: str) -> DataFrame:
    return dlq.where(F.col("topic") != topic)


def preview(dlq: DataFrame, topic: str, condition: Column, most: int) -> DataFrame:
    """The oldest ``most`` entries that meet the condition."""
    return dlq.where((F.col("topic") == topic) & F.coalesce(condition, F.lit(False))).orderBy("id").limit(most)


def export(dlq: DataFrame, topic: str, condition: Column, most: int) -> DataFrame:
    return as_json(preview(dlq, topic, condition, most))


@dataclass
class Replay:
    """What a replay sends, what stays, and its counts (one row)."""

    replayed: DataFrame
    remaining: DataFrame
    result: DataFrame


def replay(dlq: DataFrame, topic: str, condition: Column, most: int | None = None, target: str = "", step: Step | None = None, dry_run: bool = False, delete: bool = False, ok: Column | None = None) -> Replay:
    """Send a topic's matching entries again, the oldest ``most`` of them.

    ``ok`` says of a transformed entry whether publishing succeeds (default: its payload is not null).
    Entries that fail stay; those that succeed stay unless ``delete``.  A dry run sends nothing and
    counts all matches as skipped.
    """
    own = dlq.where(F.col("topic") == topic)
    matched = own.where(F.coalesce(condition, F.lit(False)))
    if most is not None:
        matched = matched.orderBy("id").limit(most)
    sent = (step or chain())(matched)
    sent = sent.withColumn("_ok", F.coalesce(ok if ok is not None else F.col("payload").isNotNull(), F.lit(False)))
    good = sent.where("_ok" if not dry_run else "false")
    replayed = good.withColumn("topic", F.lit(target)).drop("_ok") if target else good.drop("_ok")
    gone = good.select("id") if delete else good.select("id").where("false")
    remaining = dlq.join(gone.withColumn("topic", F.lit(topic)), ["topic", "id"], "left_anti")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    counts = sent.agg(F.count(F.lit(1)).alias("matched"), n(F.col("_ok") & F.lit(not dry_run)).alias("replayed"), n(~F.col("_ok") & F.lit(not dry_run)).alias("failed"))
    total = own.agg(F.count(F.lit(1)).alias("total"))
    result = total.crossJoin(counts).withColumn("skipped", F.when(F.lit(dry_run), F.col("matched")).otherwise(F.lit(0).cast("long")))
    return Replay(replayed, remaining, result)
