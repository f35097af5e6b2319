"""Windowed joins of two message streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import whole
from .ordered import fold, numbered, segments

HOUR_NS = 3_600_000_000_000


def interval_join(left: DataFrame, right: DataFrame, key: str, within_ns: int, names: tuple[str, str] = ("left_id", "right_id")) -> DataFrame:
    """All pairs of equal key whose times differ by ``within_ns`` at most (both ends included).

    Both sides are dealt into buckets of that width first, a row of the right into its own and the two
    beside it, so a hot key is joined bucket by bucket and not as a whole.
    """
    a, b = names
    wide = max(1, within_ns)
    l = left.select(F.col(key).alias("key"), F.col("id").alias(a), F.col("ts_ns").alias("lt"), whole(F.col("ts_ns"), wide).alias("bucket"))
    r = right.select(F.col(key).alias("key"), F.col("id").alias(b), F.col("ts_ns").alias("rt"), whole(F.col("ts_ns"), wide).alias("own"))
    r = r.select("key", b, "rt", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)).alias("bucket"))
    return l.join(r, ["key", "bucket"]).where(F.abs(F.col("lt") - F.col("rt")) <= within_ns).select("key", a, b, "lt", "rt")


def pair_nth(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One-to-one pairing in order of arrival without a window: the n-th left with the n-th right of a key.

    Rows are numbered by hour of ``order``'s first column (nanoseconds or a timestamp), so a hot key is
    never sorted whole, and the join's key holds the number."""

    def placed(d: DataFrame, name: str) -> DataFrame:
        time = F.col(order[0])
        bucket = whole(time, HOUR_NS) if d.schema[order[0]].dataType.simpleString() == "bigint" else F.date_trunc("hour", time)
        return numbered(d.withColumn("_key", F.col(key)), ["_key"], bucket, order, "n").select(F.col("_key").alias("key"), F.col("id").alias(name), "n")

    return placed(left, "left_id").join(placed(right, "right_id"), ["key", "n"]).select("key", "left_id", "right_id")


def greedy(within_ns: int) -> Callable[[dict], Iterator[dict]]:
    """The pairing rule for one key: an arriving row takes the earliest waiting row of the other side
    that is ``within_ns`` away at most; both are used up.  Else it waits.  Each row is put in and taken out
    of a queue once."""
    waiting: dict[str, deque[dict]] = {"L": deque(), "R": deque()}

    def alone(r: dict) -> dict:
        return {"key": r["key"], "left_id": r["id"] if r["side"] == "L" else None, "right_id": r["id"] if r["side"] == "R" else None}

    def step(row: dict) -> Iterator[dict]:
        if not row:
            yield from map(alone, [*waiting["L"], *waiting["R"]])
            return
        # rows arrive in time order: those too old for this one are too old for all that follow
        for side in waiting.values():
            while side and row["ts_ns"] - side[0]["ts_ns"] > within_ns:
                yield alone(side.popleft())
        other = waiting["R" if row["side"] == "L" else "L"]
        if not other:
            waiting[row["side"]].append(row)
            return
        r = other.popleft()
        pair = (row, r) if row["side"] == "L" else (r, row)
        yield {"key": row["key"], "left_id": pair[0]["id"], "right_id": pair[1]["id"]}

    return step


def pair_join(left: DataFrame, right: DataFrame, key: str, within_ns: int) -> DataFrame:
    """Greedy one-to-one join: key, left_id, right_id; a row left alone has null for the other side.

    Sides need id and ts_ns; arrival order is time, then side, then id.  A key's rows are cut where
    nothing came for longer than the window, so a hot key is not one task's work.
    """
    sides = [d.select(F.col(key).alias("key"), F.col("id").cast("long").alias("id"), F.col("ts_ns").cast("long").alias("ts_ns"), F.lit(s).alias("side")) for d, s in ((left, "L"), (right, "R"))]
    both = segments(sides[0].unionByName(sides[1]), ["key"], "ts_ns", within_ns)
    return fold(both, ["key", "_segment"], ["ts_ns", "side", "id"], lambda: greedy(within_ns), "key string, left_id long, right_id long")


def unmatched(pairs: DataFrame, side: str) -> DataFrame:
    """Rows of one side (``left`` or ``right``) that found no partner."""
    other = "right_id" if side == "left" else "left_id"
    return pairs.where(F.col(other).isNull()).select("key", F.col(f"{side}_id").alias("id"))


def buffer_sizes(pairs: DataFrame) -> DataFrame:
    """How many rows wait on each side."""
    return pairs.agg(F.count_if(F.col("right_id").isNull()).alias("left_waiting"), F.count_if(F.col("left_id").isNull()).alias("right_waiting"))


def expired(buffered: DataFrame, now_ns: int, within_ns: int) -> DataFrame:
    """Waiting rows too old to be paired any more."""
    return buffered.where(F.lit(now_ns) - F.col("ts_ns") > within_ns)
