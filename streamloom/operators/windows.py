"""Windows over event time: tumbling, hopping, sliding and session, with per-window state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counted(grouped, data: str | None, order: list[str]) -> DataFrame:
    """Count, last event and, if asked for, the data in order of arrival, joined into one text."""
    aggs = [F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event")]
    if data:
        held = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(data).alias("_data"))))
        aggs.append(F.array_join(F.transform(held, lambda x: x["_data"]), "").alias("data"))
    return grouped.agg(*aggs)


def _bounds(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names)


def tumbling(df: DataFrame, size: str, keys: list[str], data: str | None = None, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Windows of ``size`` aligned to 1970; one row per window and key."""
    return _bounds(_counted(df.groupBy(F.window("ts", size), *keys), data, list(order)))


def hopping(df: DataFrame, size: str, slide: str, keys: list[str], parity: bool = False) -> DataFrame:
    """Windows every ``slide``; with ``parity`` the slide is ignored and the windows tumble."""
    return tumbling(df, size, keys) if parity else sliding(df, size, slide, keys)


def _micros(interval: str) -> int:
    n, unit = interval.split()
    each = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    return int(n) * each[unit.rstrip("s")]


def sliding(df: DataFrame, size: str, slide: str, keys: list[str]) -> DataFrame:
    """Every window [s, s + size) that holds the row, s a multiple of ``slide`` and not before 1970.

    A slide longer than the size leaves gaps: rows in them are in no window.
    """
    long, step = _micros(size), _micros(slide) or _micros(size)
    if step <= long:
        out = _bounds(_counted(df.groupBy(F.window("ts", size, slide if _micros(slide) else size), *keys), None, []))
        return out.where(F.col("window_start") >= F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    start = F.window("ts", slide)
    held = df.withColumn("_w", start).where(F.col("ts") < F.col("_w.start") + F.expr(f"interval {size}"))
    grouped = held.groupBy(F.col("_w.start").alias("window_start"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event")).select(
        "window_start", (F.col("window_start") + F.expr(f"interval {size}")).alias("window_end"), *keys, "n", "last_event"
    )


def session(df: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Sessions per key: rows at most ``gap`` apart belong together, bridging rows merge sessions."""
    out = df.groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event"))
    return out.select(F.col("session_window.start").alias("window_start"), *keys, "n", "last_event")


def fired(windows: DataFrame, now: Column) -> DataFrame:
    """Windows that have ended by ``now``."""
    return windows.where(F.col("window_end") <= now)


def still_open(windows: DataFrame, now: Column) -> DataFrame:
    return windows.where(F.col("window_end") > now)


def open_count(windows: DataFrame, now: Column) -> DataFrame:
    """The number of windows that have not ended by ``now``, whatever their keys."""
    return still_open(windows, now).agg(F.count_distinct("window_start").cast("long").alias("open_windows"))


def late(df: DataFrame, delay: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that arrive more than ``delay`` behind the newest row that came before them."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("ts").over(before)
    return df.withColumn("_newest", newest).where(F.col("ts") < F.col("_newest") - F.expr(f"interval {delay}")).drop("_newest")


def aggregate(df: DataFrame, size: str, keys: list[str], **values: Column) -> DataFrame:
    """Any aggregates over tumbling windows and keys."""
    return _bounds(df.groupBy(F.window("ts", size), *keys).agg(*[c.alias(n) for n, c in values.items()]))
