"""Continuous forms: windows under a watermark, and stateful pairing, deduplication and key-value state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(df: DataFrame, delay: str, column: str = "ts") -> DataFrame:
    """A stream with a watermark; event times without a zone are read as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling_counts(stream: DataFrame, size: str, keys: list[str], delay: str) -> DataFrame:
    """Append mode: a window comes out once, when the watermark has passed its end."""
    out = event_time(stream, delay).groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", F.col("last_event").cast("timestamp_ntz").alias("last_event"))


def session_counts(stream: DataFrame, gap: str, keys: list[str], delay: str) -> DataFrame:
    out = event_time(stream, delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_event"))
    return out.select(F.col("session_window.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", F.col("last_event").cast("timestamp_ntz").alias("last_event"))


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, delay: str) -> DataFrame:
    """All pairs within ``within`` of each other; state is dropped once no partner can come."""
    l = event_time(left, delay).select(F.col(key).alias("key"), F.col("id").alias("left_id"), F.col("ts").alias("lt"))
    r = event_time(right, delay).select(F.col(key).alias("rkey"), F.col("id").alias("right_id"), F.col("ts").alias("rt"))
    near = F.expr(f"key = rkey and rt between lt - interval {within} and lt + interval {within}")
    return l.join(r, near).select("key", "left_id", "right_id")


class _Anchored(StatefulProcessor):
    """Accepts a sighting unless it comes less than the window after the last accepted one."""

    def __init__(self, window_ns: int):
        self.window_ns = window_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "ts_ns long", 2 * self.window_ns // 1_000_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["ts_ns", "id"])
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        kept = []
        for row in found.itertuples(index=False):
            if anchor is None or row.ts_ns - anchor >= self.window_ns:
                anchor = int(row.ts_ns)
                kept.append((key[0], int(row.id), anchor))
        if kept:
            self.anchor.update((anchor,))
            yield pd.DataFrame(kept, columns=["key", "id", "ts_ns"])

    def close(self) -> None:
        pass


def dedup(stream: DataFrame, window_ns: int) -> DataFrame:
    """Anchored deduplication of (key, id, ts_ns): exact, also within a micro-batch."""
    ship(stream.sparkSession)
    return stream.groupBy("key").transformWithStateInPandas(_Anchored(window_ns), "key string, id long, ts_ns long", "Append", "None")


class _Pairing(StatefulProcessor):
    """Pairs an arriving row with the earliest one waiting on the other side within the window.

    With ``ttl_ms`` what waits expires so long after its key's last arrival, also if the key never returns."""

    def __init__(self, within_ns: int, ttl_ms: int | None):
        self.within_ns, self.ttl_ms = within_ns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "side string, id long, ts_ns long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        pairs = []
        for row in pd.concat(list(rows)).sort_values(["ts_ns", "side", "id"]).itertuples(index=False):
            for i, (side, other, at) in enumerate(held):
                if side != row.side and abs(at - row.ts_ns) <= self.within_ns:
                    pairs.append((key[0], int(row.id), other) if row.side == "L" else (key[0], other, int(row.id)))
                    del held[i]
                    break
            else:
                held = [h for h in held if row.ts_ns - h[2] <= self.within_ns]
                held.append((row.side, int(row.id), int(row.ts_ns)))
        self.waiting.put(held) if held else self.waiting.clear()
        if pairs:
            yield pd.DataFrame(pairs, columns=["key", "left_id", "right_id"])

    def close(self) -> None:
        pass


def pair_join(stream: DataFrame, within_ns: int, ttl_ms: int | None = None) -> DataFrame:
    """Greedy one-to-one pairing of one stream of both sides: key, side (L or R), id, ts_ns.

    With ``ttl_ms`` state is let go of by the clock so long after it was written, so a key that never pairs
    leaves nothing behind: for streams without an end, run by a processing-time trigger (a run over what is
    available never ends under the clock's mode, and needs no expiry).
    """
    ship(stream.sparkSession)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return stream.groupBy("key").transformWithStateInPandas(_Pairing(within_ns, ttl_ms), "key string, left_id long, right_id long", "Append", mode)


class _Store(StatefulProcessor):
    """A value per key; a null value is a tombstone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("version").iloc[-1]
        if last["value"] is None or pd.isna(last["value"]):
            self.value.clear()
        else:
            self.value.update((str(last["value"]),))
        yield pd.DataFrame([(key[0], self.value.get()[0] if self.value.exists() else None)], columns=["key", "value"])

    def close(self) -> None:
        pass


def key_values(stream: DataFrame) -> DataFrame:
    """The state of each key after every change to it: puts and deletes (key, value, version)."""
    ship(stream.sparkSession)
    return stream.groupBy("key").transformWithStateInPandas(_Store(), "key string, value string", "Update", "None")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what there is into an in-memory table and end; for tests and small checks."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_topic(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a stored topic; progress is kept in the checkpoint."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def late_split(df: DataFrame, newest: Column, delay: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late) by a known newest event time."""
    behind = F.col("ts") < newest - F.expr(f"interval {delay}")
    return df.where(~behind), df.where(behind)
