"""The envelope: one row per message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Topic modes, payload encodings and source protocols, by code.
TOPIC_MODES = ("stream", "queue", "unified")
ENCODINGS = ("raw", "snappy", "zstd", "lz4")
#: Bytes that a stored message takes besides its variable parts, per header, and for a trace.
FIXED_BYTES, HEADER_BYTES, TRACE_BYTES = 64, 6, 24
MAX_MESSAGE_BYTES = 16 * 1024 * 1024
MAX_PRIORITY = 9

ENVELOPE = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition_id", T.LongType()),
        T.StructField("routing_key", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.BinaryType())),
        T.StructField("schema_id", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("priority", T.ByteType()),
        T.StructField("ttl_ns", T.LongType()),
        T.StructField("deliver_at_ns", T.LongType()),
        T.StructField("deliver_count", T.IntegerType()),
        T.StructField("max_retries", T.IntegerType()),
        T.StructField("trace_id", T.BinaryType()),
        T.StructField("span_id", T.BinaryType()),
        T.StructField("source_proto", T.StringType()),
    ]
)


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 1000


def valid_topic(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_][A-Za-z0-9._-]{0,254}$")


def valid_group(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]{1,256}$")


def valid_dlq_topic(name: Column) -> Column:
    """Dots are allowed here: dead letters keep the topic they came from."""
    return name.rlike(r"^[A-Za-z0-9._-]{1,256}$")


def valid_subject(name: Column) -> Column:
    return name.rlike(r"^(?!.*\.\.)[A-Za-z0-9_][A-Za-z0-9._-]{0,254}$")


def message_bytes(topic: Column, key: Column, payload: Column, headers: Column | None = None, traced: Column | None = None) -> Column:
    """Estimated stored size of a message."""
    size = F.lit(FIXED_BYTES) + F.octet_length(topic) + F.octet_length(key) + F.octet_length(payload)
    if headers is not None:
        each = F.transform(F.map_entries(headers), lambda e: F.lit(HEADER_BYTES) + F.octet_length(e["key"]) + F.octet_length(e["value"]))
        size = size + F.aggregate(each, F.lit(0), lambda a, x: a + x)
    if traced is not None:
        size = size + F.when(traced, TRACE_BYTES).otherwise(0)
    return size.cast("long")
