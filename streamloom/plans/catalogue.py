"""The query catalogue: each operator over the test tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, keys, matchers
from ..operators import dlq, groups, guard, joins, maintenance, metrics, queues, registry, replicas, routing, topology, windows
from ..plans.publish import Rules, batch_status, publish
from ..schema import epoch_ns, message_bytes, valid_dlq_topic, valid_group, valid_subject, valid_topic
from ..sources import files, messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A moment within the data, where a rule needs a clock: 2024-01-20, in nanoseconds.
NOW = 1_705_708_800_000_000_000
MINUTE, HOUR, DAY = 60_000_000_000, 3_600_000_000_000, 86_400_000_000_000


def query(sql: str | None = None):
    """Register a query under its function's name; ``{log}`` and the like stand for shared tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _expand(sql)
        return f

    return add


# ---------------------------------------------------------------- shared tables in SQL

_M = 2**32


def _murmur_sql() -> str:
    """CTEs that end in ``hashed(k, h)``: murmur3 of the distinct user ids (ASCII, up to 11 characters)."""
    steps = ["m0 as (select distinct cast(user_id as varchar) as k from events)", "m1 as (select k, length(k) as n, [ascii(substr(k, i, 1))::hugeint for i in range(1, length(k) + 1)] as b, 0::hugeint as h from m0)"]
    last = "m1"
    for j in range(3):
        at = f"{4 * j}"
        # blocks 0 and 1, then the tail, wherever it begins
        if j == 2:
            at = "(n // 4) * 4"
        block = " + ".join(f"coalesce(b[{at} + {i + 1}], 0) * {256**i}" for i in range(4))
        cond = f"n >= {4 * j + 4}" if j < 2 else "n % 4 > 0"
        steps.append(f"x{j} as (select *, (({block}) * {hashing.C1}) % {_M} as x from {last})")
        steps.append(f"y{j} as (select *, (((x * 32768) % {_M} + x // 131072) * {hashing.C2}) % {_M} as y from x{j})")
        steps.append(f"z{j} as (select k, n, b, h as h0, xor(h::bigint, y::bigint)::hugeint as z from y{j})")
        new = f"(((z * 8192) % {_M} + z // 524288) * {hashing.FIVE} + {hashing.ADD}) % {_M}" if j < 2 else "z"
        steps.append(f"h{j} as (select k, n, b, case when {cond} then {new} else h0 end as h from z{j})")
        last = f"h{j}"
    steps.append("f0 as (select k, xor(h::bigint, n::bigint)::hugeint as h from h2)")
    steps.append(f"f1 as (select k, (xor(h::bigint, (h // 65536)::bigint)::hugeint * {hashing.MIX1}) % {_M} as h from f0)")
    steps.append(f"f2 as (select k, (xor(h::bigint, (h // 8192)::bigint)::hugeint * {hashing.MIX2}) % {_M} as h from f1)")
    steps.append("hashed as (select k, xor(h::bigint, (h // 65536)::bigint) as h from f2)")
    return ", ".join(steps)


_MSG = """msg as (select event_id, ts, epoch_us(ts) * 1000 as ts_ns, 'events.' || event_type as topic, cast(user_id as varchar) as routing_key,
  props as payload, value, user_id, event_type, event_id % 10 as priority, case when event_id % 3 = 0 then 86400000000000 else 0 end as ttl_ns,
  case when event_id % 5 = 0 then epoch_us(ts) * 1000 + 3600000000000 else 0 end as deliver_at_ns, event_id % 4 as max_retries from events)"""
_LOG = f"""{_MSG}, {_murmur_sql()}, placed as (select msg.*, h % 8 as partition_id from msg join hashed on routing_key = k),
log as (select *, row_number() over (partition by topic, partition_id order by ts, event_id) - 1 as "offset" from placed)"""
_DLQ = """dead as (select event_id, 'events.' || event_type as topic, case event_id % 3 when 0 then 'timeout' when 1 then 'validation failed' else 'connection reset' end as reason,
  event_id % 6 as retries, ts as failed_at, cast(user_id as varchar) as routing_key, props as payload from events where event_id % 4 = 0),
dlq as (select *, row_number() over (partition by topic order by failed_at, event_id) as id from dead)"""
_DELIVERIES = """deliveries as (select topic, partition_id, "offset", 'deliver' as event, ts_ns as at_ns from log
  union all select topic, partition_id, "offset", 'ack', ts_ns + 10000000000 from log where event_id % 2 = 0
  union all select topic, partition_id, "offset", 'nack', ts_ns + n * 1000000000 from log, unnest(range(1, event_id % 4 + 1)) u(n) where event_id % 2 = 1),
pending as (select topic, partition_id, "offset", max(case when event = 'deliver' then at_ns end) as delivered_ns, count(*) filter (event = 'nack') as nacks
  from deliveries group by all having count(*) filter (event = 'ack') = 0)"""


def _expand(sql: str) -> str:
    for name, text in (("{log}", _LOG), ("{msg}", _MSG), ("{dlq}", _DLQ), ("{deliveries}", _DELIVERIES)):
        sql = sql.replace(name, text)
    return sql


# ---------------------------------------------------------------- shared tables in Spark


def _msg(spark: SparkSession, sf: str) -> DataFrame:
    return messages.from_events(messages.table(spark, sf, "events"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return messages.log(spark, sf)


def _dlq(spark: SparkSession, sf: str) -> DataFrame:
    e = messages.table(spark, sf, "events").where("event_id % 4 = 0")
    reason = F.when(F.col("event_id") % 3 == 0, "timeout").when(F.col("event_id") % 3 == 1, "validation failed").otherwise("connection reset")
    entries = e.select(
        "event_id",
        F.concat(F.lit("events."), "event_type").alias("topic"),
        reason.alias("reason"),
        (F.col("event_id") % 6).alias("retries"),
        F.col("ts").alias("failed_at"),
        F.col("user_id").cast("string").alias("routing_key"),
        F.col("props").alias("payload"),
        F.create_map(F.lit("user-id"), F.col("user_id").cast("string")).alias("headers"),
    )
    return dlq.push(entries)


def _deliveries(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).select("topic", "partition_id", "offset", "ts_ns", "event_id")
    made = F.filter(
        F.array(
            F.struct(F.lit("deliver").alias("event"), F.col("ts_ns").alias("at_ns")),
            F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("ack").alias("event"), (F.col("ts_ns") + 10_000_000_000).alias("at_ns"))),
            *[F.when((F.col("event_id") % 2 == 1) & (F.col("event_id") % 4 >= n), F.struct(F.lit("nack").alias("event"), (F.col("ts_ns") + n * 1_000_000_000).alias("at_ns"))) for n in (1, 2, 3)],
        ),
        lambda x: x.isNotNull(),
    )
    return log.select("topic", "partition_id", "offset", F.explode(made).alias("e")).select("topic", "partition_id", "offset", "e.event", "e.at_ns")


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return messages.table(spark, sf, "supplier").select(F.concat(F.lit("g"), F.col("s_nationkey") % 4).alias("group"), F.col("s_name").alias("member"))


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).where("event_id % 7 = 0").select(F.concat(F.lit("g"), F.col("user_id") % 3).alias("group"), "topic", "partition_id", "offset", F.col("ts_ns").alias("at_ns"))


def _headers() -> Column:
    return F.create_map(F.lit("format"), F.when(F.col("event_id") % 2 == 0, "json").otherwise("xml"), F.lit("type"), F.col("event_type"))


# ---------------------------------------------------------------- windows


@query("select 'events.' || event_type as topic, time_bucket(interval '1 hour', ts) as window_start, count(*) as n, max(ts) as last_event from events group by all")
def tumbling_count_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(_msg(spark, sf), "1 hour", ["topic"]).select("topic", "window_start", "n", "last_event")


@query("select 'events.' || event_type as topic, time_bucket(interval '1 hour', ts) as window_start, count(*) as n from events group by all")
def hopping_parity(spark: SparkSession, sf: str) -> DataFrame:
    return windows.hopping(_msg(spark, sf), "1 hour", "20 minutes", ["topic"], parity=True).select("topic", "window_start", "n")


@query("""select event_type, w as window_start, count(*) as n, max(ts) as last_event from events,
unnest(generate_series(time_bucket(interval '15 minutes', ts) - interval '45 minutes', time_bucket(interval '15 minutes', ts), interval '15 minutes')) u(w) group by all""")
def sliding_count(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding(_msg(spark, sf), "1 hour", "15 minutes", ["event_type"]).select("event_type", "window_start", "n", "last_event")


@query("""select event_type, time_bucket(interval '1 hour', ts) as window_start, count(*) as n from events
where ts < time_bucket(interval '1 hour', ts) + interval '20 minutes' group by all""")
def sliding_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding(_msg(spark, sf), "20 minutes", "1 hour", ["event_type"]).select("event_type", "window_start", "n")


@query("""with a as (select user_id, ts, event_id, case when ts - lag(ts) over w > interval '30 minutes' then 1 else 0 end as brk from events window w as (partition by user_id order by ts, event_id)),
b as (select *, sum(brk) over (partition by user_id order by ts, event_id) as s from a)
select user_id, min(ts) as window_start, count(*) as n, max(ts) as last_event from b group by user_id, s""")
def session_count(spark: SparkSession, sf: str) -> DataFrame:
    return windows.session(_msg(spark, sf), "30 minutes", ["user_id"]).select("user_id", "window_start", "n", "last_event")


@query("""select user_id, time_bucket(interval '1 day', ts) as window_start, count(*) as n, string_agg(event_type, '' order by ts, event_id) as data, max(ts) as last_event from events group by all""")
def window_concat(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(_msg(spark, sf), "1 day", ["user_id"], data="event_type").select("user_id", "window_start", "n", "data", "last_event")


@query("""with w as (select 'events.' || event_type as topic, time_bucket(interval '1 hour', ts) as window_start, count(*) as n from events group by 1, 2)
select * from w where window_start + interval '1 hour' <= timestamp '2024-01-20'""")
def windows_fired(spark: SparkSession, sf: str) -> DataFrame:
    w = windows.tumbling(_msg(spark, sf), "1 hour", ["topic"])
    return windows.fired(w, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("topic", "window_start", "n")


@query("select count(distinct time_bucket(interval '1 hour', ts)) as open_windows from events where time_bucket(interval '1 hour', ts) + interval '1 hour' > timestamp '2024-01-20'")
def open_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.open_count(windows.tumbling(_msg(spark, sf), "1 hour", ["topic"]), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("""select event_id from (select event_id, ts, max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as newest from events)
where ts < newest - interval '1 hour'""")
def late_events(spark: SparkSession, sf: str) -> DataFrame:
    return windows.late(_msg(spark, sf), "1 hour", ["user_id"], ["event_id"]).select("event_id")


@query("""select user_id, time_bucket(interval '1 day', ts) as window_start, sum((value * 100)::bigint)::bigint as cents, min(value) as least, max(value) as greatest, count(*) as n from events group by all""")
def window_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100, 0).cast("long")
    out = windows.aggregate(_msg(spark, sf), "1 day", ["user_id"], cents=F.sum(cents), least=F.min("value"), greatest=F.max("value"), n=F.count(F.lit(1)))
    return out.drop("window_end")


# ---------------------------------------------------------------- topologies and reads


@query("select event_id, 'events.' || event_type as topic, value from events where event_type = 'click' and value > 50")
def topology_filter(spark: SparkSession, sf: str) -> DataFrame:
    return topology.Topology("t").source("events.click").filter(F.col("value") > 50).build(_msg(spark, sf)).select("event_id", "topic", "value")


@query("select event_id, json_extract_string(props, '$.k')::bigint * 2 as payload from events where event_type = 'view' and json_extract_string(props, '$.k')::bigint >= 10")
def topology_map_payload(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("payload", "$.k").cast("bigint")
    return topology.Topology("t").source("events.view").map({"payload": k * 2}, keep=k >= 10).build(_msg(spark, sf)).select("event_id", "payload")


@query("select p_partkey, word from part, unnest(string_split(p_type, ' ')) u(word)")
def topology_flatmap(spark: SparkSession, sf: str) -> DataFrame:
    return topology.flat_map(messages.table(spark, sf, "part"), "word", F.split("p_type", " ")).select("p_partkey", "word")


@query("""with {msg}, {murmur}, t as (select msg.*, h % 8 as partition_id from msg join hashed on routing_key = k where topic = 'events.purchase' and value > 20)
select event_id, 'big' as topic, partition_id, row_number() over (partition by partition_id order by ts, event_id) - 1 as "offset" from t""".replace("{murmur}", _murmur_sql()))
def topology_chain_to_sink(spark: SparkSession, sf: str) -> DataFrame:
    t = topology.Topology("t").source("events.purchase").filter(F.col("value") > 20).named("no such transform").sink("big")
    return t.run_batch(_msg(spark, sf)).select("event_id", "topic", "partition_id", "offset")


@query("""select case when json_extract_string(props, '$.k')::bigint % 5 = 0 then 'dlq' when json_extract_string(props, '$.k')::bigint % 7 = 0 then 'dropped' else 'ok' end as outcome, count(*) as n from events
where not (json_extract_string(props, '$.k')::bigint % 5 <> 0 and json_extract_string(props, '$.k')::bigint % 7 = 0) group by all""")
def ingest_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("payload", "$.k").cast("bigint")
    out = topology.staged_payload(_msg(spark, sf), [(k % 5 != 0, k % 7 == 0, F.upper("payload")), (F.lit(True), F.lit(False), F.lower("payload"))], policy=topology.DEAD_LETTER)
    return out["ok"].groupBy(F.lit("ok").alias("outcome")).agg(F.count(F.lit(1)).alias("n")).unionByName(out["dlq"].groupBy(F.lit("dlq").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


@query("""with {log} select "offset", event_id, ts from log where topic = 'events.click' and partition_id = 3 and "offset" between 10 and 400 order by "offset" limit 100""")
def fetch_range(spark: SparkSession, sf: str) -> DataFrame:
    return messages.read_range(_log(spark, sf), "events.click", 3, 10, 400, 100).select("offset", "event_id", "ts")


@query("""with {log} select event_id, ts, payload from log where topic = 'events.view' and partition_id = 1 and "offset" = 7""")
def point_read(spark: SparkSession, sf: str) -> DataFrame:
    return messages.read_at(_log(spark, sf), "events.view", 1, 7).select("event_id", "ts", "payload")


@query("""with {log}, r as (select "offset", event_id from log where topic = 'events.view' and partition_id = 0 and "offset" >= 5 order by "offset" limit 100)
select *, max("offset") over () + 1 as next_offset from r""")
def fetch_page(spark: SparkSession, sf: str) -> DataFrame:
    return messages.fetch(_log(spark, sf), "events.view", 0, 5).select("offset", "event_id", "next_offset")


@query("select s_name from supplier order by s_name limit 25 offset 10")
def listing_page(spark: SparkSession, sf: str) -> DataFrame:
    return messages.listing(messages.table(spark, sf, "supplier").select("s_name"), "s_name", 10, 25)


@query("""with {log} select topic, partition_id, count(*) as n from log where topic = 'events.click' and partition_id in (1, 4) group by all""")
def topic_source_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return messages.topic_source(_log(spark, sf), "events.click", [1, 4]).groupBy("topic", "partition_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- partitions


@query("""with {murmur} select k as routing_key, h as hash, h % 8 as partition_id from hashed""".replace("{murmur}", _murmur_sql()))
def partition_by_key(spark: SparkSession, sf: str) -> DataFrame:
    k = messages.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("routing_key")).distinct()
    return k.select("routing_key", hashing.murmur3(F.col("routing_key")).alias("hash"), hashing.partition_for(F.col("routing_key"), 8).cast("long").alias("partition_id"))


@query("""select event_id, (row_number() over (partition by event_type order by ts, event_id) - 1) % 4 as partition_id from events""")
def partition_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return messages.round_robin(_msg(spark, sf), 4).select("event_id", "partition_id")


@query("""with {log} select topic, partition_id, min("offset") as log_start, max("offset") as high_watermark, count(*) as n from log group by all""")
def watermarks_per_partition(spark: SparkSession, sf: str) -> DataFrame:
    return messages.watermarks(_log(spark, sf))


@query("""with {log} select event_id, topic, partition_id, "offset" from log""")
def assign_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("event_id", "topic", "partition_id", "offset")


# ---------------------------------------------------------------- routing

_PART_KEY = "replace(lower(p_type), ' ', '.')"
_TOPIC_RULES = [("first", "*.*.steel"), ("wild", "promo.#"), ("all", "#"), ("tail", "#.brass"), ("mid", "*.plated.#"), ("none", "promo.*"), ("first", "*.*.steel")]
_VALUES = ", ".join(f"('{d}', '{k}')" for d, k in _TOPIC_RULES)
_REGEX = ", ".join(f"('{d}', '{matchers.topic_regex(k)}')" for d, k in _TOPIC_RULES)


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return messages.table(spark, sf, "part").select("p_partkey", F.replace(F.lower("p_type"), F.lit(" "), F.lit(".")).alias("routing_key"))


def _rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "destination string, binding_key string")


@query("""select event_id, d as destination from events join (values ('q1', 'click'), ('q2', 'purchase'), ('q3', 'purchase'), ('q3', 'purchase')) b(d, k) on event_type = k""")
def route_direct(spark: SparkSession, sf: str) -> DataFrame:
    m = messages.table(spark, sf, "events").select("event_id", F.col("event_type").alias("routing_key"))
    return routing.route(m, _rules(spark, [("q1", "click"), ("q2", "purchase"), ("q3", "purchase"), ("q3", "purchase")]), "direct").select("event_id", "destination")


@query(f"select p_partkey, d as destination from part join (values {_REGEX}) b(d, r) on regexp_matches({_PART_KEY} || '.', r)")
def route_topic(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route(_parts(spark, sf), _rules(spark, _TOPIC_RULES), "topic").select("p_partkey", "destination")


@query("select event_id, d as destination from events, (values ('a'), ('b')) b(d) where event_type = 'error'")
def route_fanout(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).where("event_type = 'error'")
    return routing.route(m, _rules(spark, [("a", ""), ("b", "")]), "fanout").select("event_id", "destination")


def _header_rules(spark: SparkSession, kind: str) -> DataFrame:
    rules = [("d1", {"x-match": kind, "format": "json", "type": "click"}), ("d2", {"x-match": kind, "format": "xml"}), ("d3", {}), ("d4", {"x-match": kind})]
    return spark.createDataFrame(rules, "destination string, args map<string,string>")


@query("""select event_id, d as destination from events, (values ('d1'), ('d2'), ('d3'), ('d4')) b(d) where case d when 'd1' then event_id % 2 = 0 and event_type = 'click' when 'd2' then event_id % 2 = 1 else true end""")
def route_headers_all(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).withColumn("headers", _headers())
    return routing.route(m, _header_rules(spark, "all"), "headers").select("event_id", "destination")


@query("""select event_id, d as destination from events, (values ('d1'), ('d2'), ('d3'), ('d4')) b(d) where case d when 'd1' then event_id % 2 = 0 or event_type = 'click' when 'd2' then event_id % 2 = 1 when 'd3' then true else false end""")
def route_headers_any(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).withColumn("headers", _headers())
    return routing.route(m, _header_rules(spark, "any"), "headers").select("event_id", "destination")


@query(f"select p_partkey, count(d) as published from part left join (values {_REGEX.replace(chr(94) + '(?:[^.]*' + chr(92) + '.)*$', '^never$')}) b(d, r) on regexp_matches({_PART_KEY} || '.', r) group by all")
def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = _parts(spark, sf)
    return routing.published(parts, routing.route(parts, _rules(spark, [r for r in _TOPIC_RULES if r[1] != "#"]), "topic"), "p_partkey")


_FILTERS = ["events/+", "events/#", "+/click", "#", "events/click/#", "events/+/#"]


@query("select event_id, f as filter from events join (values " + ", ".join(f"('{f}', '{matchers.mqtt_regex(f)}')" for f in _FILTERS) + ") b(f, r) on regexp_matches('events/' || event_type || '/', r)")
def mqtt_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).withColumn("topic", matchers.to_mqtt_topic(F.col("topic")))
    return routing.subscriptions(m, spark.createDataFrame([(f,) for f in _FILTERS], "filter string")).select("event_id", "filter")


@query("""with {msg}, m as (select user_id, case when event_id % 11 = 0 then '' else payload end as payload, ts, event_id from msg),
l as (select user_id, max_by(payload, (ts, event_id)) as payload from m group by user_id) select 'u/' || user_id as topic, payload from l where payload <> ''""")
def retained_latest(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).select(F.concat(F.lit("u/"), "user_id").alias("topic"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("payload")).alias("payload"), F.struct("ts", "event_id").alias("at"))
    return routing.retained(m, "at")


_ACL = [("user7", "topic", "events.*", "read", "allow"), ("admin", "topic", "*", "all", "allow"), ("*", "topic", "events.view", "read", "allow"), ("user7", "topic", "events.purchase", "all", "deny"), ("*", "topic", "events.e?ror", "write", "deny")]


@query("""with q as (select event_id, 'user' || user_id as u, case when user_id % 10 = 0 then 'admin' else 'guest' end as r, 'events.' || event_type as t, case when event_id % 2 = 0 then 'read' else 'write' end as o from events),
a as (select * from (values """ + ", ".join(f"('{p}', '{n}', '{o}', '{x}')" for p, _, n, o, x in _ACL) + """) v(p, n, o, x)),
m as (select event_id, bool_or(x = 'deny') as d, bool_or(x = 'allow') as w from q join a on (p in (u, r) or p = '*') and (a.o = q.o or a.o = 'all') and t glob n group by event_id)
select q.event_id, case when coalesce(d, false) then false else coalesce(w, false) end as allowed from q left join m using (event_id)""")
def acl_check(spark: SparkSession, sf: str) -> DataFrame:
    q = _msg(spark, sf).select(
        "event_id",
        F.concat(F.lit("user"), "user_id").alias("user"),
        F.when(F.col("user_id") % 10 == 0, "admin").otherwise("guest").alias("role"),
        F.lit("topic").alias("resource_type"),
        F.col("topic").alias("resource"),
        F.when(F.col("event_id") % 2 == 0, "read").otherwise("write").alias("operation"),
    )
    acl = spark.createDataFrame(_ACL, "principal string, resource_type string, resource_name string, operation string, permission string")
    return routing.acl_check(q, acl, "event_id")


@query("select event_id from events where event_type in ('click', 'view', 'error') and event_type <> 'error'")
def geo_topics(spark: SparkSession, sf: str) -> DataFrame:
    return routing.geo_filter(_msg(spark, sf), ["events.click", "events.view", "events.error"], ["events.error"]).select("event_id")


_TENANTS = [("all", "events."), ("p", "events.p"), ("purchase", "events.purchase"), ("other", "orders.")]
_TENANT_SQL = "case when event_type = 'purchase' then 'purchase' when event_type like 'p%' then 'p' else 'all' end"


@query(f"""select {_TENANT_SQL} as tenant, count(*) as messages, sum(case when event_id % 2 = 0 then strlen(props) else 0 end)::bigint as bytes_in, sum(case when event_id % 2 = 1 then strlen(props) else 0 end)::bigint as bytes_out,
count(*) filter (event_id % 2 = 0) as publishes, count(*) filter (event_id % 2 = 1) as fetches, max(ts) as last_activity from events group by all""")
def tenant_usage(spark: SparkSession, sf: str) -> DataFrame:
    m = routing.tenant_of(_msg(spark, sf), spark.createDataFrame(_TENANTS, "tenant string, prefix string"))
    return metrics.usage(m, ["tenant"], F.octet_length("payload"), F.col("event_id") % 2 == 0)


@query("select c_custkey, case c_nationkey % 4 when 0 then c_mktsegment <> 'BUILDING' when 1 then c_mktsegment in ('AUTOMOBILE', 'MACHINERY') when 2 then true else false end as allowed from customer")
def namespace_access(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("t0", [], ["BUILDING"]), ("t1", ["AUTOMOBILE", "MACHINERY"], []), ("t2", [], [])], "tenant string, allowed_namespaces array<string>, blocked_namespaces array<string>")
    q = messages.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("t"), F.col("c_nationkey") % 4).alias("tenant"), F.col("c_mktsegment").alias("namespace"))
    return routing.namespace_access(q, rules).select("c_custkey", "allowed")


@query("select url, replace(url, '/', '.') as topic, replace(replace(url, '/', '.'), '.', '/') as back from pages")
def mqtt_topic_names(spark: SparkSession, sf: str) -> DataFrame:
    t = messages.table(spark, sf, "pages").select("url", matchers.to_log_topic(F.col("url")).alias("topic"))
    return t.withColumn("back", matchers.to_mqtt_topic(F.col("topic")))


_NAMES = ["orders", "a.b-c_d", ".hidden", "-x", "", "ü", "x" * 255, "x" * 256, "a..b", "dots.in.dlq", "with space"]


@query("select n as name, regexp_full_match(n, '[A-Za-z0-9_][A-Za-z0-9._-]{0,254}') as topic, regexp_full_match(n, '[A-Za-z0-9_-]{1,256}') as grp, regexp_full_match(n, '[A-Za-z0-9._-]{1,256}') as dlq, regexp_full_match(n, '[A-Za-z0-9_][A-Za-z0-9._-]{0,254}') and not contains(n, '..') as subject from (values " + ", ".join(f"('{n}')" for n in _NAMES) + ") v(n)")
def valid_names(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.createDataFrame([(x,) for x in _NAMES], "name string")
    c = F.col("name")
    return n.select("name", valid_topic(c).alias("topic"), valid_group(c).alias("grp"), valid_dlq_topic(c).alias("dlq"), valid_subject(c).alias("subject"))


@query("select doc_id from documents where strlen(text) > 4096")
def too_large(spark: SparkSession, sf: str) -> DataFrame:
    return messages.table(spark, sf, "documents").where(F.octet_length("text") > 4096).select("doc_id")


# ---------------------------------------------------------------- joins


def _side(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    e = messages.table(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("routing_key"), epoch_ns(F.col("ts")).alias("ts_ns"), "props", "ts")


_SIDES = "l as (select event_id as id, user_id, props, epoch_us(ts) * 1000 as ts_ns, ts from events where event_type = 'click'), r as (select event_id as id, user_id, props, epoch_us(ts) * 1000 as ts_ns, ts from events where event_type = 'purchase')"


@query(f"with {_SIDES} select l.user_id::varchar as key, l.id as left_id, r.id as right_id from l join r on l.user_id = r.user_id and abs(l.ts_ns - r.ts_ns) <= 21600000000000")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    return joins.interval_join(_side(spark, sf, "click"), _side(spark, sf, "purchase"), "routing_key", 6 * HOUR).select("key", "left_id", "right_id")


@query(f"""with {_SIDES}, a as (select *, row_number() over (partition by user_id order by ts_ns, id) as n from l), b as (select *, row_number() over (partition by user_id order by ts_ns, id) as n from r)
select a.user_id::varchar as key, a.id as left_id, b.id as right_id from a join b using (user_id, n)""")
def pair_join_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    return joins.pair_nth(_side(spark, sf, "click"), _side(spark, sf, "purchase"), "routing_key", ["ts_ns", "id"])


@query()
def pair_join_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return joins.pair_join(_side(spark, sf, "click"), _side(spark, sf, "purchase"), "routing_key", 6 * HOUR).where("left_id is not null and right_id is not null")


@query()
def join_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return joins.unmatched(joins.pair_join(_side(spark, sf, "click"), _side(spark, sf, "purchase"), "routing_key", 6 * HOUR), "left")


@query(f"""with {_SIDES}, n as (select user_id, (select count(*) from l where l.user_id = u.user_id) as a, (select count(*) from r where r.user_id = u.user_id) as b from (select distinct user_id from events) u)
select sum(greatest(a - b, 0))::bigint as left_waiting, sum(greatest(b - a, 0))::bigint as right_waiting from n""")
def join_buffer_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return joins.buffer_sizes(joins.pair_join(_side(spark, sf, "click"), _side(spark, sf, "purchase"), "routing_key", 400 * DAY))


@query("""select event_id as id from events where event_type = 'click' and 1705708800000000000 - epoch_us(ts) * 1000 > 432000000000000""")
def join_expired(spark: SparkSession, sf: str) -> DataFrame:
    return joins.expired(_side(spark, sf, "click"), NOW, 5 * DAY).select("id")


@query(f"with {_SIDES} select coalesce(json_extract_string(l.props, '$.k'), '') as key, l.id as left_id, r.id as right_id from l join r on json_extract_string(l.props, '$.k') = json_extract_string(r.props, '$.k') and abs(l.ts_ns - r.ts_ns) <= 3600000000000")
def join_json_key(spark: SparkSession, sf: str) -> DataFrame:
    l, r = (_side(spark, sf, k).withColumn("k", keys.from_json(F.col("props"), "k")) for k in ("click", "purchase"))
    return joins.interval_join(l, r, "k", HOUR).select("key", "left_id", "right_id")


@query(f"""with {_SIDES} select case when l.id % 9 = 0 then '' else l.user_id::varchar end as key, l.id as left_id, r.id as right_id from l join r
on (case when l.id % 9 = 0 then '' else l.user_id::varchar end) = (case when r.id % 9 = 0 then '' else r.user_id::varchar end) and abs(l.ts_ns - r.ts_ns) <= 3600000000000""")
def join_header_key(spark: SparkSession, sf: str) -> DataFrame:
    """Messages without the header meet each other: the empty key is a key like others."""
    headers = F.when(F.col("id") % 9 != 0, F.create_map(F.lit("user-id"), F.col("routing_key").cast("binary"))).otherwise(F.create_map().cast("map<string,binary>"))
    l, r = (_side(spark, sf, k).withColumn("k", keys.from_header(headers, "user-id")) for k in ("click", "purchase"))
    return joins.interval_join(l, r, "k", HOUR).select("key", "left_id", "right_id")


@query("select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and abs(date_diff('day', o_orderdate, l_shipdate)) <= 14")
def order_shipment_join(spark: SparkSession, sf: str) -> DataFrame:
    o = messages.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("id"), epoch_ns(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")).alias("ts_ns"))
    l = messages.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), epoch_ns(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")).alias("ts_ns"))
    return joins.interval_join(o, l, "k", 14 * DAY).select(F.col("left_id").alias("o_orderkey"), F.col("right_id").alias("l_linenumber"))


# ---------------------------------------------------------------- groups

_MEMBERS = "mem as (select 'g' || (s_nationkey % 4) as grp, s_name as member, row_number() over (partition by s_nationkey % 4 order by s_name) - 1 as i, count(*) over (partition by s_nationkey % 4) as m from supplier), p as (select unnest(range(0, 64)) as p)"


@query(f"""with {_MEMBERS} select grp as "group", p as partition_id, member from mem, p where i = case when p < (64 % m) * (64 // m + 1) then p // (64 // m + 1) else (64 % m) + (p - (64 % m) * (64 // m + 1)) // greatest(64 // m, 1) end""")
def assign_range(spark: SparkSession, sf: str) -> DataFrame:
    return groups.assign_range(_members(spark, sf), 64)


@query(f"""with {_MEMBERS} select grp as "group", p as partition_id, member from mem, p where i = p % m""")
def assign_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return groups.assign_round_robin(_members(spark, sf), 64)


@query(f"""with {_MEMBERS} select grp as "group", member, count(*) as n, min(p) as first_partition from mem, p where i = p % m group by all""")
def group_detail(spark: SparkSession, sf: str) -> DataFrame:
    d = groups.detail(groups.assign_round_robin(_members(spark, sf), 64))
    return d.select("group", "member", F.size("partitions").cast("long").alias("n"), F.array_min("partitions").alias("first_partition"))


_COMMITS = """commits as (select 'g' || (user_id % 3) as grp, topic, partition_id, "offset", ts_ns as at_ns from log where event_id % 7 = 0),
committed as (select grp, topic, partition_id, max_by("offset", (at_ns, "offset")) as committed from commits where "offset" > 0 group by all)"""


@query(f"""with {{log}}, {_COMMITS} select grp as "group", topic, partition_id, committed from committed""")
def committed_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return groups.committed(_commits(spark, sf))


@query(f"""with {{log}}, {_COMMITS}, hw as (select topic, partition_id, max("offset") as high_watermark from log group by all)
select grp as "group", topic, partition_id, high_watermark, committed, greatest(high_watermark - committed, 0) as lag from committed join hw using (topic, partition_id)""")
def consumer_lag(spark: SparkSession, sf: str) -> DataFrame:
    return groups.lag(messages.watermarks(_log(spark, sf)), groups.committed(_commits(spark, sf)))


@query(f"""with {{log}}, {_COMMITS}, {_MEMBERS}, a as (select grp, p as partition_id, member from mem, p where i = p % m)
select a.grp as "group", a.partition_id, member, coalesce(committed, 0) as committed from a left join (select * from committed where topic = 'events.view') c on a.grp = c.grp and a.partition_id = c.partition_id""")
def member_offsets(spark: SparkSession, sf: str) -> DataFrame:
    c = groups.committed(_commits(spark, sf)).where("topic = 'events.view'").drop("topic")
    return groups.member_offsets(groups.assign_round_robin(_members(spark, sf), 64), c)


def _heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return _msg(spark, sf).where(F.col("ts_ns") <= NOW).select(F.concat(F.lit("g"), F.col("user_id") % 3).alias("group"), F.col("routing_key").alias("member"), F.col("ts_ns").alias("at_ns"))


@query("""select 'g' || (user_id % 3) as "group", user_id::varchar as member, max(epoch_us(ts) * 1000) as last_ns from events where epoch_us(ts) * 1000 <= 1705708800000000000 group by all having 1705708800000000000 - max(epoch_us(ts) * 1000) > 43200000000000""")
def expired_members(spark: SparkSession, sf: str) -> DataFrame:
    return groups.expired_members(_heartbeats(spark, sf), NOW, 12 * HOUR)


@query("""select 'g' || (user_id % 3) as "group", user_id::varchar as member, max(epoch_us(ts) * 1000) as last_ns from events where epoch_us(ts) * 1000 <= 1705708800000000000 group by all having 1705708800000000000 - max(epoch_us(ts) * 1000) <= 43200000000000""")
def live_members(spark: SparkSession, sf: str) -> DataFrame:
    return groups.live_members(_heartbeats(spark, sf), NOW, 12 * HOUR)


# ---------------------------------------------------------------- maintenance

_KEYED = "keyed as (select topic, partition_id, \"offset\", case when event_id % 13 = 0 then '' else routing_key end as routing_key, event_id from log)"


@query(f"""with {{log}}, {_KEYED} select topic, partition_id, "offset", routing_key from keyed where routing_key = '' or ("offset" = (select max("offset") from keyed k where k.topic = keyed.topic and k.partition_id = keyed.partition_id and k.routing_key = keyed.routing_key))""")
def compact_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).select("topic", "partition_id", "offset", F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("routing_key")).alias("routing_key"))
    return maintenance.compact(log)


@query("""select user_id::varchar as key, max_by(props, (ts, event_id)) as value from events group by all having not max_by(event_id % 6 = 0, (ts, event_id))""")
def latest_with_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    v = _msg(spark, sf).select(F.col("routing_key").alias("key"), F.col("payload").alias("value"), (F.col("event_id") % 6 == 0).alias("gone"), "ts", "event_id")
    return maintenance.latest(v, ["key"], "value", F.struct("ts", "event_id"), "gone")


@query("""with {msg}, e as (select event_id, ts_ns, case when ttl_ns = 0 then 604800000000000 else ttl_ns end as ttl from msg) select event_id from e where ttl <> 0 and ts_ns + ttl < 1705708800000000000""")
def ttl_expired(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).withColumn("ttl_ns", maintenance.effective_ttl(F.col("ttl_ns"), 7 * DAY))
    return m.where(maintenance.is_expired(F.col("ts_ns"), F.col("ttl_ns"), NOW)).select("event_id")


@query("""with {log}, e as (select *, case when ttl_ns = 0 then 604800000000000 else ttl_ns end as ttl from log), f as (select topic, partition_id, min(case when not (ts_ns + ttl < 1705708800000000000) then "offset" end) as live from e group by all)
select topic, partition_id, "offset" from e join f using (topic, partition_id) where live is null or "offset" < live""")
def ttl_prefix(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).withColumn("ttl_ns", maintenance.effective_ttl(F.col("ttl_ns"), 7 * DAY))
    return maintenance.expired_prefix(log, NOW).select("topic", "partition_id", "offset")


@query("""with {msg} select event_id, 'expired' as reason from msg where ttl_ns <> 0 and ts_ns + ttl_ns < 1705708800000000000""")
def ttl_to_dlq(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.expire(_msg(spark, sf), NOW, "dlq")[1].select("event_id", "reason")


_SEGMENTS = """seg as (select topic, partition_id, "offset" // 16 as segment, sum(64 + strlen(payload))::bigint as bytes from log group by all)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).groupBy("topic", "partition_id", F.floor(F.col("offset") / 16).alias("segment")).agg(F.sum(64 + F.octet_length("payload")).alias("bytes"))


@query(f"""with {{log}}, {_SEGMENTS}, r as (select *, sum(bytes) over w as s, row_number() over w as i from seg window w as (partition by topic, partition_id order by segment desc rows unbounded preceding))
select topic, partition_id, segment, bytes from r where s <= 8000 or i = 1""")
def retention_size(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.retain_bytes(_segments(spark, sf), 8000)


@query(f"""with {{log}}, {_SEGMENTS}, r as (select *, row_number() over (partition by topic, partition_id order by segment desc) as i from seg) select topic, partition_id, segment, bytes from r where i <= 3""")
def retention_segments(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.retain_segments(_segments(spark, sf), 3)


@query("""with {msg} select case when 1705708800000000000 - ts_ns <= 3600000000000 then 'hot' when 1705708800000000000 - ts_ns <= 86400000000000 then 'warm' when 1705708800000000000 - ts_ns <= 604800000000000 then 'cold' else 'purged' end as tier,
count(*) as n, sum(strlen(payload))::bigint as bytes from msg group by all""")
def tier_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.tier_bytes(_msg(spark, sf), F.octet_length("payload"), NOW)


@query("select event_id, (64 + strlen('events.' || event_type) + strlen(user_id::varchar) + strlen(props) + (6 + 4 + strlen(event_type)) + (6 + 6 + case when event_id % 2 = 0 then 4 else 3 end) + case when event_id % 5 = 0 then 24 else 0 end)::bigint as bytes from events")
def message_size(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf)
    headers = F.transform_values(_headers(), lambda _, v: v.cast("binary"))
    return m.select("event_id", message_bytes(F.col("topic"), F.col("routing_key"), F.col("payload"), headers, F.col("event_id") % 5 == 0).alias("bytes"))


@query("""with {log}, t as (select *, case when event_id % 4 = 0 then 0 when event_id % 4 = 1 then 1 else 2 end as tier from log)
select event_id, tier from t union select event_id, tier from (select event_id, 1 as tier from t where tier = 0 limit 0)""")
def tiered_read(spark: SparkSession, sf: str) -> DataFrame:
    """Copies that a colder tier still holds are hidden by the hotter one."""
    log = _log(spark, sf)
    hot, warm, cold = log.where("event_id % 4 = 0"), log.where("event_id % 4 <= 1"), log
    return files.tiered(hot, warm, cold).select("event_id", F.col("tier_rank").alias("tier"))


@query("""select user_id, arg_max(event_type, (event_id % 3, event_id)) as event_type from events group by user_id""")
def merge_newest_table(spark: SparkSession, sf: str) -> DataFrame:
    """Three tables by age; each holds one row a key."""
    e = messages.table(spark, sf, "events")
    tables = [e.where(F.col("event_id") % 3 == i).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type")) for i in range(3)]
    return files.merge_tables(tables, ["user_id"])


# ---------------------------------------------------------------- queues


@query("""with {log}, {deliveries} select topic, partition_id, "offset", delivered_ns, nacks from pending""")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    return queues.pending(_deliveries(spark, sf))


@query("""with {log}, {deliveries} select topic, partition_id, "offset" from pending where 1705708800000000000 - delivered_ns > 30000000000""")
def visibility_expired(spark: SparkSession, sf: str) -> DataFrame:
    return queues.visibility_expired(queues.pending(_deliveries(spark, sf)), NOW).select("topic", "partition_id", "offset")


@query("""with {log}, {deliveries} select event_id, nacks, case when max_retries > 0 and nacks >= max_retries then 'dlq' else 'redeliver' end as action from pending join log using (topic, partition_id, "offset") where nacks > 0""")
def nack_to_dlq(spark: SparkSession, sf: str) -> DataFrame:
    p = queues.pending(_deliveries(spark, sf)).where("nacks > 0")
    return queues.after_nack(p.join(_log(spark, sf).select(*queues.MESSAGE, "event_id", "max_retries"), list(queues.MESSAGE))).select("event_id", "nacks", "action")


@query("""with {log}, {deliveries} select event_id, 'dead' as topic, topic as original_topic, nacks::varchar as death_count, routing_key as original_key, 'max retries' as reason from pending join log using (topic, partition_id, "offset") where max_retries > 0 and nacks >= max_retries""")
def dead_letter_headers(spark: SparkSession, sf: str) -> DataFrame:
    p = queues.pending(_deliveries(spark, sf)).where("nacks > 0")
    rows = queues.after_nack(p.join(_log(spark, sf).select(*queues.MESSAGE, "event_id", "max_retries", "routing_key"), list(queues.MESSAGE))).where("action = 'dlq'")
    out = queues.to_dlq(rows.withColumn("headers", F.create_map(F.lit("death-reason"), F.lit("old"))), "max retries", "dead", "2024-01-20T00:00:00Z")
    h = lambda n: F.element_at("headers", F.lit(n))
    return out.select("event_id", "topic", h("original-topic").alias("original_topic"), h("death-count").alias("death_count"), h("original-routing-key").alias("original_key"), h("death-reason").alias("reason"))


@query("with {msg} select event_id from msg where deliver_at_ns < 1705708800000000000")
def delay_ready(spark: SparkSession, sf: str) -> DataFrame:
    return queues.ready(_msg(spark, sf), NOW).select("event_id")


@query("with {msg} select event_id, deliver_at_ns from msg where deliver_at_ns >= 1705708800000000000")
def delay_pending(spark: SparkSession, sf: str) -> DataFrame:
    return queues.delayed(_msg(spark, sf), NOW).select("event_id", "deliver_at_ns")


@query("""with {log} select event_id, row_number() over (partition by topic order by least(priority, 9) desc, partition_id, "offset") as place from log""")
def priority_order(spark: SparkSession, sf: str) -> DataFrame:
    return queues.drain_order(_log(spark, sf)).select("event_id", "place")


@query("""with {log} select event_id, ['c0', 'c1', 'c2'][("offset" % 3 + 1)::bigint] as consumer from log""")
def dispatch_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return queues.dispatch_round_robin(_log(spark, sf), ["c0", "c1", "c2"]).select("event_id", "consumer")


def _queue_events(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).select("topic", F.col("event_id").alias("message"), "priority", "ts_ns")
    acks = m.select("topic", "message", "priority", (F.col("ts_ns") + 2 * HOUR).alias("ts_ns"), F.lit("ack").alias("event"))
    both = m.withColumn("event", F.lit("publish")).unionByName(acks)
    return both.withColumn("seq", F.col("ts_ns") + F.pmod(F.col("message"), F.lit(1000)))


@query()
def dispatch_prefetch(spark: SparkSession, sf: str) -> DataFrame:
    return queues.dispatch(_queue_events(spark, sf), ["c0", "c1", "c2"], 5)


@query()
def dispatch_priority(spark: SparkSession, sf: str) -> DataFrame:
    return queues.dispatch(_queue_events(spark, sf), ["c0", "c1", "c2"], 2, priority=True, most={"c0": 4})


@query("""with {log}, {deliveries} select topic, count(*) as depth from pending group by all""")
def queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    return queues.depth(queues.pending(_deliveries(spark, sf)))


# ---------------------------------------------------------------- dead letters


@query("with {dlq} select id, event_id, reason from dlq where topic = 'events.click' and reason = 'timeout' and retries >= 3 order by id limit 50")
def dlq_preview(spark: SparkSession, sf: str) -> DataFrame:
    return dlq.preview(_dlq(spark, sf), "events.click", dlq.parse({"reason": "timeout", "min_retries": 3}), 50).select("id", "event_id", "reason")


@query("with {dlq} select topic, id from dlq where regexp_matches(reason, '^(timeout|conn)')")
def dlq_reason_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _dlq(spark, sf).where(dlq.reason_matches("^(timeout|conn)")).select("topic", "id")


@query("with {dlq} select topic, id from dlq where (failed_at between timestamp '2024-01-05' and timestamp '2024-01-10' and contains(payload, '7')) or reason = 'timeout'")
def dlq_conditions(spark: SparkSession, sf: str) -> DataFrame:
    c = dlq.any_of(dlq.all_of(dlq.failed_between("2024-01-05 00:00:00", "2024-01-10 00:00:00"), dlq.payload_contains("7")), dlq.reason_is("timeout"))
    return _dlq(spark, sf).where(c).select("topic", "id")


@query("""with {dlq}, m as (select * from dlq where topic = 'events.view' and retries >= 2 order by id limit 40) select (select count(*) from dlq where topic = 'events.view') as total, count(*) as matched,
count(*) filter (retries < 5) as replayed, count(*) filter (retries >= 5) as failed, 0::bigint as skipped from m""")
def dlq_replay_result(spark: SparkSession, sf: str) -> DataFrame:
    return dlq.replay(_dlq(spark, sf), "events.view", dlq.min_retries(2), 40, ok=F.col("retries") < 5).result


@query("""with {dlq}, m as (select * from dlq where topic = 'events.view' order by id limit 30) select (select count(*) from dlq where topic = 'events.view') as total, count(*) as matched, 0::bigint as replayed, 0::bigint as failed, count(*) as skipped from m""")
def dlq_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return dlq.replay(_dlq(spark, sf), "events.view", dlq.every(), 30, dry_run=True).result


@query("""with {dlq} select event_id, 'retry' as topic, 'r' as routing_key, id::varchar as dlq_id, reason as dlq_reason, retries::varchar as dlq_retries, routing_key as user_header from dlq where topic = 'events.click' and reason = 'timeout'""")
def dlq_metadata(spark: SparkSession, sf: str) -> DataFrame:
    step = dlq.chain(dlq.add_metadata("2024-01-20T00:00:00Z"), dlq.add_header("a", "b"), dlq.remove_header("a"), dlq.set_routing_key("r"))
    out = dlq.replay(_dlq(spark, sf), "events.click", dlq.reason_is("timeout"), target="retry", step=step).replayed
    h = lambda n: F.element_at("headers", F.lit(n))
    return out.select("event_id", "topic", "routing_key", h("dlq-id").alias("dlq_id"), h("dlq-reason").alias("dlq_reason"), h("dlq-retries").alias("dlq_retries"), h("user-id").alias("user_header"))


@query("""with {dlq}, m as (select topic, id, retries from dlq where topic = 'events.view' and reason = 'timeout' order by id limit 20) select topic, id from dlq where (topic, id) not in (select (topic, id) from m where retries < 3)""")
def dlq_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return dlq.replay(_dlq(spark, sf), "events.view", dlq.reason_is("timeout"), 20, delete=True, ok=F.col("retries") < 3).remaining.select("topic", "id")


@query("with {dlq} select topic, count(*) as entries from dlq group by all")
def dlq_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return dlq.sizes(_dlq(spark, sf))


@query("with {dlq} select id, event_id from dlq where topic = 'events.error' order by id limit 5")
def dlq_peek(spark: SparkSession, sf: str) -> DataFrame:
    return dlq.peek(_dlq(spark, sf), "events.error", 5).select("id", "event_id")


@query("with {dlq} select topic, count(*) as entries from dlq where not (topic = 'events.error' and id <= 5) group by all")
def dlq_pop(spark: SparkSession, sf: str) -> DataFrame:
    return dlq.sizes(dlq.pop(_dlq(spark, sf), "events.error", 5)[1])


@query("""with {dlq} select '{"id":' || id || ',"event_id":' || event_id || ',"reason":"' || reason || '"}' as json from dlq where topic = 'events.click' and retries >= 4 order by id limit 20""")
def dlq_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = dlq.preview(_dlq(spark, sf), "events.click", dlq.min_retries(4), 20)
    return files.as_json(rows.select("id", "event_id", "reason"))


@query("with {dlq} select topic, id, retries >= 3 as dead from dlq")
def should_dlq(spark: SparkSession, sf: str) -> DataFrame:
    return _dlq(spark, sf).select("topic", "id", dlq.should_dlq(F.col("retries")).alias("dead"))


# ---------------------------------------------------------------- guards


@query("select event_id from (select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events) where i = 1")
def dedup_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    return guard.dedup_unbounded(_msg(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) * 1000 as ts_ns, row_number() over (partition by user_id order by ts, event_id) as i from events),
a as (select user_id, event_id, ts_ns, i from e where i = 1
union all select n.user_id, n.event_id, n.ts_ns, n.i from a, lateral (select * from e where e.user_id = a.user_id and e.i > a.i and e.ts_ns >= a.ts_ns + 43200000000000 order by e.i limit 1) n)
select user_id::varchar as key, event_id as id, ts_ns from a""")
def dedup_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return guard.dedup_windowed(_msg(spark, sf).withColumn("id", F.col("event_id")), "routing_key", 12 * HOUR)


@query("select event_id, row_number() over (partition by event_type, date_trunc('second', date_trunc('minute', ts)) order by ts, event_id) as attempt, row_number() over (partition by event_type, date_trunc('minute', ts) order by ts, event_id) <= 2 as allowed from events")
def rate_limit_fixed(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf)
    out = guard.per_second(m.withColumn("ts0", F.col("ts")).withColumn("ts", F.date_trunc("minute", F.col("ts"))), "event_type", F.lit(2), ["ts0", "event_id"])
    return out.select("event_id", "attempt", "allowed")


@query()
def rate_limit_token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """The data's minutes are taken for seconds, so that the bucket has something to do."""
    m = _msg(spark, sf).select(F.col("event_id").alias("id"), "topic", hashing.whole(F.col("ts_ns"), 600).alias("ts_ns"))
    return guard.token_bucket(m, 2)


@query(f"""with t as (select event_id, ts, {_TENANT_SQL} as tenant from events), n as (select *, row_number() over (partition by tenant, date_trunc('second', ts) order by ts, event_id) as attempt from t)
select event_id, attempt, case tenant when 'all' then true else attempt <= 1 end as allowed from n""")
def tenant_quota(spark: SparkSession, sf: str) -> DataFrame:
    m = routing.tenant_of(_msg(spark, sf), spark.createDataFrame(_TENANTS, "tenant string, prefix string"))
    most = F.when(F.col("tenant") == "all", 0).otherwise(1)
    return guard.per_second(m, "tenant", most, ["ts", "event_id"]).select("event_id", "attempt", "allowed")


@query(f"select {_TENANT_SQL} as tenant, sum(strlen(props))::bigint as bytes, sum(strlen(props)) >= 20000 as over from events group by all")
def storage_quota(spark: SparkSession, sf: str) -> DataFrame:
    m = routing.tenant_of(_msg(spark, sf), spark.createDataFrame(_TENANTS, "tenant string, prefix string"))
    usage = m.groupBy("tenant").agg(F.sum(F.octet_length("payload")).alias("bytes")).withColumn("max_storage_bytes", F.lit(20000))
    return guard.over_storage(usage).select("tenant", "bytes", "over")


@query("select user_id::varchar as producer_id, max(event_id) as last_seq from events group by all")
def last_sequence(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).withColumn("headers", F.create_map(F.lit("x-producer-id"), F.col("routing_key"), F.lit("x-producer-seq"), F.col("event_id").cast("string")))
    producer, seq = guard.producer_key(F.col("headers"))
    return guard.last_sequence(m.select(producer.alias("producer_id"), seq.alias("seq")))


@query("""select user_id::varchar as consumer, max(epoch_us(ts) * 1000) as last_ns, 1705708800000000000 - max(epoch_us(ts) * 1000) as idle_ns, case when 1705708800000000000 - max(epoch_us(ts) * 1000) > 30000000000 then (1705708800000000000 - max(epoch_us(ts) * 1000) - 30000000000) // 10000000000 + 1 else 0 end as ticks,
case when 1705708800000000000 - max(epoch_us(ts) * 1000) > 30000000000 then (1705708800000000000 - max(epoch_us(ts) * 1000) - 30000000000) // 10000000000 + 1 else 0 end >= 3 as evict from events where epoch_us(ts) * 1000 <= 1705708800000000000 group by all""")
def slow_consumers(spark: SparkSession, sf: str) -> DataFrame:
    return guard.slow_consumers(_heartbeats(spark, sf).withColumnRenamed("member", "consumer"), NOW)


@query("""with e as (select event_type as node, ts, event_id, case when event_id % 3 = 2 then -1 else 1 end as delta from events), r as (select *, sum(delta) over (partition by node order by ts, event_id rows unbounded preceding)::bigint as open from e)
select event_id, open, delta <= 0 or open <= 50 as allowed from r""")
def connection_cap(spark: SparkSession, sf: str) -> DataFrame:
    e = _msg(spark, sf).select("event_id", F.col("event_type").alias("node"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_id") % 3 == 2, -1).otherwise(1).alias("delta"))
    return guard.connections(e, 50).select("event_id", "open", "allowed")


@query("""with r as (select event_id, event_type, sum(strlen(props)) over (partition by event_type order by ts, event_id rows unbounded preceding) as used from events) select event_id, used::bigint as used from r where used > 10000 * 0.85""")
def memory_pressure(spark: SparkSession, sf: str) -> DataFrame:
    run = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    m = _msg(spark, sf).withColumn("used", F.sum(F.octet_length("payload")).over(run))
    return m.where(guard.under_pressure(F.col("used"), F.lit(10_000))).select("event_id", "used")


_PUB = """pub as (select event_id, ts, ts_ns, topic, payload, routing_key as producer_id, event_id // 3 as seq, deliver_at_ns, ttl_ns from msg),
a as (select *, case when strlen(payload) > 9 then 'too_large' when topic = 'events.signup' then 'no_topic' end as s1 from pub),
b as (select *, case when s1 is null and row_number() over (partition by producer_id, seq, s1 is null order by ts_ns, event_id) > 1 then 'duplicate' end as s2 from a),
c as (select *, case when s1 is null and s2 is null and row_number() over (partition by topic, date_trunc('second', ts), s1 is null and s2 is null order by ts_ns, event_id) > 1 then 'rate_limited' end as s3 from b)"""


@query(f"""with {{msg}}, {_PUB} select event_id, coalesce(s1, s2, s3, case when json_extract_string(payload, '$.k')::bigint < 10 then 'invalid' end, case when deliver_at_ns > 1705708800000000000 and topic = 'events.click' then 'delayed' end, 'accepted') as status, case when ttl_ns = 0 then 604800000000000 else ttl_ns end as ttl_ns from c""")
def publish_status(spark: SparkSession, sf: str) -> DataFrame:
    return _published(spark, sf).select("event_id", "status", "ttl_ns")


def _published(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).withColumn("producer_id", F.col("routing_key")).withColumn("seq", F.floor(F.col("event_id") / 3))
    topics = spark.createDataFrame([(f"events.{t}", "queue" if t == "click" else "stream", 8) for t in ("view", "click", "purchase", "error")], "topic string, mode string, partitions int")
    bad = registry.flat_violations('{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":10}}}', F.col("payload"))
    return publish(m, topics, Rules(most_bytes=9, rate=1, default_ttl_ns=7 * DAY, violations=bad, now_ns=NOW))


@query(f"""with {{msg}}, {_PUB}, d as (select event_id // 100 as batch, coalesce(s1, s2, s3, case when json_extract_string(payload, '$.k')::bigint < 10 then 'invalid' end, 'accepted') as status from c)
select batch, count(*) filter (status in ('accepted', 'duplicate')) as ok, count(*) filter (status not in ('accepted', 'duplicate')) as failed,
case when count(*) filter (status not in ('accepted', 'duplicate')) = 0 then 200 when count(*) filter (status in ('accepted', 'duplicate')) = 0 then 500 else 207 end as code from d group by batch""")
def publish_batch(spark: SparkSession, sf: str) -> DataFrame:
    return batch_status(_published(spark, sf).withColumn("batch", F.floor(F.col("event_id") / 100)), "batch")


# ---------------------------------------------------------------- schemas

_SCHEMA = '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","minimum":10,"maximum":90}}}'


@query("select event_id from events where json_extract_string(props, '$.k')::bigint not between 10 and 90")
def validate_json_schema(spark: SparkSession, sf: str) -> DataFrame:
    return _msg(spark, sf).withColumn("e", registry.validate_json(_SCHEMA, F.col("payload"))).where(F.size("e") > 0).select("event_id")


@query("select event_id from events where json_extract_string(props, '$.k')::bigint not between 10 and 90")
def validate_compiled(spark: SparkSession, sf: str) -> DataFrame:
    return _msg(spark, sf).where(F.size(registry.flat_violations(_SCHEMA, F.col("payload"))) > 0).select("event_id")


@query("select event_id, case when event_id % 2 = 0 then ['extra'] else ['extra', 'k'] end as missing from events")
def avro_required(spark: SparkSession, sf: str) -> DataFrame:
    schema = '{"type":"record","name":"e","fields":[{"name":"k","type":"int"},{"name":"extra","type":"string"},{"name":"o","type":["null","int"]},{"name":"d","type":"int","default":1}]}'
    payload = F.when(F.col("event_id") % 2 == 0, F.col("payload")).otherwise(F.lit('{"x": 1}'))
    return _msg(spark, sf).select("event_id", F.array_sort(registry.avro_missing(schema, payload)).alias("missing"))


@query("select item_id, substr(sha256(text), 1, 32) as fingerprint, case when substr(trim(text), 1, 1) = '{' then 'json' else 'json' end as kind from benchmark")
def schema_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return messages.table(spark, sf, "benchmark").select("item_id", hashing.fingerprint(F.col("text")).alias("fingerprint"), registry.infer_type_column(F.col("text")).alias("kind"))


@query("""with r as (select lang as subject, substr(sha256(text), 1, 32) as fingerprint, min(doc_id) as first_at from documents where text is not null group by all)
select *, row_number() over (partition by subject order by first_at, fingerprint) as version from r""")
def schema_versions(spark: SparkSession, sf: str) -> DataFrame:
    d = messages.table(spark, sf, "documents").where("text is not null")
    return registry.versions(d.select(F.col("lang").alias("subject"), "text", F.col("doc_id").alias("at")))


@query("select case when event_id % 4 = 0 then 'no_schema' when json_extract_string(props, '$.k')::bigint not between 10 and 90 then 'invalid' else 'ok' end as schema_status, count(*) as n from events group by all")
def schema_gate(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf)
    out = registry.enforce(m, F.when(F.col("event_id") % 4 != 0, F.lit(1)), registry.flat_violations(_SCHEMA, F.col("payload")))
    return out.groupBy("schema_status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- metrics


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.create_map(F.lit("topic"), F.col("topic"), F.lit("a"), (F.col("event_id") % 2).cast("string"))
    return _msg(spark, sf).select(F.lit("messages_in").alias("name"), labels.alias("labels"), F.lit(1).cast("long").alias("value"), F.struct("ts", "event_id").alias("ts"), F.col("event_id"))


@query("""select 'messages_in' as name, 'a="' || (event_id % 2) || '",topic="events.' || event_type || '"' as labels, count(*) as value from events group by all""")
def counter_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counters(_samples(spark, sf))


@query("""select 'messages_in' as name, 'a="' || (event_id % 2) || '",topic="events.' || event_type || '"' as labels, max_by(event_id, (ts, event_id)) as value from events group by all""")
def gauge_last(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gauges(_samples(spark, sf).withColumn("value", F.col("event_id")))


@query("""select 'messages_in' as name, 'messages_in{a="' || (event_id % 2) || '",topic="events.' || event_type || '"} ' || count(*) as line from events group by event_id % 2, event_type""")
def exposition(spark: SparkSession, sf: str) -> DataFrame:
    totals = _samples(spark, sf).groupBy("name", keys.label_key(F.col("labels")).alias("l"), F.element_at("labels", F.lit("a")).alias("a"), F.element_at("labels", F.lit("topic")).alias("t")).agg(F.sum("value").alias("value"))
    return files.exposition(totals.select("name", F.create_map(F.lit("topic"), "t", F.lit("a"), "a").alias("labels"), "value"))


@query("select 'events.' || event_type as topic, time_bucket(interval '5 minutes', ts) as window_start, count(*) as n, round(count(*) / 300, 6) as per_second from events group by all")
def rate_in_5m(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rate(_msg(spark, sf), "5 minutes", 300, ["topic"])


@query("select time_bucket(interval '1 hour', ts) as window_start, count(*) as n, round(count(*) / 3600, 6) as per_second from events where event_type = 'error' group by all")
def failure_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rate(_msg(spark, sf).where("event_type = 'error'"), "1 hour", 3600, [])


@query("""with w as (select distinct time_bucket(interval '5 minutes', ts) as w from events), s as (select unnest(generate_series(min(w), max(w), interval '5 minutes')) as w from w) select w as window_start from s where w not in (select w from w)""")
def silent_windows(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.silent_windows(_msg(spark, sf), 5)


@query("""select time_bucket(interval '6 hours', ts) as window_start, count(*) as n_in, count(*) filter (event_id % 8 <> 0) as n_out, round((count(*) - count(*) filter (event_id % 8 <> 0)) / nullif(count(*), 0), 6) as ratio from events group by all
having (count(*) - count(*) filter (event_id % 8 <> 0)) / nullif(count(*), 0) > 0.1""")
def drop_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.drop_ratio(_msg(spark, sf), "6 hours", F.col("event_id") % 8 != 0, 0.1)


@query(f"""with {{log}}, {_COMMITS}, hw as (select topic, partition_id, max("offset") as h from log group by all) select grp as "group", topic, partition_id, greatest(h - committed, 0) as lag from committed join hw using (topic, partition_id) where greatest(h - committed, 0) > 3""")
def lag_alert(spark: SparkSession, sf: str) -> DataFrame:
    lag = groups.lag(messages.watermarks(_log(spark, sf)), groups.committed(_commits(spark, sf)))
    return metrics.over(lag, "lag", 3).select("group", "topic", "partition_id", "lag")


@query("""select user_id::varchar as node, max(epoch_us(ts) * 1000) as last_ns from events where epoch_us(ts) * 1000 <= 1705708800000000000 group by all having 1705708800000000000 - max(epoch_us(ts) * 1000) > 60000000000""")
def nodes_down(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.down(_heartbeats(spark, sf).withColumnRenamed("member", "node"), NOW)


@query("select time_bucket(interval '1 hour', ts) as window_start, sum(strlen(props))::bigint as bytes, (sum(strlen(props)) * 24)::bigint as per_day from events group by all having sum(strlen(props)) * 24 > 3000")
def storage_growth(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.growth(_msg(spark, sf), "1 hour", 3600, F.octet_length("payload"), 3000)


@query("""with w as (select time_bucket(interval '1 hour', ts) as window_start, count(*) as n from events group by all), d as (select window_start, n - lag(n) over (order by window_start) as rise from w) select window_start, rise from d where rise > 5""")
def connection_storm(spark: SparkSession, sf: str) -> DataFrame:
    w = windows.tumbling(_msg(spark, sf), "1 hour", [])
    return metrics.jumps(w, "window_start", "n", 5).select("window_start", "rise")


@query("""select event_type, count(*) as n, round(count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 6) as per_second, min(value) as least, max(value) as greatest, round(avg(value::decimal(20, 6)), 4) as mean, quantile_disc(value, 0.99) as p99 from events group by all""")
def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.load_summary(_msg(spark, sf), ["event_type"], "value")


@query("""with h as (select user_id, epoch_us(ts) * 1000 as at_ns from events where epoch_us(ts) * 1000 <= 1705708800000000000), s as (select user_id, at_ns, at_ns - lag(at_ns) over (partition by user_id order by at_ns) as step from h),
o as (select user_id, max(at_ns) as l, count(step) as n, avg(step) as m, stddev_samp(step) as sd from s group by user_id),
p as (select user_id, n, greatest((1705708800000000000 - l - case when n < 2 then 1e9 else m end) / case when n < 2 then 1e8 else greatest(sd, 1e8) end / ln(10), 0.0) as phi from o)
select user_id::varchar as node, n, round(phi, 4) as phi, phi > 8.0 as suspect from p""")
def phi_suspicion(spark: SparkSession, sf: str) -> DataFrame:
    return replicas.suspicion(_heartbeats(spark, sf).select(F.col("member").alias("node"), "at_ns"), NOW)


_REPLICAS = """lead as (select topic, partition_id, max("offset") as lo from log group by all), rep as (select topic, partition_id, n as node, lo, greatest(lo - n * 4, 0) as o, n <> 2 as act from lead, unnest(range(0, 3)) u(n))"""


def _replicas(spark: SparkSession, sf: str) -> DataFrame:
    w = messages.watermarks(_log(spark, sf))
    r = w.select("topic", "partition_id", F.col("high_watermark").alias("leader_offset"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("node"))
    return r.withColumn("offset", F.greatest(F.col("leader_offset") - F.col("node") * 4, F.lit(0))).withColumn("active", F.col("node") != 2)


@query(f"""with {{log}}, {_REPLICAS} select topic, partition_id, node, lo - o as lag, lo - o <= 5 and act as in_sync from rep""")
def isr_health(spark: SparkSession, sf: str) -> DataFrame:
    return replicas.in_sync(_replicas(spark, sf), 5).select("topic", "partition_id", "node", "lag", "in_sync")


@query(f"""with {{log}}, {_REPLICAS} select topic, partition_id, count(*) as replicas, count(*) filter (lo - o <= 5 and act) as in_sync, count(*) filter (lo - o <= 5 and act) > 1 as has_quorum from rep group by all""")
def isr_quorum(spark: SparkSession, sf: str) -> DataFrame:
    return replicas.quorum(replicas.in_sync(_replicas(spark, sf), 5))


@query("""with {log}, r as (select topic, partition_id, max("offset") as remote_offset from log where event_id % 5 <> 0 and partition_id <> 2 group by all), l as (select topic, partition_id, max("offset") as local_offset from log group by all)
select topic, partition_id, local_offset, coalesce(remote_offset, -1) as remote_offset, local_offset - coalesce(remote_offset, -1) as lag from l left join r using (topic, partition_id)""")
def geo_lag(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    return replicas.geo_lag(log, log.where("event_id % 5 <> 0 and partition_id <> 2"))


@query("""select role as category, case when turn % 2 = 0 then 'ask' else 'answer' end as action, case when strlen(text) > 200 then 'long' else 'short' end as result, count(*) as n from conversations group by all""")
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = messages.table(spark, sf, "conversations")
    return replicas.audit_counts(c.select(F.col("role").alias("category"), F.when(F.col("turn") % 2 == 0, "ask").otherwise("answer").alias("action"), F.when(F.octet_length("text") > 200, "long").otherwise("short").alias("result")))


@query("""select event_id, epoch_us(ts) // 1000 as millis, upper(hex(event_id % 4096)) as counter from events""")
def uuid7_parts(spark: SparkSession, sf: str) -> DataFrame:
    m = _msg(spark, sf).select("event_id", hashing.uuid7(hashing.whole(F.col("ts_ns"), 1_000_000), F.col("event_id"), F.col("event_id")).alias("id"))
    counter = F.ltrim(F.upper(F.substring("id", 16, 3)), F.lit("0"))
    return m.select("event_id", hashing.uuid7_millis(F.col("id")).alias("millis"), F.when(counter == "", "0").otherwise(counter).alias("counter"))


@query()
def crc32c_payload(spark: SparkSession, sf: str) -> DataFrame:
    return _msg(spark, sf).select("event_id", hashing.crc32c(F.col("payload").cast("binary")).alias("crc"))


@query("select event_id, props as payload from events")
def encrypt_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lit("0123456789abcdef").cast("binary")
    m = _msg(spark, sf).select("event_id", files.encrypted(F.col("payload").cast("binary"), key).alias("sealed"))
    return m.select("event_id", files.decrypted(F.col("sealed"), key).cast("string").alias("payload"))
