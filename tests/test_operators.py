import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from streamloom.operators import dlq, groups, guard, joins, maintenance, metrics, ordered, queues, registry, routing, topology, windows

T0 = dt.datetime(1970, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame([(i, k, at(s), d) for i, (k, s, d) in enumerate(rows)], "event_id long, key string, ts timestamp_ntz, data string")


def test_tumbling_fixtures(spark):
    e = events(spark, [("k1", 1, "a"), ("k1", 5, "b"), ("k2", 3, "c")])
    got = {(r.key, r.n, r.data) for r in windows.tumbling(e, "10 seconds", ["key"], "data").collect()}
    assert got == {("k1", 2, "ab"), ("k2", 1, "c")}
    two = windows.tumbling(events(spark, [("k1", 1, "a"), ("k1", 7, "b")]), "5 seconds", ["key"])
    assert two.count() == 2
    now = F.lit(at(5)).cast("timestamp_ntz")
    late = windows.tumbling(events(spark, [("k1", 1, "a")]), "10 seconds", ["key"])
    assert windows.fired(late, now).count() == 0 and windows.open_count(late, now).first().open_windows == 1


def test_sliding_fixtures(spark):
    e = events(spark, [("k1", 3, "a"), ("k1", 6, "b")])
    got = {(r.window_start, r.n) for r in windows.sliding(e, "10 seconds", "5 seconds", ["key"]).collect()}
    assert got == {(at(0), 2), (at(5), 1)}
    assert windows.hopping(events(spark, [("k1", 2, "a"), ("k1", 5, "b")]), "10 seconds", "3 seconds", ["key"], parity=True).count() == 1
    gaps = windows.sliding(events(spark, [("k", 1, "a"), ("k", 9, "b"), ("k", 11, "c")]), "5 seconds", "10 seconds", ["key"])
    assert {(r.window_start, r.n) for r in gaps.collect()} == {(at(0), 1), (at(10), 1)}


def test_session_fixtures(spark):
    assert windows.session(events(spark, [("k1", 1, ""), ("k1", 3, ""), ("k1", 20, "")]), "5 seconds", ["key"]).count() == 2
    edge = windows.session(events(spark, [("k", s, "") for s in (0, 4, 5, 10, 15, 16)]), "5 seconds", ["key"])
    assert [r.n for r in edge.collect()] == [6]


def replay_pairs(rows, within):
    left, right, out = [], [], []
    for key, i, ts, side in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        other = right if side == "L" else left
        hit = next((o for o in other if o[0] == key and abs(o[2] - ts) <= within), None)
        if hit:
            other.remove(hit)
            out.append((key, i, hit[1]) if side == "L" else (key, hit[1], i))
        else:
            (left if side == "L" else right).append((key, i, ts, side))
    return sorted(out), sorted(r[1] for r in left), sorted(r[1] for r in right)


@pytest.mark.parametrize("within", [0, 3, 10, 1000])
def test_pair_join_equals_replay(spark, within):
    rng = random.Random(within)
    rows = [(rng.choice(["", "a", "b"]), i, rng.randrange(120), rng.choice("LR")) for i in range(150)]
    l, r = (spark.createDataFrame([(k, i, t) for k, i, t, s in rows if s == side], "key string, id long, ts_ns long") for side in "LR")
    got = joins.pair_join(l, r, "key", within).collect()
    pairs, left, right = replay_pairs(rows, within)
    assert sorted((x.key, x.left_id, x.right_id) for x in got if x.left_id is not None and x.right_id is not None) == pairs
    assert sorted(x.left_id for x in got if x.right_id is None) == left
    assert sorted(x.right_id for x in got if x.left_id is None) == right


def test_dedup_windowed_equals_replay(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.randrange(400)) for i in range(200)]
    got = sorted(r.id for r in guard.dedup_windowed(spark.createDataFrame(rows, "key string, id long, ts_ns long"), "key", 20).collect())
    anchors, want = {}, []
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if k not in anchors or t - anchors[k] >= 20:
            anchors[k] = t
            want.append(i)
    assert got == sorted(want)


def test_token_bucket(spark):
    s = 1_000_000_000
    rows = [(i, "t", t) for i, t in enumerate([0, 1, 2, s // 2, s, s + 1, s + 2, 10 * s, 10 * s + 1, 10 * s + 2])]
    got = {r.id: r.allowed for r in guard.token_bucket(spark.createDataFrame(rows, "id long, topic string, ts_ns long"), 2).collect()}
    assert [got[i] for i in range(10)] == [True, True, False, False, True, True, False, True, True, False]


def test_assignments(spark):
    m = spark.createDataFrame([("g", "m1"), ("g", "m2")], "group string, member string")
    of = lambda df: [r.member for r in df.orderBy("partition_id").collect()]
    assert of(groups.assign_range(m, 4)) == ["m1", "m1", "m2", "m2"]
    assert of(groups.assign_range(m, 5)) == ["m1"] * 3 + ["m2"] * 2
    assert of(groups.assign_round_robin(m, 4)) == ["m1", "m2", "m1", "m2"]
    three = spark.createDataFrame([("g", f"m{i}") for i in range(5)], "group string, member string")
    assert of(groups.assign_range(three, 3)) == ["m0", "m1", "m2"]


def test_assign_sticky():
    one = groups.assign_sticky(["m1"], 6, {})
    two = groups.assign_sticky(["m1", "m2"], 6, one)
    three = groups.assign_sticky(["m1", "m2", "m3"], 6, two)
    sizes = lambda a: sorted(list(a.values()).count(m) for m in set(a.values()))
    assert all(1 <= n <= 3 for n in sizes(three)) and "m1" in three.values()
    back = groups.assign_sticky(["m1", "m2"], 6, three)
    assert all(back[p] == m for p, m in three.items() if m in ("m1", "m2"))


def test_topic_exchange(spark):
    rules = spark.createDataFrame([("w", "sensor.*"), ("t", "sensor.temperature.#"), ("i", "sensor.temperature.indoor"), ("c", "#")], "destination string, binding_key string")
    want = {"sensor.humidity": "cw", "sensor.temperature": "ctw", "sensor.temperature.indoor": "cit", "sensor.temperature.indoor.room1": "ct", "alerts.critical": "c", "": "c"}
    m = spark.createDataFrame([(k,) for k in want], "routing_key string")
    got = {}
    for r in routing.route(m, rules, "topic").collect():
        got[r.routing_key] = "".join(sorted(got.get(r.routing_key, "") + r.destination))
    assert got == want


def test_headers_exchange(spark):
    rules = spark.createDataFrame([("d1", {"x-match": "all", "format": "json", "type": "report"}), ("d2", {"x-match": "all", "format": "xml"}), ("d3", {})], "destination string, args map<string,string>")
    m = spark.createDataFrame([(1, {"format": "json", "type": "report"}), (2, {"format": "xml"}), (3, {}), (4, None)], "id int, headers map<string,string>")
    got = sorted((r.id, r.destination) for r in routing.route(m, rules, "headers").collect())
    assert got == [(1, "d1"), (1, "d3"), (2, "d2"), (2, "d3"), (3, "d3"), (4, "d3")]


def test_exchange_registry(spark):
    x = routing.Exchanges(spark)
    x.declare("e", "fanout")
    x.declare("e", "fanout")
    with pytest.raises(ValueError):
        x.declare("e", "direct")
    x.bind("e", "q")
    x.bind("e", "q")
    assert x.unbind("e", "q") and x.list() == [("e", "fanout", 1)] and not x.unbind("e", "no")
    assert x.route(spark.createDataFrame([("k",)], "routing_key string"), "e").count() == 1


def test_namespace_and_tenants(spark):
    t = spark.createDataFrame([("a", "o"), ("b", "orders")], "tenant string, prefix string")
    got = {r.topic: r.tenant for r in routing.tenant_of(spark.createDataFrame([("orders.eu",), ("other",), ("x",)], "topic string"), t).collect()}
    assert got == {"orders.eu": "b", "other": "a", "x": None}


def dead(spark):
    rows = [(i, "t", r, n, at(i), "k", p, {"h": "1"}) for i, (r, n, p) in enumerate([("timeout", 2, "an error"), ("error", 3, "fine"), ("timeout", 5, None)])]
    return dlq.push(spark.createDataFrame(rows, "event_id long, topic string, reason string, retries int, failed_at timestamp_ntz, routing_key string, payload string, headers map<string,string>"))


def test_dlq_conditions(spark):
    d = dead(spark)
    ids = lambda c: [r.id for r in d.where(c).orderBy("id").collect()]
    assert ids(dlq.reason_is("timeout")) == [1, 3]
    assert ids(dlq.min_retries(3)) == [2, 3]
    assert ids(dlq.payload_contains("error")) == [1]
    assert ids(dlq.failed_between("1970-01-01 00:00:00", "1970-01-01 00:00:01")) == [1, 2]
    assert ids(dlq.reason_matches("(")) == [] and ids(dlq.reason_matches("")) == [] and ids(dlq.reason_matches("time|err")) == [1, 2, 3]
    assert ids(dlq.any_of()) == [] and ids(dlq.all_of()) == [1, 2, 3]
    assert ids(dlq.parse({"reason": "timeout", "min_retries": 3})) == [3]


def test_dlq_replay(spark):
    d = dead(spark)
    r = dlq.replay(d, "t", dlq.every(), delete=True)
    assert r.result.first().asDict() == {"total": 3, "matched": 3, "replayed": 2, "failed": 1, "skipped": 0}
    assert [x.id for x in r.remaining.collect()] == [3]
    dry = dlq.replay(d, "t", dlq.every(), dry_run=True)
    assert dry.result.first().skipped == 3 and dry.replayed.count() == 0 and dry.remaining.count() == 3
    two = dlq.replay(d, "t", dlq.every(), 2, target="again", step=dlq.add_metadata("now"))
    assert two.result.first().matched == 2 and {x.topic for x in two.replayed.collect()} == {"again"}
    assert two.replayed.orderBy("id").first().headers["dlq-reason"] == "timeout"
    taken, rest = dlq.pop(d, "t", 1)
    assert taken.first().id == 1 and rest.count() == 2


JSON_OLD = '{"type":"object","properties":{"name":{"type":"string"},"age":{"type":"integer"}},"required":["name","age"]}'


@pytest.mark.parametrize(
    "kind,old,new,mode,ok",
    [
        ("json", '{"properties":{"name":{"type":"string"}},"required":["name"]}', '{"properties":{"name":{"type":"string"},"age":{"type":"integer"}},"required":["name"]}', "backward", True),
        ("json", JSON_OLD, '{"properties":{"name":{"type":"string"}},"required":["name"]}', "backward", False),
        ("json", '{"properties":{"name":{"type":"string"}},"required":["name"]}', JSON_OLD, "forward", False),
        ("json", '{"properties":{"name":{"type":"string"}}}', '{"properties":{"name":{"type":"integer"}}}', "backward", False),
        ("avro", '{"type":"record","fields":[{"name":"a","type":"int"}]}', '{"type":"record","fields":[{"name":"a","type":"int"},{"name":"b","type":"int","default":0}]}', "full", True),
        ("avro", '{"type":"record","fields":[{"name":"a","type":"int"}]}', '{"type":"record","fields":[]}', "backward", False),
        ("protobuf", "message M { int32 a = 1; }", "message M { string a = 1; }", "backward", False),
        ("protobuf", "message M {\n int32 a = 1;\n int32 b = 2;\n}", "message M {\n int32 a = 1;\n}", "forward", False),
        ("json", JSON_OLD, '{"properties":{}}', "none", True),
    ],
)
def test_compatibility(kind, old, new, mode, ok):
    assert (not registry.compatible(kind, old, new, mode)) is ok


def test_registry():
    r = registry.Registry()
    a = r.register("s", '{"properties":{"name":{"type":"string"}},"required":["name"]}')
    assert r.register("s", a["text"]) is a and a["version"] == 1 and a["type"] == "json"
    with pytest.raises(registry.Incompatible):
        r.register("s", '{"properties":{}}')
    b = r.register("s", '{"properties":{"name":{"type":"string"},"x":{"type":"string"}},"required":["name"]}')
    assert (b["id"], b["version"], r.latest("s")) == (2, 2, b)
    r.delete("s", 1)
    assert r.get("s", 1)["id"] == 2 and r.subjects() == ["s"] and r.by_id(1) is None
    assert registry.infer_type('{"type":"record","fields":[]}') == "avro" and registry.infer_type('syntax = "proto3"') == "protobuf"


def test_json_validation(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "string", "minLength": 2, "maxLength": 3}, "n": {"enum": [1, 2]}, "l": {"type": "array", "items": {"type": "integer"}}}}
    good, bad = {"a": "ab", "n": 1, "l": [1]}, [{}, {"a": "é" * 2}, {"a": 5}, {"a": "ab", "z": 1}, {"a": "ab", "n": 3}, {"a": "ab", "l": ["x"]}]
    assert registry.json_errors(schema, good) == [] and all(registry.json_errors(schema, b) for b in bad)
    df = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("{",), (None,)], "p string")
    assert [len(r.e) > 0 for r in df.select(registry.validate_json(json.dumps(schema), F.col("p")).alias("e")).collect()] == [False] + [True] * 8


def test_flat_violations_equal_the_validator(spark):
    schema = '{"type":"object","required":["k","s"],"properties":{"k":{"type":"integer","minimum":1,"maximum":9},"s":{"type":"string","maxLength":3},"f":{"type":"number"},"b":{"type":"boolean"}}}'
    docs = ['{"k":1,"s":"a"}', '{"k":0,"s":"a"}', '{"k":10,"s":"a"}', '{"k":"1","s":"a"}', '{"s":"a"}', '{"k":5,"s":"abcd"}', '{"k":5,"s":"a","f":1.5,"b":true}', '{"k":5,"s":"a","f":"x"}', '{"k":5,"s":"a","b":1}', "nope", None]
    df = spark.createDataFrame([(d,) for d in docs], "p string")
    got = [len(r.a) > 0 for r in df.select(registry.flat_violations(schema, F.col("p")).alias("a")).collect()]
    assert got == [len(r.a) > 0 for r in df.select(registry.validate_json(schema, F.col("p")).alias("a")).collect()]


def test_protobuf(spark):
    text = "message M {\n  int32 a = 1;\n  string b = 2;\n}"
    df = spark.createDataFrame([(bytes([8, 1, 18, 1, 65]),), (bytes([8, 1]),), (b"\xff",)], "p binary")
    got = [r.e for r in df.select(registry.validate_protobuf(text, F.col("p")).alias("e")).collect()]
    assert got == [[], ["field 2 missing"], ["not a message"]]


def test_topologies(spark, tmp_path):
    t = topology.Topology("t").source("a").filter(F.col("x") > 1).sink("b")
    t.validate({"a", "b"})
    with pytest.raises(topology.TopologyError):
        t.validate({"a"})
    all_ = topology.Topologies(spark)
    all_.create(t)
    with pytest.raises(topology.TopologyError):
        all_.create(t)
    assert all_.list() == [("t", "stopped")]
    all_.delete("t")
    assert all_.list() == []


def test_pipeline_policies(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, payload string")
    stages = [(F.col("payload") != "b", F.col("payload") == "c", F.upper("payload"))]
    skip = topology.staged_payload(df, stages)
    assert sorted((r.id, r.payload) for r in skip["ok"].collect()) == [("1", "A"), ("2", "b")]
    dead_ = topology.staged_payload(df, stages, topology.DEAD_LETTER)
    assert [r.id for r in dead_["dlq"].collect()] == ["2"] and [r.id for r in dead_["ok"].collect()] == ["1"]
    assert [r.id for r in topology.staged_payload(df, stages, topology.REJECT)["rejected"].collect()] == ["2"]


def test_dispatch(spark):
    rows = [("t", 1, "publish", 1, 0), ("t", 2, "publish", 2, 5), ("t", 3, "publish", 3, 9), ("t", 4, "ack", 1, 0), ("t", 5, "ack", 3, 0)]
    e = spark.createDataFrame(rows, "topic string, seq long, event string, message long, priority int")
    plain_ = sorted((r.seq, r.message) for r in queues.dispatch(e, ["c"], 1).collect())
    assert plain_ == [(1, 1), (4, 2)]
    first = sorted((r.seq, r.message) for r in queues.dispatch(e, ["c"], 1, priority=True).collect())
    assert first == [(1, 1), (4, 3), (5, 2)]


def test_compaction_and_retention(spark):
    log = spark.createDataFrame([("t", 0, i, k) for i, k in enumerate(["a", "", "b", "a", ""])], "topic string, partition_id int, offset long, routing_key string")
    assert sorted(r.offset for r in maintenance.compact(log).collect()) == [1, 2, 3, 4]
    seg = spark.createDataFrame([("t", 0, i, 100) for i in range(5)], "topic string, partition_id int, segment int, bytes long")
    assert sorted(r.segment for r in maintenance.retain_bytes(seg, 250).collect()) == [3, 4]
    assert sorted(r.segment for r in maintenance.retain_bytes(seg, 10).collect()) == [4]


def test_counter_rate(spark):
    s = spark.createDataFrame([("n", 0, 10), ("n", 10_000_000_000, 30), ("n", 20_000_000_000, 5)], "node string, ts_ns long, value long")
    assert [r.per_second for r in metrics.counter_rate(s, ["node"]).orderBy("ts_ns").collect()] == [None, 2.0, 0.5]


def test_numbers_and_segments_of_a_hot_key(spark):
    """Prefix sums over buckets against one pass over the rows, nulls in key and time included."""
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, *range(-5000, 5000, 13)]), i) for i in range(600)]
    df = spark.createDataFrame(data, "key string, at long, id long")
    got = {r.id: r.n for r in ordered.numbered(df, ["key"], F.floor(F.col("at") / 100), ["at", "id"], "n").collect()}
    seen, want = {}, {}
    for key, at, i in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = seen.get(key, 0)
        seen[key] = want[i] + 1
    assert got == want
    for gap in (0, 1, 40, 300):
        timed = df.where("at is not null")
        got = {r.id: r._segment for r in ordered.segments(timed, ["key"], "at", gap).collect()}
        last, number, want = {}, {}, {}
        for key, at, i in sorted((r for r in data if r[1] is not None), key=lambda r: (r[1], r[2])):
            number[key] = number.get(key, 0) + (key in last and at - last[key] > gap)
            last[key], want[i] = at, number[key]
        assert got == want
