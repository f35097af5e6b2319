import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamloom.functions import hashing, keys, matchers
from streamloom.schema import message_bytes

VECTORS = {"": 0, "hello": 0x248BFA47, "hello, world": 0x149BBB7F, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}


def test_murmur3_vectors(spark):
    for text, want in VECTORS.items():
        assert hashing.murmur3_int(text.encode()) == want
    assert [hashing.murmur3_int(str(i).encode()) % 8 for i in range(6)] == [7, 3, 7, 4, 0, 4]
    texts = [*VECTORS, "é", "日本語", "a", "ab", "abc", "abcd", "x" * 37]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {t: hashing.murmur3_int(t.encode()) for t in texts}
    for f in (hashing.murmur3, hashing.murmur3_expression):
        assert {r.t: r.h for r in df.select("t", f(F.col("t")).alias("h")).collect()} == want


def test_crc32c_and_fingerprint(spark):
    row = spark.range(1).select(hashing.crc32c(F.lit("123456789").cast("binary")).alias("c"), hashing.fingerprint(F.lit("abc")).alias("f")).first()
    assert row.c == 0xE3069283
    assert row.f == "ba7816bf8f01cfea414140de5dae2223"


def test_bloom_size():
    bits, hashes = hashing.bloom_size(1000, 0.01)
    assert bits % 64 == 0 and bits >= 9585 and hashes == 7
    assert hashing.bloom_size(0, 0.5)[0] == 64


def test_uuid7(spark):
    df = spark.range(1).select(hashing.uuid7(F.lit(0x18CC251F400).cast("long"), F.lit(5).cast("long"), F.lit(9).cast("long")).alias("u"))
    u = df.first().u
    assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7005-[89ab][0-9a-f]{3}-[0-9a-f]{12}", u)
    assert df.select(hashing.uuid7_millis(F.col("u")).alias("m")).first().m == 0x18CC251F400


TOPIC = [
    ("sensor.#", "sensor", True), ("sensor.*", "sensor.temp.indoor", False), ("*.*.info", "app.server.info", True), ("*.*.info", "app.server.warn", False),
    ("*.server.#", "app.server", True), ("*.server.#", "app.server.info.error", True), ("*.server.#", "app.client.info", False), ("#.#", "a.b.c", True),
    ("sensor.*.temp.#", "sensor.indoor.temp.room1", True), ("sensor.*.temp.#", "sensor.temp", False), ("#", "", True), ("sensor.temperature.#", "sensor.temperature", True),
]
MQTT = [
    ("sensor/+", "sensor/temp", True), ("sensor/+", "sensor/temp/room", False), ("sensor/+", "sensor", False), ("#", "anything/goes", True), ("sensor/#", "sensor", True),
    ("sensor/#", "sensor/temp/room1", True), ("+/+", "a/b", True), ("+/+", "a/b/c", False), ("sensor/+/room", "sensor/temp/room", True), ("sensor/+/room", "sensor/temp/kitchen", False),
]


@pytest.mark.parametrize("pattern,key,want", TOPIC)
def test_topic_regex(pattern, key, want):
    assert bool(re.search(matchers.topic_regex(pattern), key + ".")) is want


@pytest.mark.parametrize("pattern,topic,want", MQTT)
def test_mqtt_regex(pattern, topic, want):
    assert bool(re.search(matchers.mqtt_regex(pattern), topic + "/")) is want


def test_column_matchers(spark):
    t = spark.createDataFrame(TOPIC, "p string, k string, want boolean")
    assert t.where(matchers.topic_matches(F.col("p"), F.col("k")) != F.col("want")).count() == 0
    m = spark.createDataFrame(MQTT, "p string, k string, want boolean")
    assert m.where(matchers.mqtt_matches(F.col("p"), F.col("k")) != F.col("want")).count() == 0
    g = spark.createDataFrame(GLOB, "p string, k string, want boolean")
    assert g.where(matchers.glob_matches(F.col("p"), F.col("k")) != F.col("want")).count() == 0
    assert all((bool(re.search(matchers.glob_regex(p), k)) or p == k) is want for p, k, want in GLOB)


def test_crc32c_of_many_lengths():
    values = [bytes((i * k + 3) % 256 for k in range(i * 7 % 50)) for i in range(30)]

    def one(x):
        c = 0xFFFFFFFF
        for b in x:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert hashing.crc32c_of(values).tolist() == [one(v) for v in values] and len(hashing.crc32c_of([])) == 0


GLOB = [
    ("orders.*", "orders.eu", True), ("a?c", "abc", True), ("a*", "a/b", False), ("x", "x", True), ("a.b", "axb", False),
    ("secret[0-9]", "secret7", True), ("secret[0-9]", "secretx", False), ("a[^b]c", "axc", True), ("a[^b]c", "abc", False),
    ("*", "a/b", True), ("x.*", "x.a/b", True), ("x.*", "x.a/b.c", False), ("[a", "[a", True), ("[a", "a", False),
    ("q\\*", "q*", True), ("q\\*", "qq", False), ("[\\]x]", "]", True), ("[&&b]", "&", True), ("[a-c]*z", "bqqz", True), ("[[]", "[", True),
]


def words_match(pattern, key):
    if not pattern:
        return not key
    if pattern[0] == "#":
        return any(words_match(pattern[1:], key[i:]) for i in range(len(key) + 1))
    return bool(key) and pattern[0] in ("*", key[0]) and words_match(pattern[1:], key[1:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "*", "#", "a+b"]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "a+b", ""]), min_size=1, max_size=4))
def test_topic_regex_by_definition(pattern, key):
    assert bool(re.search(matchers.topic_regex(".".join(pattern)), ".".join(key) + ".")) == words_match(pattern, key)


def test_keys(spark):
    df = spark.createDataFrame([('{"user_id":"alice","n":5,"b":true}',), ("not json",), (None,)], "p string")
    got = [tuple(r) for r in df.select(keys.from_json(F.col("p"), "user_id"), keys.from_json(F.col("p"), "n"), keys.from_json(F.col("p"), "b"), keys.from_json(F.col("p"), "x")).collect()]
    assert got == [("alice", "5", "true", ""), ("", "", "", ""), ("", "", "", "")]
    labels = spark.range(1).select(keys.label_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("l"), keys.label_key(F.expr("map()").cast("map<string,string>")).alias("e")).first()
    assert labels.l == 'a="1",b="2"' and labels.e == ""


def test_message_bytes(spark):
    headers = F.create_map(F.lit("k"), F.lit("vv").cast("binary"))
    assert spark.range(1).select(message_bytes(F.lit("topic"), F.lit("é"), F.lit("abc"), headers, F.lit(True)).alias("n")).first().n == 64 + 5 + 2 + 3 + 9 + 24
