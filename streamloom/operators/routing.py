"""Routing and access: exchanges, MQTT filters, tenants, access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matchers

#: Rows of a rule table that are broadcast; a longer one is joined without the hint.
RULES = 100_000
MATCH = "x-match"


def small(rules: DataFrame) -> DataFrame:
    """A rule table with a broadcast hint if it is proved small."""
    return F.broadcast(rules) if rules.limit(RULES + 1).count() <= RULES else rules


def headers_match(args: Column, headers: Column) -> Column:
    """A headers binding: no arguments match all; arguments never match a message without headers;
    ``x-match`` any needs one equal header, else all arguments must be equal."""
    wanted = F.filter(F.map_entries(args), lambda e: e["key"] != MATCH)
    same = lambda e: F.element_at(headers, e["key"]).eqNullSafe(e["value"])
    matched = F.when(F.element_at(args, F.lit(MATCH)) == "any", F.exists(wanted, same)).otherwise(F.forall(wanted, same))
    return F.when(F.size(args) == 0, F.lit(True)).when(F.coalesce(F.size(headers), F.lit(0)) <= 0, F.lit(False)).otherwise(matched)


def route(messages: DataFrame, bindings: DataFrame, kind: str) -> DataFrame:
    """One row per message and matching binding; a destination bound twice gets a message twice.

    ``kind``: direct (binding_key = routing_key), topic (patterns over dotted keys), fanout (all) or
    headers.  ``bindings``: destination, binding_key, and args for headers.  Patterns and arguments are
    matched once per distinct key or set of headers, not per message.  Anything else is treated as direct.
    """
    rules = small(bindings)
    if kind == "fanout":
        return messages.join(rules.select("destination"), F.lit(True))
    if kind == "headers":
        told = messages.withColumn("_set", F.array_sort(F.map_entries("headers")))
        sets = told.select("_set").distinct().withColumn("headers", F.map_from_entries("_set"))
        matched = sets.join(rules.select("destination", "args"), headers_match(F.col("args"), F.col("headers"))).select(F.col("_set").alias("_known"), "destination")
        return told.join(matched, F.col("_set").eqNullSafe(F.col("_known"))).drop("_set", "_known")
    if kind == "topic":
        keys = messages.select("routing_key").distinct()
        matched = keys.join(rules, matchers.topic_matches(F.col("binding_key"), F.col("routing_key"))).select("routing_key", "destination")
        return messages.join(matched, "routing_key")
    return messages.join(rules.select(F.col("binding_key").alias("routing_key"), "destination"), "routing_key")


def published(messages: DataFrame, routed: DataFrame, key: str) -> DataFrame:
    """Per message how many destinations it went to; 0 if none."""
    n = routed.groupBy(key).agg(F.count(F.lit(1)).alias("published"))
    return messages.select(key).join(n, key, "left").select(key, F.coalesce("published", F.lit(0).cast("long")).alias("published"))


class Exchanges:
    """Exchanges and their bindings: declared, bound, unbound and deleted by name."""

    KINDS = ("direct", "topic", "fanout", "headers")

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kinds: dict[str, str] = {}
        self.rules: dict[str, list[tuple[str, str, dict[str, str]]]] = {}

    def declare(self, name: str, kind: str) -> None:
        """Declaring again with the same kind changes nothing; an unknown kind is direct."""
        kind = kind if kind in self.KINDS else "direct"
        if self.kinds.setdefault(name, kind) != kind:
            raise ValueError(f"{name} is a {self.kinds[name]} exchange")
        self.rules.setdefault(name, [])

    def bind(self, name: str, destination: str, key: str = "", args: dict[str, str] | None = None) -> None:
        self.rules[name].append((destination, key, args or {}))

    def unbind(self, name: str, destination: str, key: str = "") -> bool:
        """Removes the first such binding only."""
        for i, (d, k, _) in enumerate(self.rules[name]):
            if (d, k) == (destination, key):
                del self.rules[name][i]
                return True
        return False

    def delete(self, name: str) -> None:
        del self.kinds[name], self.rules[name]

    def list(self) -> list[tuple[str, str, int]]:
        return [(n, self.kinds[n], len(self.rules[n])) for n in sorted(self.kinds)]

    def bindings(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(self.rules[name], "destination string, binding_key string, args map<string,string>")

    def route(self, messages: DataFrame, name: str) -> DataFrame:
        return route(messages, self.bindings(name), self.kinds[name])


def subscriptions(messages: DataFrame, filters: DataFrame, topic: str = "topic") -> DataFrame:
    """One row per message and matching MQTT filter (column ``filter``); matched per distinct topic."""
    topics = messages.select(topic).distinct()
    matched = topics.join(small(filters), matchers.mqtt_matches(F.col("filter"), F.col(topic)))
    return messages.join(matched, topic)


def retained(messages: DataFrame, order: str = "offset") -> DataFrame:
    """The last payload of each topic; an empty last payload takes the topic out."""
    last = messages.groupBy("topic").agg(F.max_by("payload", F.col(order)).alias("payload"))
    return last.where(F.length("payload") > 0)


def acl_check(requests: DataFrame, acl: DataFrame, key: str, default: bool = False) -> DataFrame:
    """``allowed`` for each request (key, user, role, resource_type, resource, operation).

    An entry applies if its principal is the user, the role or ``*``, its pattern globs the resource and
    its operation is the request's or ``all``.  A deny outweighs any allow; no entry gives the default.
    """
    q, a = requests.alias("q"), small(acl).alias("a")
    applies = (
        ((F.col("a.principal") == F.col("q.user")) | (F.col("a.principal") == F.col("q.role")) | (F.col("a.principal") == "*"))
        & (F.col("a.resource_type") == F.col("q.resource_type"))
        & ((F.col("a.operation") == F.col("q.operation")) | (F.col("a.operation") == "all"))
        & matchers.glob_matches(F.col("a.resource_name"), F.col("q.resource"))
    )
    met = q.join(a, applies, "left").groupBy(F.col(f"q.{key}").alias(key))
    deny, allow = (F.bool_or(F.col("a.permission") == p) for p in ("deny", "allow"))
    return met.agg(F.coalesce(deny, F.lit(False)).alias("d"), F.coalesce(allow, F.lit(False)).alias("w")).select(
        key, F.when(F.col("d"), F.lit(False)).when(F.col("w"), F.lit(True)).otherwise(F.lit(default)).alias("allowed")
    )


def geo_filter(messages: DataFrame, include: list[str], exclude: list[str], topic: str = "topic") -> DataFrame:
    """Topics to replicate: those listed, if any are, less those excluded."""
    chosen = F.col(topic).isin(include) if include else F.lit(True)
    return messages.where(chosen & (~F.col(topic).isin(exclude) if exclude else F.lit(True)))


def tenant_of(messages: DataFrame, tenants: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds ``tenant``: that of the longest prefix of the topic; null if none."""
    topics = messages.select(topic).distinct()
    met = topics.join(small(tenants.select("tenant", "prefix")), F.col(topic).startswith(F.col("prefix")))
    best = met.groupBy(topic).agg(F.max_by("tenant", F.struct(F.length("prefix"), "tenant")).alias("tenant"))
    return messages.join(best, topic, "left")


def namespace_access(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed``: the tenant is known, the namespace not blocked, and on the allow list if there is one.

    ``rules``: tenant, allowed_namespaces and blocked_namespaces (arrays).
    """
    r = requests.join(small(rules), "tenant", "left")
    listed = (F.coalesce(F.size("allowed_namespaces"), F.lit(0)) <= 0) | F.array_contains("allowed_namespaces", F.col("namespace"))
    blocked = F.coalesce(F.array_contains("blocked_namespaces", F.col("namespace")), F.lit(False))
    known = F.col("blocked_namespaces").isNotNull() | F.col("allowed_namespaces").isNotNull()
    return r.select(*requests.columns, (known & ~blocked & F.coalesce(listed, F.lit(False))).alias("allowed"))
