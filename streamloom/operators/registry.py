"""Schemas: registration, compatibility and validation of payloads."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fingerprint
from ..session import ship

JSON, AVRO, PROTOBUF = "json", "avro", "protobuf"
NONE, BACKWARD, FORWARD, FULL = "none", "backward", "forward", "full"
MOST_DEPTH = 100


def infer_type(text: str) -> str:
    """Avro for an object that speaks of a record, JSON for another object, Protobuf by its keywords, else JSON."""
    body = text.strip()
    if body.startswith("{"):
        return AVRO if re.search(r'"type"\s*:\s*"record"', body) else JSON
    return PROTOBUF if re.search(r"\bmessage |syntax\s*=", body) else JSON


def infer_type_column(text: Column) -> Column:
    body = F.trim(text)
    return (
        F.when(body.startswith("{") & body.rlike(r'"type"\s*:\s*"record"'), AVRO)
        .when(body.startswith("{"), JSON)
        .when(body.rlike(r"\bmessage |syntax\s*="), PROTOBUF)
        .otherwise(JSON)
    )


# ---------------------------------------------------------------- JSON Schema


def json_errors(schema: dict, value, path: str = "$", depth: int = 0) -> list[str]:
    """What a value violates: type, required, properties, additionalProperties, items, enum, bounds.

    A wrong type hides the node's other errors; lengths are in UTF-8 bytes; bounds are inclusive.
    """
    if depth > MOST_DEPTH:
        return [f"{path}: too deep"]
    kind = schema.get("type")
    if kind and not _is(kind, value):
        return [f"{path}: expected {kind}"]
    errors = []
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        errors.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                errors += json_errors(known[k], v, f"{path}.{k}", depth + 1)
            elif schema.get("additionalProperties") is False:
                errors.append(f"{path}.{k}: not allowed")
    elif isinstance(value, list):
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(value):
                errors += json_errors(schema["items"], v, f"{path}[{i}]", depth + 1)
    elif isinstance(value, str):
        size = len(value.encode())
        errors += [f"{path}: too short"] * (size < schema.get("minLength", 0)) + [f"{path}: too long"] * (size > schema.get("maxLength", size))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        errors += [f"{path}: below minimum"] * (value < schema.get("minimum", value)) + [f"{path}: above maximum"] * (value > schema.get("maximum", value))
    return errors


def _is(kind: str, value) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict),
        "array": isinstance(value, list),
        "string": isinstance(value, str),
        "boolean": isinstance(value, bool),
        "null": value is None,
        "number": number,
        "integer": number and float(value).is_integer(),
    }.get(kind, True)


def _batched(check: Callable[[bytes | str], list[str]]):
    ship()

    def run(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: check(x) if x is not None else ["no payload"])

    return F.pandas_udf(run, T.ArrayType(T.StringType()))


def validate_json(text: str, payload: Column) -> Column:
    """All errors of a JSON payload against any schema of the subset (Arrow batches)."""
    schema = json.loads(text)

    def check(x: bytes | str) -> list[str]:
        try:
            return json_errors(schema, json.loads(x))
        except ValueError:
            return ["$: not JSON"]

    return _batched(check)(payload)


def flat_violations(text: str, payload: Column) -> Column:
    """The same for a flat object schema as a column expression that stays in the JVM: names of the
    fields that are missing, mistyped or out of bounds."""
    schema = json.loads(text)
    value = F.try_parse_json(payload.cast("string"))
    found = []
    for name, rule in schema.get("properties", {}).items():
        field_ = F.try_variant_get(value, f"$.{name}", "string")
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        kinds = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"], "number": ["BIGINT", "DOUBLE", "FLOAT"]}.get(rule.get("type"), [])
        typed = kind.isin(kinds) | (kind.startswith("DECIMAL") if rule.get("type") == "number" else F.lit(False)) if kinds else F.lit(True)
        number = field_.try_cast("double")
        bad = ~typed
        if "minimum" in rule:
            bad = bad | (number < rule["minimum"])
        if "maximum" in rule:
            bad = bad | (number > rule["maximum"])
        if "minLength" in rule:
            bad = bad | (F.octet_length(field_) < rule["minLength"])
        if "maxLength" in rule:
            bad = bad | (F.octet_length(field_) > rule["maxLength"])
        missing = F.when(field_.isNull(), F.lit(name in schema.get("required", [])))
        found.append(F.when(F.coalesce(missing, bad), F.lit(name)))
    found += [F.when(F.try_variant_get(value, f"$.{n}", "string").isNull(), F.lit(n)) for n in schema.get("required", []) if n not in schema.get("properties", {})]
    return F.when(value.isNull(), F.array(F.lit("$"))).otherwise(F.array_compact(F.array(*found)))


# ---------------------------------------------------------------- Avro, Protobuf


def avro_required(text: str) -> list[str]:
    """Fields without a default whose type is no union with null."""
    fields = json.loads(text).get("fields", [])
    return [f["name"] for f in fields if "default" not in f and not (isinstance(f["type"], list) and "null" in f["type"])]


def avro_missing(text: str, payload: Column) -> Column:
    """Required fields that a JSON payload lacks; types are not looked at."""
    wanted = F.array(*[F.lit(n) for n in avro_required(text)]).cast("array<string>")
    return F.array_except(wanted, F.coalesce(F.json_object_keys(payload.cast("string")), F.array().cast("array<string>")))


_FIELD = re.compile(r"(?:^|[{;])\s*(?:repeated\s+|optional\s+|required\s+)?([A-Za-z_][\w.<>, ]*?)\s+(\w+)\s*=\s*(\d+)", re.M)


def protobuf_fields(text: str) -> dict[int, tuple[str, str]]:
    """Field number: (type, name) of a message text."""
    return {int(n): (kind, name) for kind, name, n in _FIELD.findall(re.sub(r"//.*", "", text)) if kind not in ("syntax", "option")}


def wire_fields(data: bytes) -> set[int] | None:
    """Field numbers on the wire; None if the bytes are no message."""
    at, found = 0, set()

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7
            if shift > 63:
                raise IndexError

    try:
        while at < len(data):
            tag = varint()
            kind = tag & 7
            if tag >> 3 == 0 or kind not in (0, 1, 2, 5):
                return None
            if kind == 0:
                varint()
            else:
                size = {1: 8, 5: 4}.get(kind) or varint()
                at += size
            if at > len(data):
                return None
            found.add(tag >> 3)
    except IndexError:
        return None
    return found


def validate_protobuf(text: str, payload: Column) -> Column:
    """Errors of a binary payload: every field number of the text must be there (Arrow batches)."""
    wanted = protobuf_fields(text)

    def check(x: bytes | str) -> list[str]:
        found = wire_fields(x.encode() if isinstance(x, str) else bytes(x))
        return ["not a message"] if found is None else [f"field {n} missing" for n in sorted(wanted) if n not in found]

    return _batched(check)(payload)


# ---------------------------------------------------------------- compatibility


def compatible(kind: str, old: str, new: str, mode: str) -> list[str]:
    """Why ``new`` cannot follow ``old``; empty if it can."""
    if mode == NONE:
        return []
    checks = {JSON: (_json_backward, _json_forward), AVRO: (_avro_backward, _avro_forward), PROTOBUF: (_proto_backward, _proto_forward)}[kind]
    return (checks[0](old, new) if mode in (BACKWARD, FULL) else []) + (checks[1](old, new) if mode in (FORWARD, FULL) else [])


def _json_backward(old: str, new: str) -> list[str]:
    a, b = json.loads(old), json.loads(new)
    pa, pb = a.get("properties", {}), b.get("properties", {})
    gone = [f"required {n} is gone" for n in a.get("required", []) if n not in pb]
    return gone + [f"type of {n} changed" for n in pa if n in pb and pa[n].get("type") != pb[n].get("type")]


def _json_forward(old: str, new: str) -> list[str]:
    a, b = json.loads(old), json.loads(new)
    return [f"required {n} is new" for n in b.get("required", []) if n not in a.get("properties", {})]


def _avro_backward(old: str, new: str) -> list[str]:
    names = {f["name"] for f in json.loads(new).get("fields", [])}
    return [f"field {f['name']} is gone" for f in json.loads(old).get("fields", []) if f["name"] not in names]


def _avro_forward(old: str, new: str) -> list[str]:
    names = {f["name"] for f in json.loads(old).get("fields", [])}
    return [f"field {f['name']} has no default" for f in json.loads(new).get("fields", []) if f["name"] not in names and "default" not in f]


def _proto_backward(old: str, new: str) -> list[str]:
    a, b = protobuf_fields(old), protobuf_fields(new)
    return [f"type of field {n} changed" for n in a if n in b and a[n][0] != b[n][0]]


def _proto_forward(old: str, new: str) -> list[str]:
    b = protobuf_fields(new)
    return [f"field {n} is gone" for n in protobuf_fields(old) if n not in b]


class Incompatible(ValueError):
    """A schema that may not follow the one before it."""


@dataclass
class Registry:
    """Schema versions by subject; ids count over all subjects.  Small metadata, kept on the driver."""

    modes: dict[str, str] = field(default_factory=dict)
    versions: list[dict] = field(default_factory=list)
    last_id: int = 0

    def register(self, subject: str, text: str, kind: str | None = None, at: str = "") -> dict:
        """The version with this text if the subject has it; else a new one, checked against the latest."""
        kind = kind or infer_type(text)
        print_ = hashlib.sha256(text.encode()).hexdigest()[:32]
        own = self.list(subject)
        for v in own:
            if v["fingerprint"] == print_:
                return v
        if own and (why := compatible(kind, own[-1]["text"], text, self.modes.get(subject, BACKWARD))):
            raise Incompatible("; ".join(why))
        self.last_id += 1
        made = {"id": self.last_id, "subject": subject, "version": len(own) + 1, "type": kind, "text": text, "fingerprint": print_, "created_at": at}
        self.versions.append(made)
        return made

    def list(self, subject: str) -> list[dict]:
        return [v for v in self.versions if v["subject"] == subject]

    def get(self, subject: str, version: int) -> dict | None:
        return next((v for v in self.list(subject) if v["version"] == version), None)

    def latest(self, subject: str) -> dict | None:
        return (self.list(subject) or [None])[-1]

    def by_id(self, number: int) -> dict | None:
        return next((v for v in self.versions if v["id"] == number), None)

    def subjects(self) -> list[str]:
        return sorted({v["subject"] for v in self.versions})

    def delete(self, subject: str, version: int | None = None) -> None:
        """Drop a subject, or one version; later versions move up."""
        self.versions = [v for v in self.versions if v["subject"] != subject or (version is not None and v["version"] != version)]
        for i, v in enumerate(self.list(subject)):
            v["version"] = i + 1

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "id long, subject string, version int, type string, text string, fingerprint string, created_at string"
        return spark.createDataFrame([tuple(v[k] for k in ("id", "subject", "version", "type", "text", "fingerprint", "created_at")) for v in self.versions], schema)


def versions(registrations: DataFrame) -> DataFrame:
    """Versions that a log of registrations (subject, text, at) makes: a text counts where its subject first has it."""
    first = registrations.groupBy("subject", fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("at").alias("first_at"))
    order = Window.partitionBy("subject").orderBy("first_at", "fingerprint")
    return first.withColumn("version", F.row_number().over(order).cast("long"))


def enforce(messages: DataFrame, schema_id: Column, violations: Column) -> DataFrame:
    """Adds ``schema_status``: no_schema without an id, invalid with violations, else ok."""
    return messages.withColumn("schema_status", F.when(schema_id.isNull(), "no_schema").when(F.size(violations) > 0, "invalid").otherwise("ok"))
