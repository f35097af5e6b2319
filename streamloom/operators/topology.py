"""Topologies: a source, a chain of operators and a sink, over batch or streaming DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import messages

Transform = Callable[[DataFrame], DataFrame]
#: Policies for a row whose transform fails.
SKIP, DEAD_LETTER, REJECT = "skip", "dlq", "reject"

_named: dict[str, Transform] = {}


class TopologyError(ValueError):
    """A topology that is missing, given twice, running or not well formed."""


def register_transform(name: str, transform: Transform) -> None:
    """Name a transform, for chains that refer to it by name."""
    _named[name] = transform


def transforms() -> list[str]:
    return sorted(_named)


def remove_transform(name: str) -> None:
    _named.pop(name, None)


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, as they were."""
    return df.where(condition)


def map_rows(df: DataFrame, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Columns replaced by expressions over the old row; rows whose ``keep`` is not true are dropped."""
    out = df.withColumns(columns | ({"_keep": keep} if keep is not None else {}))
    return out.where("_keep").drop("_keep") if keep is not None else out


def flat_map(df: DataFrame, name: str, values: Column) -> DataFrame:
    """A row for each element of an array column; an empty or null array drops the row."""
    return df.withColumn(name, F.explode(values))


def apply_named(df: DataFrame, name: str) -> DataFrame:
    """A registered transform; rows pass an unknown one unchanged."""
    return _named[name](df) if name in _named else df


def staged_payload(df: DataFrame, stages: list[tuple[Column, Column, Column]], policy: str = SKIP) -> dict[str, DataFrame]:
    """A pipeline over ``payload``: each stage is (ok, drop, new payload), columns over the current row.

    Where ``ok`` is not true the policy decides: ``skip`` keeps the payload as it is and goes on, the
    others take the row out with ``error`` set.  Gives the rows ``ok``, ``dlq`` and ``rejected``.
    """
    out = df.withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string"))
    for i, (ok, drop, new) in enumerate(stages):
        live = F.col("status") == "ok"
        good = F.coalesce(ok, F.lit(False))
        out = out.withColumns({"_good": good, "_drop": F.coalesce(drop, F.lit(False)), "_new": F.when(good, new)})
        failed = live & ~F.col("_good")
        out = out.withColumns(
            {
                "error": F.when(failed & F.lit(policy != SKIP), F.lit(f"stage {i} failed")).otherwise(F.col("error")),
                "payload": F.when(live & F.col("_good") & ~F.col("_drop"), F.coalesce("_new", "payload")).otherwise(F.col("payload")),
                "status": F.when(failed & F.lit(policy != SKIP), F.lit(policy)).when(live & F.col("_good") & F.col("_drop"), F.lit("dropped")).otherwise(F.col("status")),
            }
        ).drop("_good", "_drop", "_new")
    return {
        "ok": out.where("status = 'ok'").drop("status", "error"),
        "dlq": out.where(F.col("status") == DEAD_LETTER).drop("status"),
        "rejected": out.where(F.col("status") == REJECT).drop("status"),
    }


@dataclass
class Topology:
    """``Topology("t").source("events.click").filter(c).map({...}).sink("out")`` - then run it."""

    name: str
    topic: str = ""
    partitions: list[int] | None = None
    chain: list[Transform] = field(default_factory=list)
    target: str = ""
    parallelism: int = 1

    def source(self, topic: str, partitions: list[int] | None = None) -> Topology:
        self.topic, self.partitions = topic, partitions
        return self

    def filter(self, condition: Column) -> Topology:
        self.chain.append(lambda d: filter_rows(d, condition))
        return self

    def map(self, columns: dict[str, Column], keep: Column | None = None) -> Topology:
        self.chain.append(lambda d: map_rows(d, columns, keep))
        return self

    def flat_map(self, name: str, values: Column) -> Topology:
        self.chain.append(lambda d: flat_map(d, name, values))
        return self

    def named(self, name: str) -> Topology:
        self.chain.append(lambda d: apply_named(d, name))
        return self

    def then(self, transform: Transform) -> Topology:
        self.chain.append(transform)
        return self

    def sink(self, topic: str) -> Topology:
        self.target = topic
        return self

    def build(self, log: DataFrame) -> DataFrame:
        """Source and chain as one plan; nothing runs."""
        out = messages.topic_source(log, self.topic, self.partitions)
        for step in self.chain:
            out = step(out)
        return out

    def run_batch(self, log: DataFrame) -> DataFrame | None:
        """The chain's result, republished to the sink's topic if it names one."""
        return messages.topic_sink(self.build(log), self.target)

    def start_stream(self, log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """The chain over a streaming log, appended to Parquet; offsets persist in the checkpoint."""
        out = self.build(log)
        if self.target:
            out = out.withColumn("topic", F.lit(self.target))
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def validate(self, topics: set[str]) -> None:
        """Name of 1 to 255 characters; source and sink must exist; parallelism is 1 at least."""
        if not 1 <= len(self.name) <= 255:
            raise TopologyError("a topology's name has 1 to 255 characters")
        for topic in filter(None, (self.topic, self.target)):
            if topic not in topics:
                raise TopologyError(f"no topic {topic}")
        if not self.topic or not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,254}", self.topic):
            raise TopologyError("a topology needs a source topic")
        self.parallelism = max(1, self.parallelism)


class Topologies:
    """The topologies of a session: created, started, stopped, deleted and listed by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[str, Topology] = {}
        self.running: dict[str, StreamingQuery] = {}

    def create(self, topology: Topology) -> None:
        if topology.name in self.known:
            raise TopologyError(f"{topology.name} exists")
        topology.parallelism = max(1, topology.parallelism)
        self.known[topology.name] = topology

    def start(self, name: str, log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
        """Starting a running topology changes nothing."""
        if self.state(name) != "running":
            self.running[name] = self.known[name].start_stream(log, path, checkpoint)
        return self.running[name]

    def stop(self, name: str) -> None:
        if name not in self.known:
            raise TopologyError(f"no topology {name}")
        if query := self.running.pop(name, None):
            query.stop()

    def delete(self, name: str) -> None:
        if self.state(name) == "running":
            raise TopologyError(f"{name} is running")
        del self.known[name]

    def state(self, name: str) -> str:
        if name not in self.known:
            raise TopologyError(f"no topology {name}")
        query = self.running.get(name)
        return "running" if query is not None and query.isActive else "stopped"

    def list(self) -> list[tuple[str, str]]:
        return [(n, self.state(n)) for n in sorted(self.known)]
