"""Consumer groups: assignment, membership, committed offsets and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION_NS = 30_000_000_000
#: Offsets that a commit may name.
MOST_OFFSET = 2**62


def _numbered(members: DataFrame) -> DataFrame:
    return members.select("group", "member", (F.row_number().over(Window.partitionBy("group").orderBy("member")) - 1).alias("n"))


def _sized(members: DataFrame) -> DataFrame:
    return members.groupBy("group").agg(F.count(F.lit(1)).alias("m"))


def assign_range(members: DataFrame, partitions: int) -> DataFrame:
    """Contiguous ranges in order of member id; the first ``partitions mod members`` get one more."""
    return _assign(members, partitions, _range_slot(F.col("p"), F.lit(partitions), F.col("m")))


def _range_slot(p: Column, n: Column, m: Column) -> Column:
    q, r = F.floor(n / m), n % m
    return F.when(p < r * (q + 1), F.floor(p / (q + 1))).otherwise(r + F.floor((p - r * (q + 1)) / F.greatest(q, F.lit(1))))


def assign_round_robin(members: DataFrame, partitions: int) -> DataFrame:
    """Partition i to member i modulo the number of members."""
    return _assign(members, partitions, F.col("p") % F.col("m"))


def _assign(members: DataFrame, partitions: int, slot: Column) -> DataFrame:
    spread = _sized(members).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)))).withColumn("n", slot.cast("int"))
    return spread.join(_numbered(members), ["group", "n"]).select("group", F.col("p").alias("partition_id"), "member")


def assign_sticky(members: list[str], partitions: int, previous: dict[int, str]) -> dict[int, str]:
    """One group's assignment that moves as little as it can (plain Python: a few thousand partitions).

    Partitions stay with an owner still there; the rest go to whoever has least (ties: least id); then
    partitions move from the fullest to the emptiest member until none has more than the floor of the
    mean plus one while another has less than the floor.
    """
    if not members:
        return {}
    names = sorted(members)
    held: dict[str, list[int]] = {m: [] for m in names}
    for p in range(partitions):
        owner = previous.get(p)
        if owner in held:
            held[owner].append(p)
    taken = {p for own in held.values() for p in own}
    for p in sorted(set(range(partitions)) - taken):
        held[min(names, key=lambda m: (len(held[m]), m))].append(p)
    mean = partitions // len(names)
    while True:
        fullest = max(names, key=lambda m: len(held[m]))
        emptiest = min(names, key=lambda m: len(held[m]))
        if len(held[fullest]) <= mean + 1 and (len(held[emptiest]) >= mean or len(held[fullest]) <= mean):
            break
        held[emptiest].append(held[fullest].pop())
    return {p: m for m in names for p in held[m]}


def live_members(heartbeats: DataFrame, now_ns: int, timeout_ns: int = SESSION_NS) -> DataFrame:
    """Members whose last heartbeat is ``timeout_ns`` old at most."""
    last = heartbeats.groupBy("group", "member").agg(F.max("at_ns").alias("last_ns"))
    return last.where(F.lit(now_ns) - F.col("last_ns") <= timeout_ns)


def expired_members(heartbeats: DataFrame, now_ns: int, timeout_ns: int = SESSION_NS) -> DataFrame:
    last = heartbeats.groupBy("group", "member").agg(F.max("at_ns").alias("last_ns"))
    return last.where(F.lit(now_ns) - F.col("last_ns") > timeout_ns)


def committed(commits: DataFrame, keys: tuple[str, ...] = ("group", "topic", "partition_id")) -> DataFrame:
    """The last commit of each group and partition, which may go backwards; 0 and absurd offsets are passed over."""
    good = commits.where((F.col("offset") > 0) & (F.col("offset") <= MOST_OFFSET))
    return good.groupBy(*keys).agg(F.max_by("offset", F.struct("at_ns", "offset")).alias("committed"))


def member_offsets(assignments: DataFrame, committed: DataFrame) -> DataFrame:
    """Committed offset of each assigned partition; 0 if none."""
    return assignments.join(committed, ["group", "partition_id"], "left").select(*assignments.columns, F.coalesce("committed", F.lit(0).cast("long")).alias("committed"))


def lag(watermarks: DataFrame, committed: DataFrame) -> DataFrame:
    """Per group and partition how far the commit is behind the last offset, never negative."""
    behind = F.greatest(F.col("high_watermark") - F.col("committed"), F.lit(0)).cast("long")
    return committed.join(watermarks, ["topic", "partition_id"]).select("group", "topic", "partition_id", "high_watermark", "committed", behind.alias("lag"))


def detail(assignments: DataFrame) -> DataFrame:
    """Each member with its partitions, in order."""
    return assignments.groupBy("group", "member").agg(F.array_sort(F.collect_list("partition_id")).alias("partitions"))
