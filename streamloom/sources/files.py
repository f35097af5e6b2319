"""Stored forms of the log: Parquet tiers, merges of them, exports and encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by topic, sorted by partition and offset so that row-group statistics prune both."""
    ordered = log.repartition("topic", "partition_id").sortWithinPartitions("topic", "partition_id", "offset")
    ordered.write.mode(mode).partitionBy("topic").option("parquet.bloom.filter.enabled#routing_key", "true").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def archive(log: DataFrame, path: str) -> None:
    """The cold tier: zstandard-compressed Parquet."""
    log.write.mode("append").option("compression", "zstd").partitionBy("topic").parquet(path)


def tiered(hot: DataFrame, warm: DataFrame, cold: DataFrame, key: tuple[str, ...] = ("topic", "partition_id", "offset")) -> DataFrame:
    """All messages of three tiers; of one held by several, the hottest copy."""
    parts = [d.withColumn("tier_rank", F.lit(i)) for i, d in enumerate((hot, warm, cold))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = Window.partitionBy(*key).orderBy("tier_rank")
    return every.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def merge_tables(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several tables; of equal keys the row of the latest table. Tombstones are rows like others."""
    every = None
    for i, t in enumerate(tables):
        part = t.withColumn("_age", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_age")))).where("_r = 1").drop("_r", "_age")


def encrypted(payload: Column, key: Column) -> Column:
    """AES-GCM ciphertext of a payload (16, 24 or 32 byte key)."""
    return F.aes_encrypt(payload, key, F.lit("GCM"))


def decrypted(payload: Column, key: Column) -> Column:
    return F.try_aes_decrypt(payload, key, F.lit("GCM"))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def backup(spark: SparkSession, source: str, target: str) -> None:
    """Copy a stored log; restoring is the same the other way."""
    spark.read.parquet(source).write.mode("errorifexists").partitionBy("topic").parquet(target)


def exposition(samples: DataFrame) -> DataFrame:
    """Metric samples (name, kind, labels, value) as lines of the text exposition format."""
    labels = keys.label_key(F.col("labels"))
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return samples.select("name", F.concat(F.col("name"), F.when(labels != "", F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), shown).alias("line"))
