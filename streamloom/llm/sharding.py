"""Byte-balanced contiguous shards (SQL functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def byte_shards(df: DataFrame, n_shards: int, size: Column, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Cut ``df``, in the order given, into ``n_shards`` contiguous runs of nearly equal ``size``.

    Adds ``shard`` (0 to ``n_shards - 1``) and ``slot`` (gapless from 0 within a shard).  The rows are
    range partitioned once; every partition's total gives its start by a prefix sum over the few
    totals, and a running sum within the partition completes each row's global offset.  A row belongs
    to the shard whose equal share holds the row's middle byte, so a cut misses its target by half a
    row at most.  No shard is ever gathered into one task: a hot key spreads over the ranges as far
    as the order tells its rows apart.

    Nulls: a null in ``size`` counts as 0 and nulls in the order come first.  Repeated rows stay
    neighbours.  An empty table gives no rows.  Input columns named shard or slot (in any case) give way to
    the new ones; those starting with ``_sh_`` are reserved.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    n = partitions or common.shuffle_partitions(spark)
    keys = [f"_sh_k{i}" for i in range(len(order))]
    rows = df.select(*[df[c] for c in names], F.coalesce(size.cast("long"), F.lit(0)).alias("_sh_size"), *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    # written once: the sampled ranges and the partition numbers must not change on a retry
    placed = common.stage(rows.repartitionByRange(n, *keys).withColumn("_sh_part", F.spark_partition_id()), "shards")
    totals = placed.groupBy("_sh_part").agg(F.sum("_sh_size").alias("_sh_bytes"), F.count(F.lit(1)).alias("_sh_rows"))
    # one row for each partition: as many as there are shuffle partitions, whatever the input
    before = Window.orderBy("_sh_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_sh_part",
        F.coalesce(F.sum("_sh_bytes").over(before), F.lit(0)).alias("_sh_b0"),
        F.coalesce(F.sum("_sh_rows").over(before), F.lit(0)).alias("_sh_r0"),
        F.sum("_sh_bytes").over(Window.partitionBy()).alias("_sh_all"),
    )
    inside = Window.partitionBy("_sh_part").orderBy(*keys)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    running = placed.select(
        "*",
        F.coalesce(F.sum("_sh_size").over(run), F.lit(0)).alias("_sh_b"),
        F.row_number().over(inside).alias("_sh_r"),
    )
    middle = F.expr("cast(2 * (_sh_b0 + _sh_b) + _sh_size as decimal(25, 0))")
    share = F.expr(f"cast(_sh_mid * {n_shards} div (2 * greatest(_sh_all, 1)) as int)")
    cut = running.join(F.broadcast(starts), "_sh_part").withColumn("_sh_mid", middle).select(
        *names,
        F.least(F.lit(n_shards - 1), share).alias("shard"),
        (F.col("_sh_r0") + F.col("_sh_r") - 1).alias("_sh_row"),
    )
    firsts = cut.groupBy(F.col("shard").alias("_sh_s")).agg(F.min("_sh_row").alias("_sh_first"))  # n_shards rows
    return cut.join(F.broadcast(firsts), F.col("shard") == F.col("_sh_s")).select(
        *names, "shard", (F.col("_sh_row") - F.col("_sh_first")).alias("slot")
    )
