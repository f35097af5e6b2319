"""Folds over rows in order, for rules that no built-in expression states.

Rows of a key that lie further apart than the rule can see are independent, so a key is cut into
segments at such gaps first, from its totals by time bucket: no window over a whole key is ever taken.
A key that pauses is many tasks; one that never does is a single sequence by the rule's own nature.  Within
a task the rows arrive sorted and are folded as a stream, with only the rule's own state in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import whole
from ..session import ship


def _with_bucket(rows: DataFrame, buckets: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with what ``buckets`` says of their key and ``_bucket``; nulls are keys like others."""
    names = {c: f"_{i}_{c}" for i, c in enumerate([*key, "_bucket"])}
    told = buckets.withColumnsRenamed(names)
    on = [rows[c].eqNullSafe(told[n]) for c, n in names.items()]
    return rows.join(told, on).drop(*names.values(), "_bucket")


def numbered(df: DataFrame, key: list[str], bucket: Column, order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: the row's number, from 0, within its key.

    ``bucket`` must not fall as ``order`` rises.  A row's number is the prefix sum of the counts of the
    buckets before its own plus its place within the bucket, so a task sorts one bucket of a key at most.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(*order)) - 1)
    return _with_bucket(placed, starts, key).withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_start", "_place")


def segments(df: DataFrame, key: list[str], time: str, gap: int) -> DataFrame:
    """Adds ``_segment``: it rises where a key's next row comes more than ``gap`` after the one before.

    Within a bucket as wide as the gap no two rows lie that far apart, so the cuts show in the first and
    last time of each bucket; only those totals are put in order by key.
    """
    wide = max(1, gap)
    rows = df.withColumn("_bucket", whole(F.col(time) - F.pmod(F.col(time), F.lit(wide)), wide))
    by_key = Window.partitionBy(*key).orderBy("_bucket")
    totals = rows.groupBy(*key, "_bucket").agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    apart = F.coalesce((F.col("_from") - F.lag("_to").over(by_key) > gap).cast("int"), F.lit(0))
    cuts = totals.withColumn("_new", apart).select(*key, "_bucket", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_segment"))
    return _with_bucket(rows, cuts, key)


def fold(df: DataFrame, key: list[str], order: list[str], start: Callable[[], Callable[[dict], Iterator[dict]]], schema: str) -> DataFrame:
    """Feed each group's rows, in order, to a fresh ``start()``; rows it yields make the result.

    After a group's last row the function is called once with an empty dict, to let go of what it holds.
    """
    ship(df.sparkSession)
    placed = df.repartition(*key).sortWithinPartitions(*key, *order)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in key)
                if here != at or step is None:
                    if step is not None:
                        out += step({})
                    at, step = here, start()
                out += step(row)
            if out:
                yield _batch(out, names, df_schema)
        if step is not None and (rest := list(step({}))):
            yield _batch(rest, names, df_schema)

    df_schema = _arrow(schema)
    return placed.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _batch(rows: list[dict], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], schema.field(n).type) for n in names], schema=schema)
