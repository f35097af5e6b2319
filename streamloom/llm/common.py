"""Plumbing the corpus operators share: staged tables, code shipping and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship as ship

#: Word length of the shingles that the near-duplicate operators compare.
SHINGLE = 5
#: UTF-8 bytes hashed in one numpy call; bounds the working set of a Python worker.
SLICE_BYTES = 1_000_000

_staged: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


# ------------------------------------------------------------------ driver side


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one if unset.

    The temporary folder is for a session on one machine (tests, notebooks); a cluster has to name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or Path(tempfile.mkdtemp(prefix="streamloom-")).as_uri()
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and fixes any value (partition ids, row ids)
    that would otherwise be computed anew on a retry.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Tables staged within the block are deleted at its end, except those in ``keep`` by then.

    What leaves the block must be staged itself, or read only tables that stay.
    """
    at = len(_staged)
    try:
        yield
    finally:
        made, _staged[at:] = _staged[at:], []
        stays = {df.staged_at for df in keep}
        for spark, path in made:
            if path in stays:
                _staged.append((spark, path))
            else:
                _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that only collected plans still held; Spark drops them on a driver GC."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone by now; the next path may belong to another
            continue


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ executor side


def give_back() -> None:
    """Return to the system what this process has freed; workers outlive their tasks, and stages add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving back its memory at a task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``most`` bytes each; one row at least."""
    n = len(column)
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word: ASCII letters and digits, and every byte of a non-ASCII character.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_MULT, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x


class Words:
    """Word hashes of a run of texts: ``hashes[first[i]:first[i + 1]]`` are those of text i.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased.  ``start`` and
    ``end`` are byte offsets into the concatenated lower-cased texts, ``base`` where each text begins.
    """

    def __init__(self, texts: pa.Array):
        lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        if isinstance(lowered, pa.ChunkedArray):
            lowered = lowered.combine_chunks()
        offsets = np.frombuffer(lowered.buffers()[1], dtype=np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
        data = lowered.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
        self.base = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        n = len(raw)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = _WORD[raw]
        begins = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cuts = self.base[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        if n:  # a text's end ends its word
            begins[cuts] |= inside[1:-1][cuts]
            last[cuts - 1] |= inside[1:-1][cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(last) + 1
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.base)
        self.first[-1] = len(self.start)

    def shingles(self, k: int = SHINGLE, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within a text, and where those of each text begin.

        With ``short``, a text of one to ``k - 1`` words has one: that of all its words.
        """
        h, first = self.hashes, self.first
        words = np.diff(first)
        counts = np.maximum(words - k + 1, 0)
        brief = np.flatnonzero((words > 0) & (words < k)) if short else np.zeros(0, np.int64)
        counts[brief] = 1
        at = np.concatenate([[0], np.cumsum(counts)])
        if not at[-1]:
            return np.zeros(0, np.uint64), at
        padded = np.concatenate([h, np.zeros(k, np.uint64)])
        keep = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
        rolled = padded[: len(h)].copy()
        for i in range(1, k):
            rolled = rolled * _MULT + padded[i : len(h) + i]
        out = rolled[keep]
        for t in brief.tolist():
            x = words[t : t + 1].astype(np.uint64)
            for y in range(first[t], first[t + 1]):
                x = mix(x * _MULT + h[y : y + 1])
            out[at[t]] = x[0]
        return mix(out), at


def complete_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup batches sorted by their first ``keys`` integer columns: tables of whole groups, and the
    rows where each begins, followed by the number of rows.  A group must fit in memory."""
    rest: pa.Table | None = None

    def cuts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        new[0] = True
        for k in range(keys):
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        at = cuts(table)
        rest = table.slice(at[-1])
        if at[-1]:
            yield table.slice(0, at[-1]).combine_chunks(), at
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.array([0, len(rest)])


# ------------------------------------------------------------------ distinct texts and components


def text_key(text: Column) -> list[Column]:
    """A 128-bit key of a text as two longs; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def spread(df: DataFrame, *keys: str, on: int | None = None) -> DataFrame:
    """Rows of equal ``keys`` (the first ``on``, if given) together and all in order, for ``complete_groups``;
    groups must be small."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys[:on]).sortWithinPartitions(*keys)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): v and the least vertex of its component, as label.

    Each round points every vertex at its least neighbour, shortens the pointers, and contracts the
    edges to what they point at; a round's tables are staged, and deleted but for the labels (v, label),
    which are staged too.  Only vertices with an edge are listed.
    Hubs cost a partial aggregate and joins that adaptive execution can split; nothing is collected.
    """
    kept: list[DataFrame] = []
    with scratch(kept):
        edges = stage(edges.where("a <> b").select("a", "b").distinct(), "edges")
        labels: DataFrame | None = None
        for _ in range(rounds):
            if edges.isEmpty():
                break
            round_: list[DataFrame] = []
            with scratch(round_):
                both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                up = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
                up = stage(up, "pointers")
                for _ in range(2):
                    top = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
                    up = up.join(top, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
                up = stage(up, "pointers")
                to_a, to_b = (up.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
                edges = stage(edges.join(to_a, "a").join(to_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
                if labels is None:
                    labels = up.select("v", F.col("p").alias("label"))
                else:
                    labels = labels.join(up.select(F.col("v").alias("label"), "p"), "label", "left").select("v", F.coalesce("p", "label").alias("label"))
                labels = stage(labels, "labels")
                round_ += [edges, labels]
        else:
            raise RuntimeError("components did not settle")
        if labels is None:
            labels = stage(edges.select(F.col("a").alias("v"), F.col("b").alias("label")), "labels")
        kept.append(labels)
    return labels
