"""Jaccard self-join of documents on word shingles: a chosen-path join, then exact verification.

1. Equal texts are folded into one representative; every representative gets a min-hash signature.
2. Chosen path: in each of some independent trees (as many as the
   target recall asks for), a node picks coordinates of the signature at
   random (1 / threshold of them on average) and deals its members out by their value there.  A pair of
   similarity s goes the same way with probability s, so pairs at the threshold are expected to stay
   together at every level while others part.  Small nodes are compared by brute force on signatures,
   large ones are split again.  A large node that kept at least the threshold's share of its parent's
   members, or is still large after ``depth`` levels, holds members that agree nearly everywhere and is
   taken as it is: all its members may be similar.
3. Members that may be similar are chained into clusters.  Every pair within a cluster is verified on the
   full shingle sets: clusters are cut into blocks and each pair of blocks is a matrix product, so neither
   a task nor an output ever holds all pairs of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
#: Coordinates of a signature, independent trees, and the most levels of a tree.
COORDINATES, DEPTH = 64, 6
#: Share of the links at the threshold itself that the trees are to find; it sets how many are grown.
RECALL = 0.99
#: Members of a node that are compared by brute force.
LEAF = 96
#: Share of agreeing coordinates that makes a candidate: over four deviations under the threshold.
CANDIDATE = 0.5625
#: Representatives in a block of a cluster, whatever its size.
BLOCK = 512

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_SALT = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Min-hash signatures of the non-empty sets ``values[at[i]:at[i + 1]]``, a row each; zeros if empty."""
    out = np.zeros((len(at) - 1, COORDINATES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        x = (values >> np.uint64(32)).astype(np.uint32)
        for t in range(COORDINATES):
            out[full, t] = np.minimum.reduceat((x ^ _XOR[t]) * _ODD[t], at[full])
    return out


def children(path: np.ndarray, signature: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path of the child) for every coordinate that a row's node picks."""
    rows, paths = [], []
    bound = np.uint64(2**64 / (threshold * COORDINATES))
    for t in range(COORDINATES):
        chosen = np.flatnonzero(common.mix(path + _SALT[t]) < bound)
        rows.append(chosen)
        paths.append(common.mix(path[chosen] * np.uint64(0x9E3779B97F4A7C15) + _SALT[t]) ^ common.mix(signature[chosen, t].astype(np.uint64) + _SALT[t]))
    return np.concatenate(rows), np.concatenate(paths)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Trees that find a pair of similarity ``threshold`` with probability ``recall``.

    Worst case: no node gets small before the last level.  With e(k) the chance that no path of k levels
    keeps the pair together, e(0) = 0 and e(k + 1) = (1 - p (1 - e(k))) ** n for the n coordinates that
    agree, each picked with probability p.
    """
    lost, p, n = 0.0, 1 / (threshold * COORDINATES), threshold * COORDINATES
    for _ in range(depth):
        lost = (1 - p * (1 - lost)) ** n
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(lost))))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, given pairs within 0 to n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) else np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return data[offsets[0] : offsets[-1]].view(np.uint32).reshape(len(column), width)


def representatives(df: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, k1, k2), and one per distinct text with words: rid, id, k1, k2, signature."""
    common.ship(df.sparkSession)
    source = df.select(df[doc_id].alias("id"), *common.text_key(df[text]), df[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            for a, b in common.slices(column):
                values, at = common.Words(column.slice(a, b - a)).shingles(short=True)
                rows = signatures(values, at)
                full = np.diff(at) > 0
                made = pa.array([r.tobytes() if f else None for r, f in zip(rows, full, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(3)], made], ["id", "k1", "k2", "signature"])

    signed = common.stage(source.mapInArrow(common.tidy(run), f"id {kind}, k1 long, k2 long, signature binary"), "signatures")
    chosen = signed.where("signature is not null").dropDuplicates(["k1", "k2"]).withColumn("rid", F.monotonically_increasing_id())
    return signed.select("id", "k1", "k2"), common.stage(chosen, "representatives")


def chosen_path_edges(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """Candidate links (a, b) between representatives; every candidate pair is connected by them."""
    spark = reps.sparkSession
    roots = common.mix(np.arange(1, runs_for(recall, threshold, depth) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def deal(rid: np.ndarray, path: np.ndarray, size: np.ndarray, signature: np.ndarray) -> pa.RecordBatch:
        """Rows of the children, each with the size of the node it comes from."""
        rows, paths = children(path, signature, threshold)
        return pa.RecordBatch.from_pydict({"rid": pa.array(rid[rows], pa.int64()), "path": pa.array(paths.view(np.int64), pa.int64()), "parent": pa.array(size[rows], pa.int64())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, signature = batch.column(0).to_numpy(), _matrix(batch.column(1), COORDINATES)
            for root in roots:
                yield deal(rid, np.full(len(rid), root), np.full(len(rid), 2**62), signature)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, path, size = (batch.column(k).to_numpy() for k in range(3))
            yield deal(rid, path.view(np.uint64), size, _matrix(batch.column(3), COORDINATES))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = int(np.ceil(CANDIDATE * COORDINATES))
        for table, at in common.complete_groups(batches, 1):
            rid, signature = table.column(1).to_numpy(), _matrix(table.column(2), COORDINATES)
            out_a, out_b = [], []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = signature[x:y]
                a, b = np.nonzero(np.triu((own[:, None, :] == own[None, :, :]).sum(axis=2) >= need, 1))
                if len(a):
                    root = local_roots(y - x, a, b)
                    moved = np.flatnonzero(root != np.arange(y - x))
                    out_a.append(rid[x:y][moved])
                    out_b.append(rid[x:y][root[moved]])
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})

    slim = reps.select("rid", "signature")
    dealt = "rid long, path long, parent long"
    members = common.stage(slim.mapInArrow(common.tidy(first), dealt), "nodes")
    found = []
    for level in range(1, depth + 1):
        nodes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.max("parent").alias("parent")).where("n > 1")
        # nodes with the same members, as most small ones are in several trees, are compared or chained once;
        # those that are split again keep all their paths: each is an independent try
        alike = (F.col("n") > LEAF) & ((F.col("n") >= threshold * F.col("parent")) | F.lit(level == depth))
        nodes = nodes.withColumn("alike", alike).withColumn("own", F.when((F.col("n") > LEAF) & ~F.col("alike"), F.col("path")))
        nodes = common.stage(nodes.groupBy("n", "x", "alike", "own").agg(F.min("path").alias("path")).select("n", "path", "alike"), "nodes")
        small = members.join(nodes.where(F.col("n") <= LEAF).select("path"), "path").select("path", "rid")
        small = common.spread(small.join(slim, "rid").select("path", "rid", "signature"), "path")
        found.append(common.stage(small.mapInArrow(common.tidy(leaves), "a long, b long"), "candidates"))
        large = nodes.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        held = members.select("rid", "path").join(large, "path")
        same = held.where("alike")
        least = same.groupBy("path").agg(F.min("rid").alias("b"))
        found.append(same.join(least, "path").select(F.col("rid").alias("a"), "b").where("a <> b"))
        if level < depth:
            members = common.stage(held.where("not alike").join(slim, "rid").select("rid", "path", "n", "signature").mapInArrow(common.tidy(further), dealt), "nodes")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def overlaps(values: list[np.ndarray], left: int) -> np.ndarray:
    """Shared members of sets 0 to left - 1 with all sets (or with those from left on, if any).

    A matrix product over the members that two sets or more have, a strip of columns at a time.
    """
    n = len(values)
    other = slice(left, n) if left < n else slice(0, n)
    rows = np.repeat(np.arange(n), [len(v) for v in values])
    member, inverse, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    rows, inverse = rows[keep], inverse[keep]
    if not len(rows):
        return np.zeros((left, other.stop - other.start), np.float32)
    column = (np.cumsum(count > 1) - 1)[inverse]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((left, other.stop - other.start), np.float32)
    strip = max(64, 4_000_000 // n)
    for c in range(0, int(column[-1]) + 1, strip):
        a, b = np.searchsorted(column, [c, c + strip])
        dense = np.zeros((n, min(strip, int(column[-1]) + 1 - c)), np.float32)
        dense[rows[a:b], column[a:b] - c] = 1
        total += dense[:left] @ dense[other].T
    return total


def verify(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact links within clusters: (rid, root, n_links) for each member and pair of blocks.

    ``members``: cluster, size, rid, text.  ``root`` is the least member linked to it within the block
    pair, itself if none; ``n_links`` counts its links there, each pair of members in one block pair.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid"), F.col("g")).cast("int")
    placed = members.withColumn("g", blocks).withColumn("own", own)
    dealt = placed.select("cluster", "rid", "text", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).select(
        "cluster",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "own",
        "rid",
        "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in common.complete_groups(batches, 3):
            i, j, side, rid = (table.column(k).to_numpy() for k in (1, 2, 3, 4))
            texts = table.column(5).combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            sets: list[np.ndarray] = []
            for a, b in common.slices(texts):
                values, cut = common.Words(texts.slice(a, b - a)).shingles(short=True)
                sets += [np.unique(values[p:q]) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            out: list[list[np.ndarray]] = [[], [], []]
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                # one row for each member, the lower block first
                _, pick = np.unique(rid[x:y], return_index=True)
                pick = x + pick[np.argsort(side[x:y][pick], kind="stable")]
                names = rid[pick]
                across = i[x] != j[x]
                left = int((side[pick] == i[x]).sum()) if across else len(pick)
                if len(pick) < 2 or (across and left in (0, len(pick))):
                    continue
                own_sets = [sets[k] for k in pick.tolist()]
                sizes = np.array([len(s) for s in own_sets], dtype=np.float32)
                shared = overlaps(own_sets, left)
                union = sizes[:left, None] + (sizes[left:] if across else sizes)[None, :] - shared
                linked = (shared > 0) & (shared >= threshold * union - 1e-4)
                if not across:
                    np.fill_diagonal(linked, False)
                a, b = np.nonzero(linked)
                if not len(a):
                    continue
                b = b + left if across else b
                count = np.bincount(a, minlength=len(names)) + (np.bincount(b, minlength=len(names)) if across else 0)
                order = np.argsort(names, kind="stable")
                place = np.empty(len(names), np.int64)
                place[order] = np.arange(len(names))
                root = names[order][local_roots(len(names), place[a], place[b])[place]]
                some = count > 0
                for column, value in zip(out, (names[some], root[some], count[some]), strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v), pa.int64()) for k, v in zip(("rid", "root", "n_links"), out, strict=True)})

    return common.spread(dealt, "cluster", "i", "j").mapInArrow(common.tidy(run), "rid long, root long, n_links long")


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """As ``near_duplicates``, with the text's key (k1, k2) and the class's own key (class_key)."""
    every, reps = representatives(df, text, doc_id)
    linked: list[DataFrame] = []
    with common.scratch(linked):
        linked.append(common.components(chosen_path_edges(reps, threshold, recall, depth)))
    candidates = linked[0]
    sizes = candidates.groupBy(F.col("label")).agg(F.count(F.lit(1)).alias("size"))
    clustered = candidates.join(sizes, "label").select(F.col("v").alias("rid"), F.col("label").alias("cluster"), "size")
    chosen = clustered.join(reps.select("rid", "id", "k1", "k2"), "rid").withColumnRenamed("id", "rep")
    common.release(df.sparkSession)
    texts = df.select(df[doc_id].alias("id"), *common.text_key(df[text]), df[text].alias("text"))
    on = (chosen.k1 == texts.k1) & (chosen.k2 == texts.k2) & chosen.rep.eqNullSafe(texts.id)
    exact = common.stage(verify(texts.join(chosen, on).select("cluster", "size", "rid", "text"), threshold), "links")
    common.release(df.sparkSession)
    links = exact.groupBy("rid").agg(F.sum("n_links").alias("n_links"))
    labels = common.components(exact.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    known = (
        reps.select("rid", "k1", "k2")
        .join(links, "rid", "left")
        .join(labels.withColumnRenamed("v", "rid"), "rid", "left")
        .select("k1", "k2", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("label", "rid").alias("label"))
    )
    copies = every.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    grouped = common.stage(copies.join(known, ["k1", "k2"], "left"), "copies")
    least = grouped.where("label is not null").groupBy("label").agg(F.min("least").alias("class_id"))
    # texts without words have no label: their class is their own copies
    named = grouped.join(least, "label", "left").select(
        "k1",
        "k2",
        F.coalesce("label", F.lit(-1).cast("long") - F.abs(F.shiftright("k1", 1))).alias("class_key"),
        F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "n_copies",
    )
    return every.join(named, ["k1", "k2"]).select(F.col("id").alias(doc_id), "k1", "k2", "class_key", "class_id", "n_links", "n_copies")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """One row for each row of ``df``: doc_id, class_id, n_links, n_copies.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles is at least
    ``threshold``; texts of one to four words have one shingle, all their words.  ``class_id`` is the
    least doc_id among all documents connected by links or equal texts, ``n_links`` the number of
    *different* texts linked to this one, ``n_copies`` the number of rows with this very text.

    Null text counts as empty; texts without words are linked to nothing but equal texts.  Repeated
    rows and equal ids are copies like others; a class of null ids alone has a null class_id; an empty
    table gives no rows; other columns do not matter.  A link at the threshold itself is found with
    probability ``recall`` at least, closer ones more surely (the trees are random, with fixed seeds), and
    each reported one is exact.
    """
    return classes(df, text, doc_id, threshold, recall, depth).select(doc_id, "class_id", "n_links", "n_copies")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, its least doc_id (nulls last; of equal ids the least text key)."""
    made: list[DataFrame] = []
    with common.scratch(made):
        made.append(common.stage(classes(df, text, doc_id, threshold), "classes"))
    common.release(df.sparkSession)
    found = made[0]
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "k1", "k2")
    kept = found.groupBy("class_key").agg(F.min(order).alias("best")).select("best.id", F.col("best.k1").alias("q1"), F.col("best.k2").alias("q2"))
    first, second = common.text_key(df[text])
    rows = df.select("*", first.alias("_k1"), second.alias("_k2"))
    on = rows[doc_id].eqNullSafe(kept.id) & (rows["_k1"] == kept.q1) & (rows["_k2"] == kept.q2)
    out = rows.join(kept, on, "left_semi")
    if not found.groupBy(doc_id, "k1", "k2").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([doc_id, "_k1", "_k2"])  # the same row given more than once
    return out.select(*df.columns)
