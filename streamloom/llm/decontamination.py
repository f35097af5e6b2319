"""Benchmark decontamination by greedy string tiling over shared word seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the shortest tile.
MIN_MATCH = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Seeds of the items scanned for at once; bounds what is broadcast and held on the driver.
BLOCK_SEEDS = 1_000_000
#: Pairs of a document's windows and items counted at once.
SEEDS_AT_ONCE = 1_000_000


_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))


class _Rolling:
    """Karp-Rabin hashes of the windows of a word sequence, of any length, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, self.down = (np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_M, _INVERSE))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=self.sums[1:])
        self.words, self.free = words, np.ones(n, bool)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows without a marked word, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[length:] == taken[: len(taken) - length]) if length <= len(self.words) else np.zeros(0, np.int64)
        return at, (self.sums[at + length] - self.sums[at]) * self.down[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in document, start in item, words) of
    the tiles marked, in order.

    The longest match of unmarked words is marked again and again (ties: the earliest in the item, then in
    the document) until none has ``least`` words.  Its length is found by running Karp-Rabin over windows of
    falling length: a match of some length holds matches of every lesser one, so halving finds the greatest.
    A match's words are compared before it is marked.  Memory is linear in the two sequences, however often
    they repeat themselves.
    """
    d, i = _Rolling(doc), _Rolling(item)
    # words in no shared window of the least length can never be part of a tile
    (at, found), (_, wanted) = d.windows(least), i.windows(least)
    cover = np.zeros(len(doc) + 1, np.int64)
    hit = at[np.isin(found, wanted)]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + least, -1)
    d.free = np.cumsum(cover)[:-1] > 0

    def match(length: int) -> tuple[int, int] | None:
        (at, found), (to, wanted) = d.windows(length), i.windows(length)
        order = np.argsort(found, kind="stable")  # equal hashes: the earliest in the document first
        found, at = found[order], at[order]
        low, high = np.searchsorted(found, wanted, "left"), np.searchsorted(found, wanted, "right")
        for k in np.flatnonzero(high > low).tolist():
            for a in at[low[k] : high[k]].tolist():
                if np.array_equal(doc[a : a + length], item[to[k] : to[k] + length]):
                    return a, int(to[k])
        return None

    marked = []
    most = min(len(doc), len(item))
    while most >= least:
        best, low, high = match(least), least, most
        if best is None:
            break
        while low < high:
            middle = (low + high + 1) // 2
            if found := match(middle):
                best, low = found, middle
            else:
                high = middle - 1
        a, b = best
        marked.append((a, b, low))
        d.free[a : a + low] = False
        i.free[b : b + low] = False
        most = low
    return marked


class Seeds:
    """Windows of a block of benchmark items by hash, and the items' words."""

    def __init__(self, ids: list, texts: list[str], least: int):
        w = common.Words(pa.array(texts, pa.string()))
        hashes, at = w.shingles(least)
        self.ids, self.least = ids, least
        self.sequence, self.first = w.hashes, w.first
        self.words = np.diff(w.first)
        item = np.repeat(np.arange(len(ids)), np.diff(at))
        self.in_order, self.at = hashes, at
        # an item's equal windows are one seed that counts for all of them
        order = np.lexsort((item, hashes))
        hashes, item = hashes[order], item[order]
        new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])]) if len(order) else order
        self.hashes, self.item, self.times = hashes[new], item[new], np.diff(np.r_[new, len(hashes)])
        bits = max(16, int(len(self.hashes) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[self.hashes >> self.shift] = True

    def candidates(self, hashes: np.ndarray, coverage: float) -> np.ndarray:
        """Items whose windows among ``hashes`` (a document's) are enough to cover their share, counted over
        some seeds at a time: no list of all pairs of windows and items is made."""
        own = np.unique(hashes[self.filter[hashes >> self.shift]])
        low = np.searchsorted(self.hashes, own, "left")
        n = np.searchsorted(self.hashes, own, "right") - low
        low, n = low[n > 0], n[n > 0]
        if not len(n):
            return np.zeros(0, np.int64)
        held = np.zeros(len(self.ids), np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEEDS_AT_ONCE, side="right")))
            part = n[at:to]
            rows = np.repeat(low[at:to] - np.cumsum(part) + part, part) + np.arange(part.sum())
            held += np.bincount(self.item[rows], self.times[rows], minlength=len(held)).astype(np.int64)
            at = to
        items = np.flatnonzero((held > 0) & (held * self.least >= coverage * self.words))
        return self._coverable(items, own, coverage) if len(items) else items

    def _coverable(self, items: np.ndarray, own: np.ndarray, coverage: float) -> np.ndarray:
        """Those of ``items`` whose words in some window of ``own`` reach their share: no tiling covers more."""
        out = []
        ends = np.cumsum(self.words[items])
        at = 0
        while at < len(items):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEEDS_AT_ONCE, side="right")))
            part = items[at:to]
            n, words = self.at[part + 1] - self.at[part], self.words[part]
            before = np.cumsum(words) - words  # the part's items' words, one after the other
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seeds = self.in_order[np.repeat(self.at[part], n) + place]
            shared = own[np.minimum(np.searchsorted(own, seeds), len(own) - 1)] == seeds
            first = (np.repeat(before, n) + place)[shared]
            cover = np.zeros(words.sum() + 1, np.int64)
            cover[: words.sum()] += np.bincount(first, minlength=words.sum())
            cover -= np.bincount(first + self.least, minlength=len(cover))
            covered = np.add.reduceat((np.cumsum(cover) > 0).astype(np.int64), before)
            out.append(part[covered >= coverage * words])
            at = to
        return np.concatenate(out)


def _blocks(items: DataFrame, item_id: str, item_text: str, least: int) -> Iterator[Seeds]:
    """The items' windows, a block of at most ``BLOCK_SEEDS`` of them (or one item) at a time."""
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    ids, texts, held = [], [], 0
    for row in chosen.toLocalIterator():
        n = row["t"].count(" ") + row["t"].count("\n") + 1
        if held and held + n > BLOCK_SEEDS:
            yield Seeds(ids, texts, least)
            ids, texts, held = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        held += n
    yield Seeds(ids, texts, least)


def find(df: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """Every (document, item) pair whose tiles cover at least ``coverage`` of the item's words.

    Columns: ``keep``, item_id, coverage, n_item_words, n_tiles, tiles (document word, item word,
    words; in the order marked).  Order does not matter, so passages cut up and rearranged count.
    Words are runs of letters, digits and non-ASCII characters, lower-cased.

    The items are scanned for in blocks: a block is broadcast, its windows are joined by hash with those
    of every document where it lies, and the candidate pairs are tiled on the spot - no document moves.
    A single block is lazy; of several, all but the last are staged, so one is held at a time.  Null
    texts count as empty; items under ``least`` words cannot be found; repeated rows give repeated
    pairs; without documents or items there are no pairs.
    """
    common.ship(df.sparkSession)
    source = df.select(*keep, df[text].alias("_text"))
    out: DataFrame | None = None
    found: DataFrame | None = None
    for block in _blocks(items, item_id, item_text, least):
        if found is not None:
            found = common.stage(found, "contaminated")
            out = found if out is None else out.unionByName(found)
        found = _scan(source, block, coverage)
    return found if out is None else out.unionByName(found)


def without_contaminated(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """The rows of ``df`` that hold no item by the rule of ``find``, with its columns; nothing is shuffled.

    A single block of items is lazy; of several, the rows left are staged after each but the last, so one
    block is held at a time.  Nulls, repeats and empty tables as in ``find``; column names do not matter.
    """
    common.ship(df.sparkSession)
    seeds = None
    for block in _blocks(items, item_id, item_text, least):
        if seeds is not None:
            df = common.stage(df, "uncontaminated")
            seeds.unpersist()
        seeds = df.sparkSession.sparkContext.broadcast(block)
        at = df.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], seeds=seeds, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[x[0] for x in _pairs(batch.column(at), seeds.value, coverage)]] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(common.tidy(run), df.schema)
    return df


def _pairs(column: pa.Array, seeds: Seeds, coverage: float) -> Iterator[tuple]:
    """(row, item id, coverage, words of the item, tiles) of each pair that reaches ``coverage``."""
    for a, b in common.slices(column):
        words = common.Words(column.slice(a, b - a))
        hashes, at = words.shingles(seeds.least)
        hit = np.add.reduceat(np.r_[seeds.filter[hashes >> seeds.shift], False].astype(np.int64), at[:-1]) * (np.diff(at) > 0) if len(hashes) else np.zeros(b - a)
        for doc in np.flatnonzero(hit).tolist():
            own = words.hashes[words.first[doc] : words.first[doc + 1]]
            for item in seeds.candidates(hashes[at[doc] : at[doc + 1]], coverage).tolist():
                n = int(seeds.words[item])
                marked = tiles(own, seeds.sequence[seeds.first[item] : seeds.first[item + 1]], seeds.least)
                covered = sum(t[2] for t in marked) / n
                if covered >= coverage:
                    yield a + doc, seeds.ids[item], covered, n, marked


def _scan(source: DataFrame, block: Seeds, coverage: float) -> DataFrame:
    seeds = source.sparkSession.sparkContext.broadcast(block)
    tile = pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_pairs(batch.column(batch.num_columns - 1), seeds.value, coverage))
            if found:
                rows, ids, covered, n, marked = zip(*found, strict=True)
                made = [
                    pa.array(ids, pa.int64()),
                    pa.array(covered, pa.float64()),
                    pa.array(n, pa.int64()),
                    pa.array([len(m) for m in marked], pa.int64()),
                    pa.array([[dict(zip(tile.names, t, strict=True)) for t in m] for m in marked], pa.list_(tile)),
                ]
                pick = pa.array(rows, pa.int64())
                names = ["item_id", "coverage", "n_item_words", "n_tiles", "tiles"]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pick) for k in range(batch.num_columns - 1)], *made], [*batch.schema.names[:-1], *names])

    return source.mapInArrow(common.tidy(run), kept + "item_id long, coverage double, n_item_words long, n_tiles long, tiles array<struct<doc_word long, item_word long, words long>>")
