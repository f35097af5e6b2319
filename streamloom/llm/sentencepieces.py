"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies, in Arrow batches.

The encoder keeps, for every distinct segment of a batch, an agenda of its adjacent symbol pairs
scored by the piece they would merge into, and merges the best (leftmost on ties) until none is left.
Short segments of a batch advance together as rows of numpy matrices; a long one has a heap of its own.
Every segment's ids are decoded again, and a text's decoded form is that of its segments in a row.  The
library encodes and decodes the same segments as a check; should one ever differ, the library's result is
used and the row says so.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
#: New segments after which a Python worker forgets those it has not met since as many before.
CACHE = 200_000
#: Symbols of a segment from which on the agenda is a heap; a row of a matrix is scanned at each merge.
LONG = 64
_NONE = np.int32(2**31 - 1)
_SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")
_workers: dict[int, Codec] = {}


class Codec:
    """Encoder and decoder for one model given as bytes."""

    def __init__(self, model: bytes, check: bool = True):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        n = len(self.sp)
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        normal = [not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)) for i in range(n)]
        self.raw = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.bytes = {self.raw[i]: i for i in range(n) if self.sp.is_byte(i)}
        ids = {p: i for i, p in enumerate(self.pieces) if normal[i]}
        #: Segments may be cut before a space and around a newline only if no piece reaches across.
        self.splits = not any(re.search(rf"[^{SPACE}]{SPACE}|\n", p) for p in ids)
        self.symbols = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        # ranks by falling score: a smaller rank merges first; equal scores share a rank
        scores = np.array([self.sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {(ids[p[:k]] << 32) | ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        order = np.array(sorted(pairs), dtype=np.int64)
        self.pairs = np.append(order, np.int64(2**62))
        self.merged = np.append(np.array([pairs[int(k)] for k in order], dtype=np.int32), np.int32(-1))
        self.pair: dict[int, int] = {}
        self.ranks = self.rank.tolist()
        self.names = [str(i) for i in range(n)]
        #: Ids (decimals joined by spaces) of each segment met, and of those met before the last change of caches.
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Decoded forms that differ from the segment itself, and segments for which the library gave something else.
        self.decoded: dict[str, str] = {}
        self.odd: set[str] = set()

    # ---------------------------------------------------------------- encoding

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that a pair merges into, -1 if none."""
        key = (left.astype(np.int64) << 32) | np.maximum(right, 0)
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], np.int32(-1))

    def agenda(self, segments: list[str]) -> list[list[int]]:
        """The piece ids of each segment (already with its space marks)."""
        out: list[list[int]] = [[]] * len(segments)
        lengths = np.array([len(s) for s in segments])
        order = np.argsort(lengths, kind="stable")
        at, end = (int(x) for x in np.searchsorted(lengths[order], [1, LONG]))
        for i in order[end:].tolist():
            out[i] = self._heap(segments[i])
        order = order[:end]
        while at < len(order):
            most = max(1, 500_000 // int(lengths[order[at]]))
            width = int(lengths[order[min(len(order), at + most) - 1]])
            rows = order[at : at + max(1, min(most, 500_000 // width))]
            at += len(rows)
            self._merge(segments, rows, lengths, out)
        return out

    def _heap(self, segment: str) -> list[int]:
        """The agenda of one segment as a heap over a linked list of symbols; outdated entries are passed over."""
        if not self.pair:
            self.pair.update(zip(self.pairs.tolist(), self.merged.tolist(), strict=True))
        points = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = self.symbols[points]
        sym = np.where(known >= 0, known, -2 - points.astype(np.int32)).tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            a, b = sym[i], sym[j]
            if a >= 0 and b >= 0 and (to := self.pair.get((a << 32) | b)) is not None:
                heapq.heappush(heap, (self.ranks[to], i, a, b))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = self.pair[(a << 32) | b]
            gone[j] = True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return self._bytes([x for x, dead in zip(sym, gone, strict=True) if not dead])

    def _bytes(self, ids: list[int]) -> list[int]:
        """Unknown characters as the ids of their bytes."""
        return [y for x in ids for y in ([x] if x >= 0 else [self.bytes[bytes([b])] for b in chr(-2 - x).encode("utf-8", "surrogatepass")])]

    def _merge(self, segments: list[str], rows: np.ndarray, lengths: np.ndarray, out: list[list[int]]) -> None:
        width = int(lengths[rows].max())
        points = np.frombuffer("".join(segments[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        filled = np.arange(width) < lengths[rows][:, None]
        sym = np.full((len(rows), width), -1, dtype=np.int32)
        known = self.symbols[points]
        sym[filled] = np.where(known >= 0, known, -2 - points.astype(np.int32))  # unknown: no pair has it
        live, names = sym, rows
        to = self._look(live[:, :-1], live[:, 1:])
        while len(names):
            rank = np.where(to >= 0, self.rank[to], _NONE)
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(live), dtype=np.int64)
            each = np.arange(len(live))
            more = rank[each, best] < _NONE if rank.shape[1] else np.zeros(len(live), dtype=bool)
            self._finish(live[~more], names[~more], out)
            live, to, best, names = live[more], to[more], best[more], names[more]
            if not len(names):
                return
            each = np.arange(len(live))
            made = to[each, best]
            # close the gap right of the merged symbol, and right of its entry in the agenda
            step = np.arange(live.shape[1] - 1)
            live[each, best + 1] = made
            live = np.take_along_axis(live, step + (step >= best[:, None]), axis=1)
            step = np.arange(to.shape[1] - 1)
            to = np.take_along_axis(to, step + (step >= best[:, None]), axis=1)
            has = best > 0
            to[each[has], best[has] - 1] = self._look(live[each[has], best[has] - 1], made[has])
            has = best < live.shape[1] - 1
            to[each[has], best[has]] = self._look(made[has], live[each[has], best[has] + 1])

    def _finish(self, symbols: np.ndarray, names: np.ndarray, out: list[list[int]]) -> None:
        """Store the ids of segments without a pair left; unknown characters become bytes."""
        kept = symbols != -1
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        flat = symbols[kept].tolist()
        unknown = bool((symbols < -1).any())
        at = 0
        for name, end in zip(names.tolist(), ends, strict=True):
            ids = flat[at:end]
            if unknown and min(ids) < 0:
                ids = self._bytes(ids)
            out[name] = ids
            at = end

    def _learn(self, keys: list[str]) -> None:
        """Encode new segments.  A key starting with a newline has no space mark before it."""
        marked = [(k if k[:1] == "\n" else SPACE + k).replace(" ", SPACE) for k in keys]
        found = self.agenda(marked)
        decoded = [self.spelled(x).replace(SPACE, " ") for x in found]
        if self.check:
            # the library puts a space mark before everything; a key that begins a line has none, and
            # an empty text, for which the library gives nothing, is a mark alone here
            theirs = self.sp.encode([k if k[:1] == "\n" else k.replace(SPACE, " ") for k in keys], num_threads=1)
            theirs = [own if not k else x[1:] if k[0] == "\n" else x for k, own, x in zip(keys, found, theirs, strict=True)]
            back = self.sp.decode(theirs, num_threads=1)  # without the space that the first mark stands for
            for i, (k, x, text) in enumerate(zip(keys, theirs, back, strict=True)):
                text = text if k[:1] == "\n" else " " + text
                if found[i] != x or decoded[i] != text:
                    found[i], decoded[i] = x, text
                    self.odd.add(k)
        names = self.names
        self.cache.update(zip(keys, [" ".join([names[i] for i in x]) for x in found], strict=True))
        self.decoded.update((k, x) for k, x in zip(keys, decoded, strict=True) if x != (k if k[:1] == "\n" else " " + k))

    def spelled(self, ids: list[int]) -> str:
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")

    def segments(self, text: str) -> list[str]:
        """Keys of a text's segments: each lacks the space mark that precedes it."""
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        return [s[1:] if s[0] == " " else s for s in _SEGMENT.findall(" " + text)]

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text as decimals joined by spaces, without an end id."""
        return [x[0] for x in self.round_trip(texts)]

    def round_trip(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Ids of each text as in ``encode``, the text decoded from them, and in how many segments the
        library's result took the place of the own one."""
        if not self.splits:
            return [self._whole(t) if t else ("", "", 0) for t in texts]
        parts = [self.segments(t) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
            self.decoded = {k: x for k, x in self.decoded.items() if k in self.older}
            self.odd.intersection_update(self.older)
        new = set().union(*parts).difference(self.cache)
        met = {k: self.older[k] for k in new if k in self.older}
        self.cache.update(met)
        if len(new) > len(met):
            self._learn([k for k in new if k not in met])
        ids, decoded, odd = self.cache, self.decoded, self.odd
        out = []
        for p in parts:
            if decoded and not decoded.keys().isdisjoint(p):
                text = "".join([decoded[k] if k in decoded else k if k[:1] == "\n" else " " + k for k in p])
            else:  # each segment as it stands; only a line's has no space before it
                text = " " + " ".join(p).replace(" \n", "\n") if p else ""
            out.append((" ".join([ids[k] for k in p]), text[1:] if text[:1] == " " else text, sum(k in odd for k in p) if odd else 0))
        return out

    def _whole(self, text: str) -> tuple[str, str, int]:
        """The same for a vocabulary whose pieces reach across segments."""
        ids = self.agenda([SPACE + text.replace(" ", SPACE)])[0]
        back, differs = self.decode(ids), 0
        if self.check:
            theirs = self.sp.encode(text)
            spelled = self.sp.decode(theirs)
            differs = int(ids != theirs or back != spelled)
            ids, back = theirs, spelled
        return " ".join([self.names[i] for i in ids]), back, differs

    # ---------------------------------------------------------------- decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes joined, space marks turned into spaces, the first one dropped."""
        out = self.spelled(ids).replace(SPACE, " ")
        return out[1:] if out[:1] == " " else out


def codec(model: bytes) -> Codec:
    """The worker's codec for a model; it and its cache outlive a task."""
    key = hash(model)
    if key not in _workers:
        _workers[key] = Codec(model)
    return _workers[key]


def encode_documents(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end_id: int | None = 2, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again; one row for each row of ``df``, no shuffle.

    Columns: ``keep``, ids (array<int>, with ``end_id``; left out unless ``with_ids``), n_tokens,
    ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the text decoded from them),
    n_differing (segments for which the library's check replaced the own result; 0 expected).  The
    model file is read on the driver and sent along (its size does not depend on the data).  Null text
    counts as empty: the end id alone.  Repeated rows each get a row; an empty table gives none.
    """
    spark = df.sparkSession
    common.ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    source = df.select(*keep, df[text].alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in common.slices(column):
                texts = [x or "" for x in column.slice(a, b - a).to_pylist()]
                lines, decoded, differing = zip(*own.round_trip(texts), strict=True)
                if end_id is not None:
                    lines = [f"{x} {end_id}" if x else str(end_id) for x in lines]
                counts = [x.count(" ") + 1 if x else 0 for x in lines]
                made = []
                if with_ids:
                    flat = np.fromstring(" ".join(x for x in lines if x), dtype=np.int32, sep=" ")
                    made.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32())))
                made += [
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]),
                    pa.array(differing, pa.int64()),
                ]
                names = [*["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256", "n_differing"]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)], *made], [*batch.schema.names[:-1], *names])

    return source.mapInArrow(common.tidy(run), kept + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing long")
