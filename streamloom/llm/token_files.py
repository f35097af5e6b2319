"""Token-id files: ids packed at the least width that holds the vocabulary, with block offsets.

A file holds documents in ascending id order::

    magic "SLTK1", bits, then blocks: the ids of whole documents, one after the other, ``bits`` wide,
        least significant bit first, padded to a byte at the block's end
    footer: per document its id, a flag for a null id and its number of ids; per block its byte offset,
        its first document and its number of ids
    the footer's length and the magic again

A reader takes the footer, then any block by its offset, and unpacks it with numpy at once.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"SLTK1\0"
#: Ids in a block, unless a single document has more.
BLOCK_IDS = 1 << 18
#: New segments after which a Python worker forgets those it has not met since as many before.
CACHE = 250_000
#: UTF-8 bytes encoded at once: more of them share their segments, and take more memory.
SLICE = 4_000_000
#: White space besides space and newline, and \\x01, as a regular expression's class.
_STRANGE = r"\x01\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TEXT = partial(pa.scalar, type=pa.large_string())
_workers: dict[int, Encoder] = {}


# ------------------------------------------------------------------ packing


def bits_for(vocabulary: int) -> int:
    """The least number of bits that holds ids 0 to ``vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` each, least significant bit first; ValueError if one does not fit."""
    if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
        raise ValueError(f"ids from {ids.min()} to {ids.max()} do not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed data, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Writes one file; holds one block and the footer in memory."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held, self.first, self.at = 0, 0, len(MAGIC) + 1
        out.write(MAGIC + bytes([bits]))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > BLOCK_IDS:
            self._flush()
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)

    def _flush(self) -> None:
        if self.waiting:
            data = pack(np.concatenate(self.waiting), self.bits)
            self.blocks.append((self.at, self.first, self.held))
            self.out.write(data)
            self.at += len(data)
            self.waiting, self.held, self.first = [], 0, len(self.docs)

    def close(self) -> int:
        """Write the footer; the number of ids in the file."""
        self._flush()
        footer = struct.pack("<qq", len(self.docs), len(self.blocks))
        footer += np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<i8").tobytes()
        footer += np.array(self.blocks, "<i8").reshape(-1, 3).tobytes()
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        return sum(self.counts)


class Reader:
    """Random access to a file: ``read_at(offset, length)`` gives bytes."""

    def __init__(self, read_at, size: int):
        tail = read_at(size - len(MAGIC) - 8, len(MAGIC) + 8)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        (length,) = struct.unpack("<q", tail[:8])
        self.read_at = read_at
        self.bits = read_at(len(MAGIC), 1)[0]
        self.end = size - len(MAGIC) - 8 - length
        footer = read_at(self.end, length)
        n, b = struct.unpack("<qq", footer[:16])
        at = 16
        self.docs = np.frombuffer(footer, "<i8", n, at)
        self.nulls = np.frombuffer(footer, "u1", n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(footer, "<i8", n, at + 9 * n)
        self.blocks = np.frombuffer(footer, "<i8", 3 * b, at + 17 * n).reshape(b, 3)

    def block(self, k: int) -> np.ndarray:
        """All ids of a block."""
        offset, _, n = (int(x) for x in self.blocks[k])
        to = int(self.blocks[k + 1][0]) if k + 1 < len(self.blocks) else self.end
        return unpack(self.read_at(offset, to - offset), self.bits, n)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from its block alone."""
        k = int(np.searchsorted(self.blocks[:, 1], i, side="right")) - 1
        first = int(self.blocks[k][1])
        at = int(self.counts[first:i].sum())
        return self.block(k)[at : at + int(self.counts[i])]


# ------------------------------------------------------------------ encoding


class Encoder:
    """The tokenizers library over distinct segments of texts.

    The byte-level pattern never matches across a space that stands alone between two other
    characters, nor across such a newline, so the ids of a text are those of its segments.  Texts with
    any other white space or with an added token's content go to the library whole, and so do all texts
    if the tokenizer splits by any other rule.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        told = json.loads(definition)
        rule = told.get("pre_tokenizer") or {}
        self.splits = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not told.get("normalizer")
        added = "".join("|" + re.escape(t["content"]) for t in told.get("added_tokens", []))
        self.whole = f"^[ \n]|[ \n]$|[ \n][ \n]|[{_STRANGE}]{added}"
        #: Ids of each segment met, and of those met before the last change of caches.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Ids whose first byte is a space or a newline: where the segments of a joined text begin.
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.opens[i] = token[:1] in "ĠĊ"

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        """Ids of new segments; many are joined into one text and taken apart at the ids that open one."""
        spaced = [k for k in keys if k[:1] not in ("\x01", "\n")]
        for a in range(0, len(spaced), 4096):
            part = spaced[a : a + 4096]
            ids = np.array(self._ids([" " + " ".join(part)])[0], dtype="<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):
                for k, x in zip(part, self._ids([" " + k for k in part]), strict=True):
                    self.cache[k] = np.array(x, dtype="<u4").tobytes()
                continue
            data, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            self.cache.update(zip(part, [data[p:q] for p, q in zip(cuts, cuts[1:])], strict=True))
        rest = [k for k in keys if k[:1] in ("\x01", "\n")]
        for k, x in zip(rest, self._ids([k.removeprefix("\x01") for k in rest]), strict=True):
            self.cache[k] = np.array(x, dtype="<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), one after the other, and where those of each begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.whole) if self.splits else pa.array(np.ones(len(texts), bool))
        own = {i: np.array(x, dtype="<u4") for i, x in zip(pc.indices_nonzero(odd).to_pylist(), self._ids(texts.filter(odd).to_pylist()), strict=True)}
        # \x01 marks the segment that opens a text: no space stands before it
        marked = pc.binary_join_element_wise(_TEXT("\x01"), pc.if_else(odd, _TEXT(""), texts) if own else texts, _TEXT(""))
        parts = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        segments = parts.flatten().dictionary_encode()
        keys = segments.dictionary.to_pylist()
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        new = [k for k in keys if k not in self.cache]
        met = {k: self.older[k] for k in new if k in self.older}
        self.cache.update(met)
        if len(new) > len(met):
            self._learn([k for k in new if k not in met])
        known = pa.array([self.cache[k] for k in keys], pa.large_binary()).take(segments.indices)
        bounds = np.frombuffer(known.buffers()[1], dtype=np.int64)[: len(known) + 1]
        data = known.buffers()[2]
        ids = np.frombuffer(data, dtype="<u4", count=(bounds[-1] - bounds[0]) // 4, offset=bounds[0]) if len(known) and bounds[-1] else np.zeros(0, "<u4")
        offsets = parts.offsets.to_numpy()
        at = (bounds // 4)[offsets - offsets[0]]
        if own:
            pieces = [own.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]
            ids, at = np.concatenate(pieces), np.r_[0, np.cumsum([len(x) for x in pieces])]
        return ids, at


def encoder(definition: str) -> Encoder:
    """The worker's encoder; it and its cache outlive a task."""
    key = hash(definition)
    if key not in _workers:
        _workers[key] = Encoder(definition)
    return _workers[key]


def vocabulary_size(definition: str) -> int:
    """One more than the largest id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(definition).get_vocab(with_added_tokens=True).values(), default=0) + 1


# ------------------------------------------------------------------ files


def write_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Encode every whole text and write the ids in ascending ``doc_id`` order; one file a partition.

    Returns the manifest: file_no, path, n_docs, n_ids - one row for each file.  The texts are range
    partitioned by id once and encoded where they land.  Each task writes a file of its own name, so
    a task that runs twice leaves an unnamed spare and never a broken file; the manifest is staged and
    names those that count.  ``folder`` is any place that pyarrow's file systems can write.

    An id takes the bits that the tokenizer's largest id (or ``end_id``) needs.  Added tokens' contents in
    a text become their ids, as the library has it.  Null text counts as empty; null ids come first; equal
    ids are ordered by text; an empty table gives an empty manifest; other columns do not matter.
    """
    spark = df.sparkSession
    common.ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        told = f.read()
    definition = spark.sparkContext.broadcast(told)
    bits, n = bits_for(max(vocabulary_size(told), (end_id or 0) + 1)), partitions or common.shuffle_partitions(spark)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = source.repartitionByRange(n, "doc_id").withColumn("file_no", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, number = encoder(definition.value), None, 0
        system, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{uuid.uuid4().hex}.tokens"
        for batch in batches:
            column = batch.column(1)
            for a, b in common.slices(column, SLICE):
                if writer is None:
                    number = batch.column(2)[0].as_py()
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path)
                    writer = Writer(out, bits)
                ids, at = own.encode(column.slice(a, b - a))
                ids, at = np.insert(ids, np.repeat(at[1:], len(end)), np.tile(end, b - a)), at + len(end) * np.arange(b - a + 1)
                for doc, p, q in zip(batch.column(0).slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    writer.add(doc, ids[p:q])
        if writer is not None:
            total = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_ids": [total]})

    return common.stage(placed.mapInArrow(common.tidy(run), "file_no int, path string, n_docs long, n_ids long"), "manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files block by block: doc_id, start, n_tokens, ids_crc32 of every document.

    ``start`` is the number of ids of all documents before it: a prefix sum over the manifest's file
    totals (a row for each file), then over the footer's counts.
    """
    common.ship(manifest.sparkSession)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as f:
                    reader = Reader(lambda at, n, f=f: f.read_at(n, at), f.size())
                    starts = row["start"] + np.concatenate([[0], np.cumsum(reader.counts)])
                    for k, (_, first, _) in enumerate(reader.blocks.tolist()):
                        to = int(reader.blocks[k + 1][1]) if k + 1 < len(reader.blocks) else len(reader.docs)
                        data = reader.block(k).astype("<u4")
                        cuts = starts[first : to + 1] - starts[first]
                        sums = [zlib.crc32(data[a:b].data) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(reader.docs[first:to], pa.int64(), mask=reader.nulls[first:to]),
                                "start": pa.array(starts[first:to], pa.int64()),
                                "n_tokens": pa.array(reader.counts[first:to], pa.int64()),
                                "ids_crc32": pa.array(sums, pa.int64()),
                            }
                        )

    spread = files.repartition(common.shuffle_partitions(manifest.sparkSession), "file_no")
    return spread.mapInArrow(common.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
