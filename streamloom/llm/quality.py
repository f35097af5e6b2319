"""Quality rules: text counts, and zstandard compression bands over documents and fixed chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

#: The symbols counted, and the bounds of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Bands:
    """Limits of size / compressed size.

    ``whole``: (up to so many bytes, least ratio, greatest ratio) by rising length; short texts
    compress little whatever they say, so their limits are wide.  Lower limits lie between the greatest
    ratio of base64 and the least of clean prose of that length, upper limits from 1 kB on just above the
    greatest ratio of clean prose: lists and chains of marks repeat more.
    ``chunk``: limits of each chunk of ``chunk_bytes``; a document fails if more than ``chunk_share`` of its
    chunks do.  A last chunk under a quarter of ``chunk_bytes`` joins the one before; a longer one is held
    against the limits of its own length.  A text of a single chunk is judged as a whole alone.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 2.0),
        (192, 1.05, 2.4),
        (256, 1.12, 2.4),
        (512, 1.25, 2.4),
        (1024, 1.35, 2.6),
        (2048, 1.45, 2.17),
        (4096, 1.55, 2.28),
        (8192, 1.65, 2.45),
        (16384, 1.65, 2.5),
        (float("inf"), 1.65, 3.0),
    )
    chunk: tuple[float, float] = (1.6, 2.35)
    chunk_bytes: int = 4096
    chunk_share: float = 0.2
    level: int = 1


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()  # bytes split at ASCII white space only: space and \\t to \\r
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    doubled = 0
    for line in raw.split(b"\n"):
        if line in seen:
            doubled += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(found), len(text) - spaces, symbols, doubled, repeat_words(found)


def repeat_words(found: list[bytes]) -> int:
    """Words that lie in a five-word window that the text holds twice or more."""
    n = len(found) - WINDOW + 1
    if n < 2:
        return 0
    windows = Counter(zip(*(found[i:] for i in range(WINDOW))))
    if len(windows) == n:
        return 0
    total, to = 0, 0
    for i, window in enumerate(zip(*(found[j:] for j in range(WINDOW)))):
        if windows[window] > 1:
            total += i + WINDOW - max(i, to)
            to = i + WINDOW
    return total


def ratios(raw: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Size / compressed size of the whole text and of each fixed chunk, if it has more than one."""
    if not raw:
        return 0.0, []
    whole = len(raw) / len(compressor.compress(raw))
    cuts = list(range(0, len(raw), bands.chunk_bytes))
    if len(cuts) > 1 and len(raw) - cuts[-1] < bands.chunk_bytes // 4:
        cuts.pop()
    if len(cuts) < 2:
        return whole, []
    return whole, [(b - a) / len(compressor.compress(raw[a:b])) for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def in_bands(size: int, whole: float, chunks: list[float], bands: Bands) -> bool:
    def limits(n: int) -> tuple[float, float]:
        return next((lo, hi) for most, lo, hi in bands.whole if n <= most)

    low, high = limits(size)
    if not low <= whole <= high:
        return False
    last = size - (len(chunks) - 1) * bands.chunk_bytes
    bounds = [bands.chunk] * (len(chunks) - 1) + [bands.chunk if last >= bands.chunk_bytes else limits(last)]
    outside = sum(not lo <= x <= hi for x, (lo, hi) in zip(chunks, bounds[: len(chunks)], strict=True))
    return outside <= bands.chunk_share * len(chunks)


def verdict(text: str, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """All that ``judge`` says of a text."""
    base = counts(text)
    failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
    raw = text.encode("utf-8", "surrogatepass")
    whole, chunks = ratios(raw, bands, compressor)
    worst = max(chunks, key=lambda r: abs(r - 1.0), default=None)
    return *base, failed, whole, len(chunks), worst, not failed and in_bands(len(raw), whole, chunks, bands)


def kept(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with their columns and no others, whatever their names."""
    common.ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for a, b in common.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array([verdict(x or "", bands, compressor)[-1] for x in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(common.tidy(run), df.schema)


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bands: Bands = Bands()) -> DataFrame:
    """Counts and verdict of every text; one row for each row of ``df``, no shuffle.

    Columns: ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    ratio (of the whole text; 0 if empty), n_chunks, worst_chunk (the ratio farthest from 1.0; null
    without chunks), kept.  ``kept`` is false where the base rules fail, else says whether the ratios
    lie within ``bands``.  Null text counts as empty (no words: base_failed).  Repeated rows each get
    a row; an empty table gives none; other columns do not matter.
    """
    common.ship(df.sparkSession)
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, worst_chunk double, kept boolean"
    source = df.select(*keep, df[text].alias("_text"))
    names_kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in common.slices(column):
                out = [verdict(x or "", bands, compressor) for x in column.slice(a, b - a).to_pylist()]
                kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
                made = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)]
                names = [f.split()[0] for f in fields.split(", ")]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)], *made], [*batch.schema.names[:-1], *names])

    return source.mapInArrow(common.tidy(run), f"{names_kept}, {fields}" if names_kept else fields)
