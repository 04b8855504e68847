"""Quality rules: counts of words, symbols and repeats, and zstandard compression bands.

One pass without a shuffle: each Arrow batch is cut into blocks of texts, counted with numpy over the
block's bytes, and each text is compressed as a whole and in fixed chunks that cover
all of its bytes.

Defined cases: a null or empty text has no words, so every count is 0 and it fails; rows that repeat are
judged alike; columns besides the two that are named are not read. A text shorter than the first row of the chunk limits
is judged by its whole ratio alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Block, blocks, byte_list, mix, sorted_counts

WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Limits of raw bytes / compressed bytes, by length.

    ``whole[i] = (least length, lowest ratio, highest ratio)``. Short texts carry the frame's own bytes
    and have had little to refer back to, so their band lies lower. Base64 and random letters
    stay under 1.35 at any length; prose in any language exceeds it from about 1,000 bytes on. Lines or phrases
    that repeat pass the upper limits, prose stays at half of them or less.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 2.5),
        (100, 0.85, 3.0),
        (300, 1.15, 3.5),
        (1000, 1.35, 4.5),
        (3000, 1.40, 5.0),
        (10000, 1.45, 5.5),
        (100000, 1.45, 7.0),
    )
    #: ``chunks[i] = (least length, chunk bytes, lowest ratio, highest ratio, share)``: a chunk outside is bad, and a text is rejected
    #: if more than this share is. Short chunks compress less, and a short text has few of them; base64 of 1,024 bytes
    #: stays under 1.27 and prose over 1.6.
    chunks: tuple[tuple[int, int, float, float, float], ...] = (
        (2049, 1024, 1.33, 4.5, 0.4),
        (8193, 4096, 1.35, 5.0, 0.3),
        (131073, 4096, 1.35, 5.0, 0.2),
    )

    def limits(self, n: int) -> tuple[float, float]:
        row = self.whole[bisect_right([w[0] for w in self.whole], n) - 1]
        return row[1], row[2]

    def chunk_limits(self, n: int) -> tuple[int, float, float, float] | None:
        at = bisect_right([c[0] for c in self.chunks], n)
        return self.chunks[at - 1][1:] if at else None


def ratios(raw: bytes, bands: Bands, compressor) -> tuple[float, int, int]:
    """Whole ratio, number of chunks and how many of them lie outside the chunk band. The last chunk overlaps the one before unless the length divides, so every byte is judged."""
    if not raw:
        return 0.0, 0, 0
    whole, of = len(raw) / len(compressor.compress(raw)), bands.chunk_limits(len(raw))
    if not of:
        return whole, 0, 0
    size, low, high, _ = of
    starts = [*range(0, len(raw) - size, size), len(raw) - size]
    bad = sum(not low <= size / len(compressor.compress(raw[i : i + size])) <= high for i in starts)
    return whole, len(starts), bad


def verdict(n: int, whole: float, chunks: int, bad: int, bands: Bands) -> bool:
    low, high = bands.limits(n)
    of = bands.chunk_limits(n)
    return low <= whole <= high and (not of or bad <= of[3] * chunks)


def sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[end] - total[start]


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of one block of texts."""
    b = Block(texts)
    n, owner = b.n_words, np.repeat(np.arange(len(texts)), b.n_words)
    code_points = (b.buf & 0xC0) != 0x80
    word_chars = sums(sums(code_points, b.word_start, b.word_end), b.first_word[:-1], b.first_word[1:])
    n_symbols = sums(SYMBOLS[b.buf], b.start, b.end)
    # windows of eight words, told apart by 64-bit hashes of the words, the order and the text
    h, repeats = b.word_hashes(), np.zeros(len(texts), dtype=np.int64)
    if len(h) >= WINDOW:
        w = h[: len(h) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            w = mix(w * U64(0x9E3779B97F4A7C15) + h[k : len(h) - WINDOW + 1 + k])
        inside = owner[: len(w)] == owner[WINDOW - 1 :]
        w = mix(w + mix(owner[: len(w)].astype(U64) + U64(1)))
        values, times = sorted_counts(w[inside])
        values = values[times > 1]
        if len(values):
            at = np.minimum(np.searchsorted(values, w), len(values) - 1)
            twice = np.flatnonzero((values[at] == w) & inside)
            edge = np.zeros(len(h) + 1, dtype=np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
            repeats = sums(covered, b.first_word[:-1], b.first_word[1:])
    # lines with a word that equal an earlier line: exact, by their bytes
    dup = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
    return {"n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": repeats}


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"


def judged(texts: list[bytes], bands: Bands, compressor) -> dict[str, np.ndarray]:
    out = counts(texts)
    r = [ratios(t, bands, compressor) for t in texts]
    ok = np.array([verdict(len(t), *x, bands) for t, x in zip(texts, r)], dtype=bool)
    n = out["n_words"]
    failed = (n < 20) | (100 * out["n_repeat_words"] > 30 * n)
    return out | {
        "ratio": np.array([x[0] for x in r]),
        "n_chunks": np.array([x[1] for x in r], dtype=np.int64),
        "n_bad_chunks": np.array([x[2] for x in r], dtype=np.int64),
        "base_failed": failed,
        "kept": ~failed & ok,
    }


def quality(docs: DataFrame, text: str = "text", keep_columns: list[str] | None = None, bands: Bands = Bands()) -> DataFrame:
    """``keep_columns`` of ``docs`` (all by default) and the verdict of each row, in one struct ``quality``."""
    columns = docs.columns if keep_columns is None else keep_columns
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text"))
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["`__quality` struct<" + SCHEMA.replace(" long", ":long").replace(" double", ":double").replace(" boolean", ":boolean") + ">"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            texts = byte_list(batch.column(batch.num_columns - 1))
            for i, j in blocks(texts):
                part = judged(texts[i:j], bands, compressor)
                struct = pa.StructArray.from_arrays([pa.array(v) for v in part.values()], names=list(part))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)), struct], names=[*batch.schema.names[:-1], "__quality"])

    return source.mapInArrow(run, out_schema)


def kept(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return quality(docs, text, bands=bands).where("`__quality`.kept").drop("__quality")
