"""What several operators share: shared tables, Arrow batches and vectorised words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes that separate words: space and \t \n \v \f \r, as in ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Texts that are worked on together, in bytes; a longer text is worked on alone.
BLOCK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local master gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` once as Parquet in the shared folder and reads it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def _byte_codes() -> np.ndarray:
    return mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


BYTE_CODES = _byte_codes()
_ODD = 0xC2B2AE3D27D4EB4F
_POWERS: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            a = np.full(n, base, dtype=U64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=U64)
    return _POWERS


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``, the same wherever a span stands."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


class Block:
    """Some texts end to end: ``buf``, where each text starts and ends, and its words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        space = IS_SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        #: words of text i: first_word[i] .. first_word[i + 1]
        self.first_word = np.searchsorted(self.word_start, np.concatenate((self.start, [len(self.buf)])))
        self.n_words = np.diff(self.first_word)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.word_start, self.word_end)


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of ``most`` bytes at most, or a single text."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > most:
            yield i, j
            i, total = j, 0
        total += len(t)
    if texts:
        yield i, len(texts)


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def sorted_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(np.concatenate((first, [len(values)])))
