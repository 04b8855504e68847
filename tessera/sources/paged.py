"""Paged fixed-width binary tables of words, with single or extended precision and either byte order.

The first page names the fields; the rest hold as many whole records as fit into 508 words. A file is viewed as one array of words
and each asked column is a stride through it, so columns that nobody asks for are never decoded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .binary import files

#: Fixed values of the format: words of a page that hold data, and the size above which a number means "absent".
WORDS, ABSENT = 508, 0.9e30


@dataclass(frozen=True)
class Column:
    name: str
    text: bool
    words: tuple[int, ...]  # stored words, from 1; none for a constant
    constant: object = None


@dataclass(frozen=True)
class Layout:
    real: np.dtype
    page: int
    record: int
    rows: int
    columns: tuple[Column, ...]


def letters(raw: np.ndarray) -> str:
    """The first four bytes of each word as text."""
    return bytes(b for b in raw[:, :4].ravel().tolist() if 32 <= b < 127).decode().strip()


def layout(raw: bytes) -> Layout:
    for size in (4, 8):
        for order in "<>":
            real = np.dtype(f"{order}f{size}")
            head = np.frombuffer(raw, dtype=real, count=min(len(raw) // size, 512))
            bytes_of = np.frombuffer(raw, dtype=np.uint8, count=len(head) * size).reshape(-1, size)
            n = head[25] if len(head) > 28 else 0
            if 1 <= n <= 500 and n == round(float(n)) and all(32 <= b < 127 for b in bytes_of[28, :4].tolist()):
                return described(head, bytes_of, real, int(n))
    raise ValueError("not a paged table")


def described(head: np.ndarray, bytes_of: np.ndarray, real: np.dtype, n: int) -> Layout:
    pages, last = int(head[26]), int(head[27])
    found: dict[str, list[tuple]] = {}
    for k in range(28, min(28 + 7 * n, len(head) - 6), 7):
        found.setdefault(letters(bytes_of[k : k + 2]), []).append((float(head[k + 4]), int(head[k + 3]), letters(bytes_of[k + 2 : k + 3])[:1].upper() == "A", k + 6))
    columns, record = [], 0
    for name, entries in found.items():
        entries.sort()
        text, words = entries[0][2], tuple(e[1] for e in entries)
        record = max(record, *words)
        if words[0]:
            columns.append(Column(name, text, words))
        else:
            at = [e[3] for e in entries]
            value = letters(bytes_of[at]) if text else float(head[at[0]])
            columns.append(Column(name, text, (), None if not text and abs(value) > ABSENT else value))
    per_page = WORDS // record if record else 0
    return Layout(real, 512, record, (pages - 2) * per_page + last if pages > 1 else last, tuple(columns))


def decode(raw: bytes, names: Sequence[str] | None = None) -> pd.DataFrame:
    one = layout(raw)
    per_page = WORDS // max(one.record, 1)
    words = np.frombuffer(raw, dtype=one.real, count=len(raw) // one.real.itemsize // one.page * one.page).reshape(-1, one.page)[1:]
    records = words[:, : per_page * one.record].reshape(-1, one.record)[: one.rows]
    out = {}
    for c in one.columns:
        if names is not None and c.name not in names:
            continue
        if not c.words:
            out[c.name] = [c.constant] * one.rows
        elif c.text:
            cells = np.stack([np.ascontiguousarray(records[:, w - 1]).view(np.uint8).reshape(-1, one.real.itemsize)[:, :4] for w in c.words], axis=1)
            out[c.name] = [bytes(b for b in row.ravel().tolist() if 32 <= b < 127).decode().strip() for row in cells]
        else:
            v = records[:, c.words[0] - 1].astype(float)
            out[c.name] = np.where(np.abs(v) > ABSENT, np.nan, v)
    return pd.DataFrame(out)[list(names)] if names is not None else pd.DataFrame(out)


def encode(columns: dict[str, Sequence], extended: bool = True) -> bytes:
    """A file of numbers and short texts, for round trips; None is absent."""
    real = np.dtype("<f8" if extended else "<f4")
    rows = len(next(iter(columns.values())))
    entries, record, stored = [], 0, []
    for name, values in columns.items():
        text = any(isinstance(v, str) for v in values)
        width = max(1, -(-max((len(v or "") for v in values), default=1) // 4)) if text else 1
        for k in range(width):
            record += 1
            entries.append((name, text, record, k + 1))
            if text:
                cell = np.zeros((rows, real.itemsize), dtype=np.uint8)
                for i, v in enumerate(values):
                    part = (v or "")[4 * k : 4 * k + 4].ljust(4).encode()
                    cell[i, :4] = list(part)
                stored.append(cell.view(real)[:, 0])
            else:
                stored.append(np.array([1e30 * -1 if v is None else v for v in values], dtype=real))
    per_page = WORDS // record
    n_pages = -(-rows // per_page)
    head = np.zeros((512, real.itemsize), dtype=np.uint8)
    numbers = head.view(real)[:, 0]
    numbers[24:28] = [20240101, len(entries), n_pages + 1, rows - (n_pages - 1) * per_page if rows else 0]
    for k, (name, text, word, part) in enumerate(entries):
        at = 28 + 7 * k
        for j in range(2):
            head[at + j, :4] = list(name[4 * j : 4 * j + 4].ljust(4).encode())
        head[at + 2, :4] = list((b"A   " if text else b"N   "))
        numbers[at + 3], numbers[at + 4] = word, part
    body = np.zeros((n_pages, 512), dtype=real)
    for p in range(n_pages):
        some = np.stack([s[p * per_page : (p + 1) * per_page] for s in stored], axis=1)
        body[p, : some.size] = some.ravel()
    return head.tobytes() + body.tobytes()


def read_paged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all files; ``schema`` names the columns that are decoded."""
    import re

    names = re.findall(r"`?(\w+)`? \w+", schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                yield decode(raw, names)

    return files(spark, path).select("content").mapInPandas(run, schema)
