"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the workers.

Training: a first pass counts the words, by 64-bit hashes, and numbers them, frequent ones first. A second one collapses the
n-grams of some million tokens at a time and deals them, as packed and compressed word numbers, by the hash of their context.
What meets in a part are the distinct n-grams of its contexts, so counts (64 bits), context totals and the numbers of
successors seen once, twice and more often are sums over one sorted array. Each distinct n-gram then counts once for its
suffix, an n-gram one shorter, and is dealt on by that one's context: the same step for each order down to single words.
Each part writes a file to the shared folder under a temporary name and renames it, so a task that runs again does no harm.
It has contexts by hash, those with one successor apart, as their totals follow from its count, and successors by number.

Scoring: workers map the files and look up each block's distinct contexts in order. There is no shuffle.

Scale: the number of parts follows the number of input partitions, so a part stays of one size. However often a hot pair
of words occurs, a task sends it once; a context's part holds distinct successors, a vocabulary at most. The
driver gets some dozen sums a part.

The model: a text's words, then one end; before the first word stand order - 1 begin marks. With c the count of an
n-gram (of the highest order) or the number of distinct words before it (of lower ones), h its context:
p(w|h) = max(c(hw) - D(c), 0) / c(h.) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) / c(h.) * p(w|h'), or p(w|h') if h
is unknown, and below single words a uniform 1 / (V + 1). The sum over the vocabulary and one unknown word is 1.

Defined cases: a null or empty text is one end token; a null key is trained on; without any training text every token has
probability 1 / (V + 1) = 1; rows that repeat count again; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Block, blocks, byte_list, mix, shared_path, sorted_counts

END = int(mix(np.array([0xE0], dtype=U64))[0])
MULTIPLIER = U64(0x9E3779B97F4A7C15)
#: Numbers that no word has: of what stands before a text, and of words without a number.
BEGIN, UNKNOWN = (1 << 32) - 2, (1 << 32) - 1
#: Tokens that a task collapses at a time.
FLUSH = 3_000_000
#: Bytes of text that are scored together.
SCORED = 6 << 20


def tokens_of(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, an end after each text's words, and where each text's tokens start (and the end)."""
    n = len(b.n_words)
    first = np.concatenate(([0], np.cumsum(b.n_words + 1)))
    out = np.empty(first[-1], dtype=U64)
    last = np.zeros(first[-1], dtype=bool)
    last[first[1:] - 1] = True
    out[last] = U64(END)
    out[~last] = b.word_hashes()[b.first_word[0] : b.first_word[n]]
    return out, first


def before(ids: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Numbers of the words order - 1, ..., 2, 1 before each token."""
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    out: list[np.ndarray] = []
    for k in range(order - 1, 0, -1):
        column = np.full(len(ids), BEGIN, dtype=np.uint32)
        some = np.flatnonzero(place >= k)
        column[some] = ids[some - k]
        out.append(column)
    return out


def context_hashes(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=U64)
    for c in reversed(columns):
        h = mix(h * MULTIPLIER + c.astype(U64) + U64(1))
    return h


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(48)) * U64(parts) >> U64(16)).astype(np.int64)


#: Counts from here on are packed apart, as eight bytes.
LARGE = 255
CODEC = pa.Codec("zstd", compression_level=1)


def pack(columns: list[np.ndarray], counts: np.ndarray, parts: int, kind: int, part: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(kind, part, packed rows) by ``part``, in order, or by the part of the first column; rows that are sorted pack best.

    The first column goes as differences; bytes of one place stand together, so what numbers have in common is squeezed out.
    """
    part = part_of(columns[0], parts) if part is None else part
    edge = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)):
        s = slice(edge[p], edge[p + 1])
        c = counts[s]
        large = c[c >= LARGE].astype(np.int64)
        own = [x[s].astype(U64) for x in columns]
        own[0] = np.diff(own[0], prepend=U64(0))
        rows = b"".join([*(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in own), np.minimum(c, LARGE).astype(np.uint8).tobytes()])
        yield kind, int(p), b"".join([np.array([len(c), len(large)], dtype=np.int64).tobytes(), large.tobytes(), CODEC.compress(rows, asbytes=True)])


def unpack(blobs: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in range(width)]
    counts = []
    for b in blobs:
        n, m = np.frombuffer(b, dtype=np.int64, count=2).tolist()
        at = 16 + 8 * m
        rows = np.frombuffer(CODEC.decompress(b[at:], (8 * width + 1) * n, asbytes=True), dtype=np.uint8)
        for k in range(width):
            x = np.ascontiguousarray(rows[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T).view(U64)[:, 0]
            columns[k].append(x if k else np.cumsum(x, dtype=U64))
        c = rows[8 * n * width :].astype(np.int64)
        c[c == LARGE] = np.frombuffer(b, dtype=np.int64, count=m, offset=16)
        counts.append(c)
    if not blobs:
        return [np.zeros(0, dtype=U64)] * width, np.zeros(0, dtype=np.int64)
    return [np.concatenate(c) for c in columns], np.concatenate(counts)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def collapse(columns: list[np.ndarray], counts: np.ndarray | None, lead: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray | None]:
    """Distinct rows, their sums and their ``lead``, which the columns but the last fix and by which the rows are sorted first (else by the columns)."""
    keys = list(columns) if lead is None else [lead, columns[-1]]
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return [c[:0] for c in columns], np.zeros(0, dtype=np.int64), lead
    sums = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at)
    rows = order[at]
    return [c[rows] for c in columns], sums, None if lead is None else lead[rows]


def mounted(path: str) -> str:
    """The plain path of a shared folder: to be memory-mapped it has to be mounted on all machines."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be a mounted folder, not {path}")
    return path


def save(path: str, name: str, array: np.ndarray) -> None:
    part = f"{path}/.{name}-{uuid.uuid4().hex}.npy"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{path}/{name}.npy")


def save_together(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of several arrays, so that a worker maps one for each part."""
    head, at, rows = [], 0, []
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append((k, a.dtype.str, a.shape, at))
        rows.append(raw + b"\0" * (-len(raw) % 8))
        at += len(rows[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + b"".join(rows))
    os.replace(part, f"{path}/{name}.arrays")


def mapped(path: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file by ``save_together``, or None if there is none."""
    if not os.path.exists(f"{path}/{name}.arrays"):
        return None
    raw = np.memmap(f"{path}/{name}.arrays", dtype=np.uint8, mode="r").view(np.ndarray)
    at = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for k, kind, shape, start in json.loads(raw[8:at].tobytes()):
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[k] = raw[at + start : at + start + size].view(kind).reshape(shape)
    return out


def discounts(n: list[int]) -> list[float]:
    """D for counts 0, 1, 2, 3 and more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return [0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))]


def count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


@dataclass(frozen=True)
class Model:
    """Where the arrays are and the sums that the driver has. ``discount[n]`` is for n-grams."""

    path: str
    order: int
    parts: int
    tokens: int
    vocabulary: int
    continuations: int
    discount: tuple[tuple[float, ...], ...]
    unknown_mass: float


def train(docs: DataFrame, text: str = "text", order: int = 3, path: str | None = None) -> Model:
    """Counts the n-grams of every text of ``docs`` and writes the model to ``path``, a shared folder."""
    spark = docs.sparkSession
    path = mounted(path or shared_path(spark, "kneser-ney"))
    source = docs.select(F.col(f"`{text}`").alias("__text"))
    parts = max(64, 4 * source.rdd.getNumPartitions())
    os.makedirs(path, exist_ok=True)
    total, vocabulary = number(source, path, parts)
    step = -(-vocabulary // parts) or 1
    schema = "kind int, part int, blob binary"

    def dealt(columns: list[np.ndarray], counts: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
        """n-grams by the hash of their context, single words by ranges of their numbers."""
        part = (columns[0] // step).astype(np.int64) if n == 1 else part_of(context_hashes(columns[:-1]), parts)
        order = np.argsort(part, kind="stable")
        return pack([c[order] for c in columns], counts[order], parts, n, part[order])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, known = 0, Tables(path, parts)

        def flush() -> Iterator[pa.RecordBatch]:
            grams, sums, _ = collapse([np.concatenate(c) for c in zip(*held)], None)
            for kind, part, blob in dealt(grams, sums, order):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            texts = byte_list(batch.column(0))
            for i, j in blocks(texts, SCORED):
                tokens, first = tokens_of(Block(texts[i:j], lower=True))
                words, place = distinct(tokens)
                ids = known.words(words)[0][place]
                held.append([*before(ids, first, order), ids])
                size += len(tokens)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def reduce(n: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            kind, part = int(key[0]), int(key[1])
            if kind > n:  # sums of a higher order
                return pdf[["kind", "part", "blob", "stats"]]
            columns, c = unpack(pdf["blob"].tolist(), n)
            columns, c, context = collapse(columns, c, context_hashes(columns[:-1]))
            word = columns[-1].astype(np.uint32)
            new = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            size = np.diff(np.append(new, len(c)))
            alone = new[size == 1]
            many, row = size > 1, np.repeat(size > 1, size)
            of = lambda x: np.add.reduceat(x.astype(np.int64), new)[many]
            arrays = {"alone": context[alone], "alone_word": word[alone], "alone_count": narrow(c[alone])}
            arrays |= {"contexts": context[new[many]], "starts": narrow(np.concatenate(([0], np.cumsum(size[many])))), "words": word[row], "counts": narrow(c[row])}
            arrays |= {f"total{k}": narrow(of(x)) for k, x in enumerate((c, c == 1, c == 2, c > 2))}
            save_together(path, f"{n}-{part}", arrays)
            rows = [(n, part, None, count_of_counts(c))]
            lower, sums, _ = collapse(columns[1:], np.ones(len(c), dtype=np.int64))
            rows += [(x[0], x[1], x[2], None) for x in dealt(lower, sums, n - 1)]
            return pd.DataFrame(rows, columns=["kind", "part", "blob", "stats"])

        return run

    def words(part: int, pdf: pd.DataFrame) -> pd.DataFrame:
        (ids,), seen, _ = collapse(*unpack(pdf["blob"].tolist(), 1))
        after = np.zeros(min(step, vocabulary - part * step), dtype=np.int64)
        after[ids.astype(np.int64) - part * step] = seen
        save_together(path, f"1-{part}", {"counts": narrow(after)})
        stats = [*count_of_counts(after), int(after.sum()), int((after > 2).sum())]
        return pd.DataFrame([(1, part, None, stats)], columns=["kind", "part", "blob", "stats"])

    out = "kind int, part int, blob binary, stats array<long>"
    flow = source.mapInArrow(count, schema).withColumn("stats", F.lit(None).cast("array<long>"))
    for n in range(order, 1, -1):
        flow = flow.groupBy("kind", "part").applyInPandas(reduce(n), out)

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stats = pdf[pdf["stats"].notna()][["kind", "part", "blob", "stats"]]
        rest = pdf[pdf["stats"].isna()]
        return pd.concat([stats, words(int(key[0]), rest)]) if len(rest) else stats

    found = flow.groupBy("part").applyInPandas(finish, out).select("kind", "stats").collect()
    by: dict[int, np.ndarray] = {}
    for r in found:
        by[r["kind"]] = by.get(r["kind"], 0) + np.array(r["stats"], dtype=np.int64)
    one = by.get(1, np.zeros(6, dtype=np.int64))
    discount = [(0.0,) * 4, tuple(discounts(one[:4])), *(tuple(discounts(by[n] if n in by else [0] * 4)) for n in range(2, order + 1))]
    d = discount[1]
    continuations = int(one[4])
    unknown = (d[1] * one[0] + d[2] * one[1] + d[3] * one[5]) / continuations if continuations else 1.0
    return Model(path, order, parts, total, vocabulary, continuations, tuple(discount), float(unknown))


def number(source: DataFrame, path: str, parts: int) -> tuple[int, int]:
    """Counts the words and numbers them, by powers of two of their counts, the most frequent first; returns how many tokens and words there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, raw = sorted_counts(np.concatenate(held))
            for _, part, blob in pack([words], raw, parts, 0):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            texts = byte_list(batch.column(0))
            for i, j in blocks(texts):
                held.append(tokens_of(Block(texts[i:j], lower=True))[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (words,), raw, _ = collapse(*unpack(pdf["blob"].tolist(), 1))
        power = power_of(raw)
        order = np.argsort(-power, kind="stable")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order))
        save_together(path, f"words-{int(key[0])}", {"words": words, "raw": narrow(raw), "places": place})
        return pd.DataFrame([(int(key[0]), int(raw.sum()), np.bincount(power, minlength=64).tolist())], columns=["part", "tokens", "powers"])

    found = source.mapInArrow(count, "part int, blob binary").groupBy("part").applyInPandas(reduce, "part int, tokens long, powers array<long>").collect()
    sizes = np.zeros((parts, 64), dtype=np.int64)
    for r in found:
        sizes[r["part"]] = r["powers"]
    sizes = sizes[:, ::-1]  # the most frequent first
    within = np.cumsum(sizes, axis=1) - sizes
    overall = np.cumsum(sizes.T.reshape(-1)).reshape(64, parts).T - sizes
    if sizes.sum() >= BEGIN:
        raise ValueError("more words than 32 bits can number")
    save(path, "shifts", (overall - within)[:, ::-1])
    return sum(r["tokens"] for r in found), int(sizes.sum())


def power_of(raw: np.ndarray) -> np.ndarray:
    """The power of two at or below each count, or next to it where a double rounds."""
    return np.frexp(raw.astype(np.float64))[1].astype(np.int64) - 1


class Tables:
    """The mapped arrays of a model, opened part by part when they are first asked for."""

    def __init__(self, path: str, parts: int, step: int = 1):
        self.path, self.parts, self.step, self.open = path, parts, step, {}
        self.shifts = np.load(f"{path}/shifts.npy")

    def get(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.open:
            self.open[name] = mapped(self.path, name)
        return self.open[name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words by their sorted hashes; zero counts where a word is unknown."""
        ids, raw = np.full(len(hashes), UNKNOWN, dtype=np.uint32), np.zeros(len(hashes), dtype=np.int64)
        edge = np.searchsorted(part_of(hashes, self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edge)):
            t, own = self.get(f"words-{p}"), hashes[edge[p] : edge[p + 1]]
            if t is None:
                continue
            at = np.minimum(np.searchsorted(t["words"], own), len(t["words"]) - 1)
            hit = np.flatnonzero(t["words"][at] == own)
            at, to = at[hit], hit + edge[p]
            raw[to] = t["raw"][at]
            ids[to] = t["places"][at] + self.shifts[p, power_of(raw[to])]
        return ids, raw

    def continuations(self, ids: np.ndarray) -> np.ndarray:
        """How many distinct words stand before each word; zero if it is unknown."""
        out = np.zeros(len(ids), dtype=np.int64)
        order = np.argsort(ids)
        order = order[: np.searchsorted(ids[order], BEGIN)]
        part = ids[order].astype(np.int64) // self.step
        edge = np.searchsorted(part, np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edge)):
            own = order[edge[p] : edge[p + 1]]
            if t := self.get(f"1-{p}"):
                out[own] = t["counts"][ids[own].astype(np.int64) - p * self.step]
        return out

    def look(self, n: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its n-gram's count, and the sums of each distinct context with each token's place among them."""
        known, place = distinct(context)
        order = np.argsort(place, kind="stable")
        at_word, at_place = word[order], place[order]
        counts, totals = np.zeros(len(word), dtype=np.int64), np.zeros((len(known), 4), dtype=np.int64)
        edge = np.searchsorted(part_of(known, self.parts), np.arange(self.parts + 1))
        token = np.searchsorted(at_place, edge)
        for p in np.flatnonzero(np.diff(edge)):
            t = self.get(f"{n}-{p}")
            if t is None:
                continue
            own, rows = known[edge[p] : edge[p + 1]], order[token[p] : token[p + 1]]
            w, k = at_word[token[p] : token[p + 1]], at_place[token[p] : token[p + 1]] - edge[p]
            if len(t["alone"]):
                at = np.minimum(np.searchsorted(t["alone"], own), len(t["alone"]) - 1)
                hit = t["alone"][at] == own
                c = t["alone_count"][at[hit]].astype(np.int64)
                totals[edge[p] + np.flatnonzero(hit)] = np.stack((c, c == 1, c == 2, c > 2), axis=1)
                same = hit[k]
                same[same] = t["alone_word"][at[k[same]]] == w[same]
                counts[rows[same]] = t["alone_count"][at[k[same]]]
            if len(t["contexts"]):
                at = np.minimum(np.searchsorted(t["contexts"], own), len(t["contexts"]) - 1)
                hit = t["contexts"][at] == own
                for x in range(4):
                    totals[edge[p] + np.flatnonzero(hit), x] = t[f"total{x}"][at[hit]]
                some = np.flatnonzero(hit[k])
                start = t["starts"][at[k[some]]].astype(np.int64)
                end = t["starts"][at[k[some]] + 1].astype(np.int64)
                found = bisected(t["words"], start, end, w[some])
                same = found < end
                same[same] = t["words"][found[same]] == w[some[same]]
                counts[rows[some[same]]] = t["counts"][found[same]]
        return counts, totals, place


def bisected(values: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The first place in ``low`` to ``high`` of ``values``, which are sorted there, that is not below what is asked, or ``high``."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = values[middle] < asked[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


_TABLES: dict[str, Tables] = {}


def tables(model: Model) -> Tables:
    if model.path not in _TABLES:
        _TABLES.clear()
        _TABLES[model.path] = Tables(model.path, model.parts, -(-model.vocabulary // model.parts) or 1)
    return _TABLES[model.path]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and, for each value, its place among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, dtype=bool)
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def log_probabilities(model: Model, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of each token under the model, and its count in training."""
    t = tables(model)
    words, place = distinct(tokens)
    ids, raw = t.words(words)
    after = t.continuations(ids)
    d = np.array(model.discount[1])
    p = np.full(len(words), model.unknown_mass / (model.vocabulary + 1))
    if model.continuations:
        p += np.maximum(after - d[np.minimum(after, 3)], 0) / model.continuations
    p = p[place]
    ids = ids[place]
    columns = before(ids, first, model.order)
    for n in range(2, model.order + 1):
        d = np.array(model.discount[n])
        c, totals, known_place = t.look(n, context_hashes(columns[model.order - n :]), ids)
        all_of = np.maximum(totals[:, 0], 1)
        back = np.where(totals[:, 0] > 0, (totals[:, 1:] * d[1:]).sum(axis=1) / all_of, 1.0)[known_place]
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / all_of[known_place] + back * p
    return np.log10(p), raw[place]


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row of ``docs``."""
    source = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_list(batch.column(1))
            for i, j in blocks(texts, SCORED):
                tokens, first = tokens_of(Block(texts[i:j], lower=True))
                logs, c = log_probabilities(model, tokens, first)
                base = np.log10((c + 1) / (model.tokens + model.vocabulary + 1))
                n, at = np.diff(first), first[:-1]
                score = np.add.reduceat(logs, at)
                columns = {"n_tokens": n, "n_known": np.add.reduceat((c > 0).astype(np.int64), at), "train_tokens": np.full(j - i, model.tokens), "base_score": np.add.reduceat(base, at), "score": score, "perplexity": np.power(10.0, np.minimum(-score / n, 300))}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(v) for v in columns.values())], names=["__id", *columns])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"__id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").withColumnRenamed("__id", key)


def held_out(key: str = "doc_id") -> Column:
    """True for the rows that training leaves out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))
