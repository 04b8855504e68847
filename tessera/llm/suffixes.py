"""Removal of long repeats through a logarithmic family of sparse suffix arrays.

Each window of ``LENGTH`` bytes has an anchor: the position of its least hash of ``SEED_BYTES`` bytes, leftmost first. Equal
windows have their anchors at equal offsets, so the suffixes that start at anchors are enough of a suffix
array to find every repeat. Neighbouring windows with one anchor form a run.

The family: a batch's anchor suffixes are dealt by range of their leading hash and sorted into an array for each
range. That array is scanned along the arrays of the levels that exist, which gives the suffixes that a level
has as well, and then levels of equal size merge two by two, like a binary counter; so a suffix
is written as often as the logarithm of the number of batches. Order is that of the leading hash: only
equality of leading bytes is asked for, and it is a merge scan in any order.

With all batches in, the texts are read again. Runs whose suffix occurs once are done with. The others send their
bytes, collapsed by content, to the range of their suffix, where windows are compared: a window repeats if its content
was seen more than once, in whichever runs. A suffix that occurs more than ``HOT`` times sends its windows' hashes
instead, spread by window, so that no range has to hold what stands around a very common line. What
was decided is left as sorted arrays, and a last reading of the texts looks up its runs and cuts.

Texts are never shuffled. Arrays are written under a temporary name and renamed, so tasks may run again; workers map
them into memory. Strings are told apart by 64-bit hashes: among n strings n * n / 2 ** 65 false matches are expected.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; repeated rows match one another; rows with
null or repeated keys are separate texts; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, U64, _powers, byte_list, mix, shared_path, sorted_counts
from .kneser_ney import mounted, part_of, save

LENGTH = 200
SEED_BYTES = 40
#: Windows with one anchor: at most so many stand in a row.
MOST_WINDOWS = LENGTH - SEED_BYTES + 1
MASK_BYTES = -(-MOST_WINDOWS // 8)
#: Occurrences of a suffix beyond which its windows are dealt one by one.
HOT = 4096
#: Bytes of text hashed together; longer texts are cut into pieces that overlap.
PIECE = 1 << 19
#: Bytes of run contents, or suffixes, that a task collapses at a time.
FLUSH_BYTES = 8 << 20
FLUSH_SUFFIXES = 1 << 19
PLACE = U64((1 << 30) - 1)


@dataclass
class Runs:
    """Runs of some pieces: ``piece`` and, in it, first and last window start; the suffix hash; prefix sums of the bytes."""

    buf: np.ndarray
    total: np.ndarray
    piece: np.ndarray
    first: np.ndarray
    last: np.ndarray
    suffix: np.ndarray

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts of the runs ``some`` and the hashes of the windows."""
        n = self.last[some] - self.first[some] + 1
        at = np.repeat(self.first[some] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        return at, window_hashes(self.total, at)

    def content_hashes(self, some: np.ndarray) -> np.ndarray:
        a, b = self.first[some], self.last[some] + LENGTH
        down = _powers(len(self.total))[1]
        return mix((self.total[b] - self.total[a]) * down[a] + (b - a).astype(U64))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up = _powers(len(buf) + 1)[0]
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=total[1:])
    return total


def window_hashes(total: np.ndarray, at: np.ndarray) -> np.ndarray:
    down = _powers(len(total))[1]
    return mix((total[at + LENGTH] - total[at]) * down[at])


def runs_of(pieces: list[bytes]) -> Runs:
    buf = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    end = np.cumsum(size)
    n = len(buf) - LENGTH + 1
    if n <= 0:
        nothing = np.zeros(0, dtype=np.int64)
        return Runs(buf, np.zeros(1, dtype=U64), nothing, nothing, nothing, np.zeros(0, dtype=U64))
    total, down = prefix_sums(buf), _powers(len(buf) + 1)[1]
    seeds = mix((total[SEED_BYTES:] - total[:-SEED_BYTES]) * down[: len(buf) - SEED_BYTES + 1])
    least = (seeds & ~PLACE) | np.arange(len(seeds), dtype=U64)
    width = 1
    while width * 2 <= MOST_WINDOWS:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[MOST_WINDOWS - width : MOST_WINDOWS - width + n])
    anchor = (least & PLACE).astype(np.int64)
    inside = np.ones(n, dtype=bool)
    for e in end[:-1]:  # windows that begin in one piece and end in the next
        inside[max(0, e - LENGTH + 1) : min(e, n)] = False
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    # anchors are least hashes: mixed once more they spread evenly over the parts
    return Runs(buf, total, np.searchsorted(end, first, side="right"), first, last, mix(~seeds[anchor[first]]))


def pieces_of(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Pieces to be hashed together, and the text and offset of each."""
    held: list[bytes] = []
    place: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            piece = t[at : at + PIECE + LENGTH - 1] if at or len(t) > PIECE else t
            if held and size + len(piece) > PIECE:
                yield held, place
                held, place, size = [], [], 0
            held.append(piece)
            place.append((i, at))
            size += len(piece)
    if held:
        yield held, place


def dealt(h: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Ranges of the sorted ``h`` by part."""
    edge = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)):
        yield int(p), slice(edge[p], edge[p + 1])


def row(kind: int, part: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "blob": pa.array([blob], pa.binary())})


ROWS = "kind int, part int, blob binary"
_OPEN: dict[str, np.ndarray] = {}


def mapped(path: str) -> np.ndarray:
    if path not in _OPEN:
        if len(_OPEN) > 4096:
            _OPEN.clear()
        _OPEN[path] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, dtype=U64)
    return _OPEN[path]


def positions(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sorted ``asked`` in the sorted ``known``, and which of them are there."""
    if not len(known):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


@dataclass
class Family:
    """Levels of suffix arrays. ``levels`` has (name, batches in it), the largest first."""

    path: str
    parts: int
    hot: int = HOT
    levels: list[tuple[str, int]] = field(default_factory=list)
    inserted: int = 0

    def counts(self, asked: np.ndarray) -> np.ndarray:
        """How often the sorted suffixes ``asked`` occur in all levels."""
        out = np.zeros(len(asked), dtype=np.int64)
        for p, s in dealt(asked, self.parts):
            for name, _ in self.levels:
                at, hit = positions(mapped(f"{self.path}/{name}-{p}-suffixes.npy"), asked[s])
                if hit.any():
                    out[s][hit] += mapped(f"{self.path}/{name}-{p}-counts.npy")[at[hit]]
        return out

    def insert(self, batch: DataFrame, text: str = "text") -> int:
        """Adds the texts of ``batch`` as a new level, scans the others for its suffixes and merges; returns how many of its suffixes a level had."""
        parts, path = self.parts, self.path
        name, size, merged = f"l{self.inserted}", 1, []
        levels = list(self.levels)
        while levels and levels[-1][1] == size:
            merged.append(levels.pop()[0])
            size *= 2
        others, old = [x for x, _ in levels], list(merged)

        def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def flush() -> Iterator[pa.RecordBatch]:
                values, n = sorted_counts(np.concatenate(held))
                for p, s in dealt(values, parts):
                    yield row(0, p, values[s].tobytes() + n[s].astype(np.uint32).tobytes())

            for b in batches:
                for pieces, _ in pieces_of(byte_list(b.column(0))):
                    held.append(runs_of(pieces).suffix)
                    if sum(map(len, held)) > FLUSH_SUFFIXES:
                        yield from flush()
                        held = []
            if held:
                yield from flush()

        def insert(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            part = int(key[0])
            arrays = [(np.frombuffer(b, dtype=U64, count=len(b) // 12), np.frombuffer(b, dtype=np.uint32, offset=len(b) // 12 * 8).astype(np.int64)) for b in pdf["blob"]]
            own, n = merge(arrays)
            had = np.zeros(len(own), dtype=bool)
            for level in others + old:
                had |= positions(mapped(f"{path}/{level}-{part}-suffixes.npy"), own)[1]
            for level in old:
                suffix, c = mapped(f"{path}/{level}-{part}-suffixes.npy"), mapped(f"{path}/{level}-{part}-counts.npy")
                own, n = merge([(own, n), (np.asarray(suffix, dtype=U64), np.asarray(c, dtype=np.int64))])
            save(path, f"{name}-{part}-suffixes", own)
            save(path, f"{name}-{part}-counts", np.minimum(n, 2**32 - 1).astype(np.uint32))
            return pd.DataFrame({"matched": [int(had.sum())]})

        rows = batch.select(F.col(f"`{text}`").alias("__text")).mapInArrow(suffixes, ROWS)
        if old:  # parts that this batch has nothing in are merged too
            rows = rows.unionByName(rows.sparkSession.range(parts).select(F.lit(0).alias("kind"), F.col("id").cast("int").alias("part"), F.lit(b"").alias("blob")))
        matched = rows.groupBy("part").applyInPandas(insert, "matched long").agg(F.sum("matched")).first()[0]
        self.levels = [*levels, (name, size)]
        self.inserted += 1
        return matched or 0


def merge(arrays: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of sorted arrays and the sums of their counts."""
    arrays = [a for a in arrays if len(a[0])]
    if not arrays:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    values, n = np.concatenate([a[0] for a in arrays]), np.concatenate([a[1] for a in arrays])
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[new], np.add.reduceat(n, new)


def by_sorted(h: np.ndarray, ask: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``ask`` of the sorted distinct values, given back in ``h``'s order."""
    order = np.argsort(h)
    new = np.ones(len(h), dtype=bool)
    ordered = h[order]
    new[1:] = ordered[1:] != ordered[:-1]
    got = ask(ordered[new])
    out = np.empty((len(h), *got.shape[1:]), dtype=got.dtype)
    out[order] = got[np.cumsum(new) - 1]
    return out


@dataclass(frozen=True)
class Verdicts:
    """Which windows repeat: masks by run content, and hashes of windows around very common suffixes."""

    family: Family

    def repeated(self, r: Runs) -> np.ndarray:
        """Starts of the windows of ``r`` that repeat."""
        path, parts, hot_from = self.family.path, self.family.parts, self.family.hot
        n = by_sorted(r.suffix, self.family.counts)
        found = []
        cold = np.flatnonzero((n > 1) & (n <= hot_from))
        if len(cold):
            mask = by_sorted(key_of(r.suffix[cold], r.content_hashes(cold)), lambda k: self._masks(path, parts, k))
            bits = np.unpackbits(mask, axis=1, bitorder="little")[:, :MOST_WINDOWS].astype(bool)
            run, at = np.nonzero(bits)
            found.append(r.first[cold][run] + at)
        hot = np.flatnonzero(n > hot_from)
        if len(hot):
            at, h = r.windows(hot)
            found.append(at[by_sorted(h, lambda k: self._hot(path, parts, k))])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    @staticmethod
    def _masks(path: str, parts: int, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), MASK_BYTES), dtype=np.uint8)
        for p, s in dealt(keys, parts):
            at, hit = positions(mapped(f"{path}/runs-{p}-keys.npy"), keys[s])
            if hit.any():
                out[s][hit] = mapped(f"{path}/runs-{p}-masks.npy")[at[hit]]
        return out

    @staticmethod
    def _hot(path: str, parts: int, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=bool)
        for p, s in dealt(h, parts):
            out[s] = positions(mapped(f"{path}/hot-{p}-windows.npy"), h[s])[1]
        return out


TOP16 = U64(0xFFFF << 48)


def key_of(suffix: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Of a run's content, in the part of its suffix."""
    return (suffix & TOP16) | (content >> U64(16))


def compare(docs: DataFrame, family: Family, text: str = "text") -> Verdicts:
    """Compares the windows of runs whose suffixes occur more than once, and leaves what was found as arrays."""
    parts, path, hot_from = family.parts, family.path, family.hot

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # key: times, suffix, content
        size = 0
        hot: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.array(sorted(held), dtype=U64)
            for p, s in dealt(keys, parts):
                rows = [held[k] for k in keys[s].tolist()]
                sizes = np.array([len(x[1]) for x in rows], dtype=np.uint32)
                times = np.array([x[0] for x in rows], dtype=np.uint32)
                yield row(0, p, np.int64(len(rows)).tobytes() + keys[s].tobytes() + times.tobytes() + sizes.tobytes() + b"".join(x[1] for x in rows))

        def flush_hot() -> Iterator[pa.RecordBatch]:
            values, n = sorted_counts(np.concatenate(hot))
            for p, s in dealt(values, parts):
                yield row(1, p, values[s].tobytes() + n[s].astype(np.uint32).tobytes())

        for b in batches:
            for pieces, _ in pieces_of(byte_list(b.column(0))):
                r = runs_of(pieces)
                n = by_sorted(r.suffix, family.counts)
                cold = np.flatnonzero((n > 1) & (n <= hot_from))
                raw = r.buf.tobytes() if len(cold) else b""
                for k, a, z in zip(key_of(r.suffix[cold], r.content_hashes(cold)).tolist(), r.first[cold].tolist(), (r.last[cold] + LENGTH).tolist()):
                    if k in held:
                        held[k][0] += 1
                    else:
                        held[k] = [1, raw[a:z]]
                        size += z - a + 100
                if size > FLUSH_BYTES:
                    yield from flush()
                    held, size = {}, 0
                some = np.flatnonzero(n > hot_from)
                if len(some):
                    hot.append(r.windows(some)[1])
                    if sum(map(len, hot)) > FLUSH_SUFFIXES:
                        yield from flush_hot()
                        hot = []
        if held:
            yield from flush()
        if hot:
            yield from flush_hot()

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, part = int(key[0]), int(key[1])
        if kind == 1:
            values, n = merge([(np.frombuffer(b, dtype=U64, count=len(b) // 12), np.frombuffer(b, dtype=np.uint32, offset=len(b) // 12 * 8).astype(np.int64)) for b in pdf["blob"]])
            save(path, f"hot-{part}-windows", values[n > 1])
            return pd.DataFrame({"n": [int((n > 1).sum())]})
        times: dict[int, int] = {}
        content: dict[int, bytes] = {}
        for b in pdf["blob"]:
            n = int(np.frombuffer(b, dtype=np.int64, count=1)[0])
            keys = np.frombuffer(b, dtype=U64, count=n, offset=8).tolist()
            seen = np.frombuffer(b, dtype=np.uint32, count=n, offset=8 + 8 * n).tolist()
            sizes = np.frombuffer(b, dtype=np.uint32, count=n, offset=8 + 12 * n).tolist()
            at = 8 + 16 * n
            for k, t, s in zip(keys, seen, sizes):
                times[k] = times.get(k, 0) + t
                if k not in content:
                    content[k] = b[at : at + s]
                at += s
        keys = np.array(sorted(content), dtype=U64)
        whole = [content[k] for k in keys.tolist()]
        many = np.array([times[k] > 1 for k in keys.tolist()])
        size = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        ranges = list(chunks(size))
        hashes = [windows_of(whole[i:j], size[i:j])[2] for i, j in ranges]
        values, seen = sorted_counts(np.concatenate(hashes))
        values = values[seen > 1]
        bits = np.zeros((len(keys), MASK_BYTES * 8), dtype=bool)
        for (i, j), h in zip(ranges, hashes):
            run, place, _ = windows_of(whole[i:j], size[i:j], False)
            bits[run + i, place] = many[run + i] | positions(values, h)[1]
        some = bits.any(axis=1)
        save(path, f"runs-{part}-keys", keys[some])
        save(path, f"runs-{part}-masks", np.packbits(bits[some], axis=1, bitorder="little"))
        return pd.DataFrame({"n": [int(bits.sum())]})

    rows = docs.select(F.col(f"`{text}`").alias("__text")).mapInArrow(gather, ROWS)
    rows.groupBy("kind", "part").applyInPandas(decide, "n long").agg(F.sum("n")).first()
    return Verdicts(family)


def windows_of(contents: list[bytes], size: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each content: which content, where in it, and its hash."""
    n = size - LENGTH + 1
    run = np.repeat(np.arange(len(contents)), n)
    place = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    if not hashed:
        return run, place, run
    start = np.cumsum(size) - size
    return run, place, window_hashes(prefix_sums(np.frombuffer(b"".join(contents), dtype=np.uint8)), start[run] + place)


def chunks(size: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of contents of ``most`` bytes or one."""
    i, total = 0, 0
    for j, s in enumerate(size.tolist()):
        if j > i and total + s > most:
            yield i, j
            i, total = j, 0
        total += s
    if len(size):
        yield i, len(size)


def spans(n: int, starts: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs of bytes that windows at ``starts`` cover in a text of ``n`` bytes."""
    starts = np.sort(starts)
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    new = np.concatenate(([True], starts[1:] > starts[:-1] + LENGTH))
    first = np.flatnonzero(new)
    return np.stack((starts[first], starts[np.concatenate((first[1:] - 1, [len(starts) - 1]))] + LENGTH), axis=1)


def cut(docs: DataFrame, verdicts: Verdicts, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row and, with ``texts``, ``spans`` and ``kept``, bytes."""
    source = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    schema = f"__id {source.schema[0].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<long>, kept binary" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = byte_list(b.column(1))
            starts: dict[int, list[np.ndarray]] = {}
            for pieces, place in pieces_of(raw):
                r = runs_of(pieces)
                if not len(r.suffix):
                    continue
                hit = np.sort(verdicts.repeated(r))
                edge = np.cumsum([0, *map(len, pieces)])
                at = np.searchsorted(hit, edge)
                for k in np.flatnonzero(np.diff(at)):
                    i, offset = place[k]
                    starts.setdefault(i, []).append(hit[at[k] : at[k + 1]] - edge[k] + offset)
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for i, t in enumerate(raw):
                found = spans(len(t), np.concatenate(starts[i])) if i in starts else np.zeros((0, 2), dtype=np.int64)
                kept, at = [], 0
                for s, e in found.tolist():
                    kept.append(t[at:s])
                    at = e
                kept = b"".join([*kept, t[at:]])
                out["n_bytes"].append(len(t))
                out["n_removed"].append(len(t) - len(kept))
                out["n_spans"].append(len(found))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["spans"].append(found.ravel())
                    out["kept"].append(kept)
            kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.int64()), "kept": pa.binary()}
            names = [c for c in out if texts or c not in ("spans", "kept")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[c], type=kinds.get(c, pa.int64())) for c in names)], names=["__id", *names])

    return source.mapInArrow(run, schema).withColumnRenamed("__id", key)


def family_of(batches: list[DataFrame], text: str = "text", path: str | None = None, hot: int = HOT) -> Family:
    spark = batches[0].sparkSession
    path = mounted(path or shared_path(spark, "suffixes"))
    os.makedirs(path, exist_ok=True)
    out = Family(path, max(64, 8 * sum(b.rdd.getNumPartitions() for b in batches)), hot)
    for b in batches:
        out.insert(b, text)
    return out
