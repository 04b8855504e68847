"""Copies of pictures by local descriptors: crops and edits are found, not only equal files.

Corners are local maxima of the Harris response on a few scales. Around each, the intensity centroid gives an
orientation, and 128 tests between points of a pattern turned by it give a binary descriptor that brightness, contrast and
quarter turns leave alone. Descriptors meet in Hamming tables, one for each 32 bits: any two that
differ in at most three bits agree in some table; those that agree anywhere are compared in full where they meet, before a pair is
written anywhere. Each match says how one picture would lie
in the other, and pictures are linked if enough matches agree on turn, scale and shift (votes in overlapping bins).

Corners are the strongest of each tile, so a large picture has more, and a small crop of it finds its own among them.

Scale: pictures with equal pixels are one picture, by digest, before any search. The queries' tables are written in blocks of sorted
arrays that workers map; each task reads its part of the library once and takes it through every block, so matches and votes are
counted where they are found and only links are written. Pairs that share a common entry are compared ``HOT`` at a time, all of them.

Reads PGM, PPM and PNG (8 bits, not interlaced). Defined cases: a null, empty or unreadable picture, or one too small for
a patch, has no corners and no links (JPEG and palette PNG are not read); of keys that repeat, one row's pixels are shown; repeated rows belong to one picture; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shared_path
from .kneser_ney import mounted, save

#: Corners of a tile of a picture, the strongest first; scales of its pyramid; half a patch; side of a tile, in pixels.
CORNERS, SCALES, RADIUS, TILE = 40, (1.0, 0.6), 9, 96
TURNS, TESTS, TABLES = 32, 128, 4
#: Bits that a match may differ in; matches that must agree; pairs of corners that are compared at a time.
MOST_BITS, LEAST_VOTES, HOT = 14, 5, 1 << 18
#: Corners of the queries in a block of their tables; corners of the library that are looked up together.
BLOCK, CORNERS_AT_ONCE = 1 << 15, 1 << 12
#: Side of a bin of shifts, in pixels.
BIN = 12.0


def pattern() -> np.ndarray:
    """Point pairs of the tests for each turn: (turn, test, 2, 2) offsets."""
    points = np.clip(np.random.default_rng(5).normal(0, RADIUS / 2.2, (TESTS, 2, 2)), -RADIUS + 2, RADIUS - 2)
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]).transpose(2, 0, 1)
    return np.rint(np.einsum("tij,pkj->tpki", turn, points)).astype(np.int64)


PATTERN = pattern()
_DISC = np.array([(x, y) for x in range(-7, 8) for y in range(-7, 8) if x * x + y * y <= 49])


def png(raw: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", None
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", raw, at + 8)
        elif kind == b"IDAT":
            data += raw[at + 8 : at + 8 + n]
        at += 12 + n
    if not head or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), dtype=np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        above = out[y - 1].astype(np.int64) if y else np.zeros(width * channels, dtype=np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + above) & 255
        else:
            for x in range(width * channels):
                left = int(out[y, x - channels]) if x >= channels else 0
                corner = int(above[x - channels]) if x >= channels else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + int(above[x])) // 2
                else:
                    p = left + int(above[x]) - corner
                    guess = min((left, int(above[x]), corner), key=lambda v: abs(p - v))
                out[y, x] = (int(line[x]) + guess) & 255
    return out.reshape(height, width, channels)


def grey(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a picture, or None if it can't be read."""
    try:
        if raw and raw[:2] in (b"P5", b"P6"):
            m = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s", raw)
            width, height, channels = int(m[1]), int(m[2]), 1 if raw[:2] == b"P5" else 3
            pixels = np.frombuffer(raw, dtype=np.uint8, count=width * height * channels, offset=m.end()).reshape(height, width, channels)
        elif raw and raw[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = png(raw)
        else:
            return None
        if pixels is None:
            return None
        colour = pixels[..., :3].astype(np.float32)
        return colour.mean(axis=2) if pixels.shape[2] > 2 else colour[..., 0]
    except (TypeError, ValueError, IndexError, AttributeError, zlib.error, struct.error):
        return None


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1 pixels in the last two axes; edges repeat."""
    n = 2 * r + 1
    h, w = a.shape[-2:]
    total = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r), (r, r)], mode="edge")
    across = total[..., :, :w].copy()
    for k in range(1, n):
        across += total[..., :, k : k + w]
    out = across[..., :h, :].copy()
    for k in range(1, n):
        out += across[..., k : k + h, :]
    out /= n * n
    return out


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    a = box(a, 1)
    h, w = int(a.shape[-2] * scale), int(a.shape[-1] * scale)
    y, x = ((np.arange(k) + 0.5) / scale - 0.5 for k in (h, w))
    y0, x0 = np.clip(y.astype(int), 0, a.shape[-2] - 2), np.clip(x.astype(int), 0, a.shape[-1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = a[..., y0, :][..., x0] * (1 - fx) + a[..., y0, :][..., x0 + 1] * fx
    low = a[..., y0 + 1, :][..., x0] * (1 - fx) + a[..., y0 + 1, :][..., x0 + 1] * fx
    return top * (1 - fy) + low * fy


def strongest(picture: np.ndarray, x: np.ndarray, y: np.ndarray, strength: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Places of the strongest corners of each tile, so that their number grows with a picture's area; by picture and tile."""
    down, across = (n // TILE + 1 for n in shape[1:])
    tile = (picture * down + y.astype(np.int64) // TILE) * across + x.astype(np.int64) // TILE
    order = np.lexsort((x, y, -strength, tile))
    return order[np.arange(len(order)) - np.searchsorted(tile[order], tile[order]) < CORNERS]


def corners(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of equally large pictures: picture, x, y (in its own pixels), scale, turn and the descriptor's bits."""
    found: list[list[np.ndarray]] = []
    for level, scale in enumerate(SCALES):
        a = resized(stack.astype(np.float32), scale).astype(np.float32)
        n, h, w = a.shape
        edge = RADIUS + 1
        if h <= 2 * edge or w <= 2 * edge:
            continue
        gy, gx = np.zeros_like(a), np.zeros_like(a)
        gy[:, 1:-1] = a[:, 2:] - a[:, :-2]
        gx[:, :, 1:-1] = a[:, :, 2:] - a[:, :, :-2]
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[:, edge:-edge, edge:-edge]
        best = inner > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = response[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx]
                    best &= (inner > other) if (dy, dx) < (0, 0) else (inner >= other)
        picture, y, x = np.nonzero(best)
        strength = inner[picture, y, x]
        order = strongest(picture, (x + edge + 0.5) / scale, (y + edge + 0.5) / scale, strength, stack.shape)
        picture, y, x, strength = picture[order], y[order] + edge, x[order] + edge, strength[order]
        smooth = box(a, 1)
        disc = smooth[picture[:, None], y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
        angle = np.arctan2((disc * _DISC[:, 1]).sum(axis=1), (disc * _DISC[:, 0]).sum(axis=1))
        turn = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
        at = PATTERN[turn]
        one = smooth[picture[:, None], y[:, None] + at[:, :, 0, 1], x[:, None] + at[:, :, 0, 0]]
        two = smooth[picture[:, None], y[:, None] + at[:, :, 1, 1], x[:, None] + at[:, :, 1, 0]]
        bits = np.packbits(one < two, axis=1).view(">u8").astype(np.uint64)
        found.append([picture, (x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), level), turn, bits, strength])
    if not found:
        return {k: np.zeros((0, 2) if k == "bits" else 0) for k in ("picture", "x", "y", "scale", "turn", "bits")}
    picture, x, y, scale, turn, bits, strength = (np.concatenate(c) for c in zip(*found))
    order = strongest(picture, x, y, strength, stack.shape)
    return {"picture": picture[order], "x": x[order], "y": y[order], "scale": scale[order], "turn": turn[order], "bits": bits[order]}


CORNER = "array<struct<x:double,y:double,scale:int,turn:int,a:bigint,b:bigint>>"


def described(pictures: DataFrame, key: str, image: str) -> DataFrame:
    """``__id, digest, corners`` of each picture."""
    source = pictures.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{image}`").alias("__image"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = part.column(1).to_pylist()
                grown = [grey(r) for r in raw]
                shapes: dict[tuple, list[int]] = {}
                for i, g in enumerate(grown):
                    if g is not None and min(g.shape) > 2 * RADIUS + 2:
                        shapes.setdefault(g.shape, []).append(i)
                lists: list[list] = [[] for _ in raw]
                # large pictures are worked on a few at a time
                groups = [m[at : at + n] for (h, w), m in shapes.items() for n in [max(1, 64 * TILE * TILE // (h * w))] for at in range(0, len(m), n)]
                for members in groups:
                    c = corners(np.stack([grown[i] for i in members]))
                    a = c["bits"].astype(np.uint64).view(np.int64)
                    for k, i in enumerate(members):
                        own = np.flatnonzero(c["picture"] == k)
                        lists[i] = [dict(zip(("x", "y", "scale", "turn", "a", "b"), v)) for v in zip(c["x"][own].tolist(), c["y"][own].tolist(), c["scale"][own].tolist(), c["turn"][own].tolist(), a[own, 0].tolist(), a[own, 1].tolist())]
                digest = [hashlib.sha256(r).hexdigest() if g is None else hashlib.sha256(repr(g.shape).encode() + g.tobytes()).hexdigest() for r, g in zip([r or b"" for r in raw], grown)]
                kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("scale", pa.int32()), ("turn", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, type=pa.string()), pa.array(lists, type=kind)], names=["__id", "digest", "corners"])

    return source.mapInArrow(run, f"__id {source.schema[0].dataType.simpleString()}, digest string, corners {CORNER}")


def entries(pictures: DataFrame, name: str) -> DataFrame:
    """One row for each corner and table: picture, place ``i``, the corner with its descriptor and the table entry ``k``."""
    words = [F.shiftrightunsigned("c.a", 32), F.col("c.a").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("c.b", 32), F.col("c.b").bitwiseAND(0xFFFFFFFF)]
    rows = pictures.select(F.col("__id").alias(name), F.posexplode("corners").alias(f"i_{name}", "c"))
    corner = [F.col(f"c.{c}").alias(f"{c}_{name}") for c in ("x", "y", "scale", "turn", "a", "b")]
    return rows.select(name, F.col(f"i_{name}").cast("long").alias(f"i_{name}"), *corner, F.explode(F.array(*[w + F.lit(t << 32) for t, w in enumerate(words)])).alias("k"))


def index(asked: DataFrame, path: str) -> int:
    """Writes the tables of the queries' corners to ``path``, in blocks of sorted arrays; returns the number of blocks."""
    os.makedirs(path, exist_ok=True)
    count = max(1, -(-(asked.agg(F.sum(F.size("corners"))).first()[0] or 0) // BLOCK))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values(["q", "i_q", "k"])
        k = pdf["k"].to_numpy().astype(np.uint64)
        order = np.argsort(k)
        k = k[order]
        new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        own = pdf.iloc[::TABLES]
        rows, picture = np.unique(own["q"].to_numpy(), return_inverse=True)
        arrays = {"entries": k[new], "starts": np.append(new, len(k)), "corners": (order // TABLES).astype(np.int32), "rows": rows, "picture": picture.astype(np.int32), "i": own["i_q"].to_numpy()}
        arrays |= {c: own[f"{c}_q"].to_numpy() for c in ("x", "y", "scale", "turn")} | {c: own[f"{c}_q"].to_numpy().view(np.uint64) for c in ("a", "b")}
        for name, array in arrays.items():
            save(path, f"{block}-{name}", array)
        return pd.DataFrame({"block": [block]})

    entries(asked, "q").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(count))).groupBy("block").applyInPandas(run, "block long").collect()
    return count


_BLOCKS: dict[str, dict[str, np.ndarray] | None] = {}


def opened(path: str, block: int) -> dict[str, np.ndarray] | None:
    """The mapped arrays of a block, or None if no corner fell to it."""
    name = f"{path}/{block}"
    if name not in _BLOCKS:
        if not any(x.startswith(path) for x in _BLOCKS):
            _BLOCKS.clear()
        names = ("entries", "starts", "corners", "rows", "picture", "i", "x", "y", "scale", "turn", "a", "b")
        _BLOCKS[name] = {n: np.load(f"{name}-{n}.npy", mmap_mode="r") for n in names} if os.path.exists(f"{name}-entries.npy") else None
    return _BLOCKS[name]


def matches(q: dict[str, np.ndarray], lib: dict[str, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the corners of a block and of ``lib`` that share a table entry and differ in few bits, each pair once; ``most`` are compared at a time."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    a, b, low = lib["a"], lib["b"], np.uint64(0xFFFFFFFF)
    for t, word in enumerate((a >> np.uint64(32), a & low, b >> np.uint64(32), b & low)):
        key = word | np.uint64(t << 32)
        at = np.minimum(np.searchsorted(q["entries"], key), len(q["entries"]) - 1)
        own = np.flatnonzero(q["entries"][at] == key)
        first, n = q["starts"][at[own]], q["starts"][at[own] + 1] - q["starts"][at[own]]
        end = np.cumsum(n)
        for start in range(0, int(end[-1]) if len(end) else 0, most):
            stop = min(start + most, int(end[-1]))
            e = slice(np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left") + 1)
            size = np.minimum(end[e], stop) - np.maximum(end[e] - n[e], start)
            j = np.repeat(own[e], size)
            i = q["corners"][np.repeat(first[e] - (end[e] - n[e]), size) + np.arange(start, stop)]
            x, y = q["a"][i] ^ a[j], q["b"][i] ^ b[j]
            near = np.bitwise_count(x) + np.bitwise_count(y) <= MOST_BITS
            # corners that agree in several tables meet in the first of them only
            for word in (x >> np.uint64(32), x & low, y >> np.uint64(32))[:t]:
                near &= word != 0
            found.append((i[near], j[near]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def frequent(key: np.ndarray, least: int) -> np.ndarray:
    """False only for keys that occur less often than ``least`` times."""
    bits = max(10, len(key).bit_length() + 2)
    slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(slot, minlength=1 << bits)[slot] >= least


def votes(q: dict[str, np.ndarray], lib: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of matched corners, the pairs of pictures (of the block, of ``lib``) in which enough corners of a query agree on turn, scale and shift, and how many do."""
    width = len(q["rows"])
    pair = lib["picture"][j] * width + q["picture"][i]
    some = np.bincount(pair)[pair] >= LEAST_VOTES if len(pair) else np.zeros(0, dtype=bool)
    i, j, pair = i[some], j[some], pair[some]
    scales = np.array(SCALES)
    turn = (lib["turn"][j].astype(np.int64) - q["turn"][i]) % TURNS
    ratio = scales[q["scale"][i]] / scales[lib["scale"][j]]
    kinds, kind = np.unique(np.round(scales[:, None] / scales[None, :], 3), return_inverse=True)
    kind = kind.reshape(len(scales), -1)[q["scale"][i], lib["scale"][j]]
    angle = np.arange(TURNS) * (2 * np.pi / TURNS)
    cos, sin = np.cos(angle)[turn], np.sin(angle)[turn]
    x, y = q["x"][i], q["y"][i]
    dx = (lib["x"][j] - ratio * (cos * x - sin * y)) / BIN
    dy = (lib["y"][j] - ratio * (sin * x + cos * y)) / BIN
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for o, h, v in [(o, h, v) for o in (0, 2) for h in (0.0, 0.5) for v in (0.0, 0.5)]:
        # 16 bits for each shift, four for the turn
        key = (((pair * len(kinds) + kind) * 16 + (turn + o) // 4 << 16) + (np.floor(dx + h).astype(np.int64) & 0xFFFF) << 16) + (np.floor(dy + v).astype(np.int64) & 0xFFFF)
        often = np.flatnonzero(frequent(key, LEAST_VOTES))
        key, corner, own = key[often], i[often], pair[often]
        order = np.lexsort((corner, key))
        key, corner, own = key[order], corner[order], own[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (corner[1:] != corner[:-1])
        key, own = key[fresh], own[fresh]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.append(new, len(key)))
        found.append((own[new[n >= LEAST_VOTES]], n[n >= LEAST_VOTES]))
    pair, n = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-n, pair))
    pair, n = pair[order], n[order]
    new = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=bool)
    return pair[new] % width, pair[new] // width, n[new]


def links(library: DataFrame, path: str, count: int) -> DataFrame:
    """``q, l, v``: each picture of the index and each of ``library`` that are copies, and the votes. Matches stay in the task that finds them."""
    most = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            end = np.cumsum(sizes)
            values = column.flatten()
            at = 0
            while at < b.num_rows:
                # at least a picture, or as many as have some thousand corners
                stop = max(at + 1, int(np.searchsorted(end, end[at] - sizes[at] + CORNERS_AT_ONCE, "right")))
                first = int(end[at] - sizes[at])
                own = values.slice(first, int(end[stop - 1]) - first)
                lib = {c: np.asarray(own.field(c)) for c in ("x", "y", "scale", "turn")} | {c: np.asarray(own.field(c)).view(np.uint64) for c in ("a", "b")}
                lib["picture"] = np.repeat(np.arange(stop - at), sizes[at:stop])
                for block in range(count):
                    if len(own) and (q := opened(path, block)):
                        picture, l, n = votes(q, lib, *matches(q, lib, most))
                        if len(n):
                            yield pa.RecordBatch.from_arrays([pa.array(q["rows"][picture]), b.column(0).take(pa.array(l + at)), pa.array(n)], names=["q", "l", "v"])
                at = stop

    return library.select("__id", "corners").mapInArrow(run, f"q long, l {library.schema['__id'].dataType.simpleString()}, v long")


def search(queries: DataFrame, library: DataFrame, key: str = "id", image: str = "image") -> DataFrame:
    """For each row of ``queries``: its key, ``n_corners``, ``n_links`` (different pictures of ``library`` that it is a copy of), and of the best ``best_id`` (the least key with those pixels), ``best_votes`` and ``best_members`` (rows with those pixels)."""
    shown = keep(described(library, key, image), "pictures")
    asked = keep(described(queries, key, image).withColumn("__row", F.monotonically_increasing_id()), "queries")
    classes = shown.groupBy("digest").agg(F.min("__id").alias("__class"), F.count(F.lit(1)).alias("members"))
    firsts = keep(shown.join(classes.select(F.col("__class").alias("__id"), "members"), "__id").dropDuplicates(["__id"]), "firsts")
    path = mounted(shared_path(shown.sparkSession, "corners"))
    count = index(asked.select(F.col("__row").alias("__id"), "corners"), path)
    agreed = links(firsts, path, count)
    best = agreed.groupBy("q").agg(F.count(F.lit(1)).alias("n_links"), F.min_by("l", F.struct(-F.col("v"), F.col("l"))).alias("best_id"), F.max("v").alias("best_votes"))
    best = best.join(classes.select(F.col("__class").alias("best_id"), F.col("members").alias("best_members")), "best_id", "left")
    return asked.select("__id", F.col("__row").alias("q"), F.size("corners").alias("n_corners")).join(best, "q", "left").select(
        F.col("__id").alias(key), F.col("n_corners").cast("long").alias("n_corners"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_id", "best_votes", "best_members"
    )


def painted(vectors: np.ndarray) -> np.ndarray:
    """A mosaic of 12 x 12 cells of eight pixels for each vector; near vectors give near pictures."""
    i, j = np.divmod(np.arange(144), 12)
    n = vectors.shape[1]
    a, b = (i * 12 + j) % n, (i * 5 + j * 7 + 3) % n
    cells = vectors[:, a] + np.where(np.arange(144) >= n, 4.0, 0.0) * vectors[:, a] * vectors[:, b]
    cells = 128 + 400 * cells.reshape(-1, 12, 12)
    return np.clip(np.repeat(np.repeat(cells, 8, axis=1), 8, axis=2), 0, 255)


#: What is done to a picture besides less contrast, more light and a fixed grain.
EDITS = ("crop", "quarter turn", "rescale")


def edited(pictures: np.ndarray, edit: str = "crop") -> np.ndarray:
    """Less contrast, more light and a fixed grain on a crop, or on all of it turned by a quarter or rescaled."""
    if edit == "crop":
        part = pictures[:, 11:85, 7:91]
    elif edit == "quarter turn":
        part = np.rot90(pictures, axes=(1, 2))
    else:
        part = resized(pictures, 0.6)
    grain = np.random.default_rng(3).normal(0, 1.5, part.shape[1:])
    return np.clip(part * 0.8 + 30 + grain, 0, 255)


def pictures_of(vectors: DataFrame, key: str, vector: str, edit: bool = False) -> DataFrame:
    """Pictures painted from vectors, as PGM, for want of a table of pictures; a null vector gives none. ``edit`` deals the edits out by a hash of the key."""
    kind = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(len(EDITS))).alias("kind")
    source = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for v, kind in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if not v:
                        out.append(None)
                        continue
                    one = painted(np.nan_to_num(np.array([[x or 0.0 for x in v]])))
                    out.append(pgm((edited(one, EDITS[kind]) if edit else one)[0]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, type=pa.binary())], names=["id", "image"])

    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, image binary")
