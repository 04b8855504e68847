"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word shingles. For radius r every bit
position i gets a non-zero vector phi(i) of r + 1 bits, and each non-zero v of r + 1 bits gives the mask
of the positions with <phi(i), v> odd. Any r differing positions span at most r dimensions, so some v is
orthogonal to all of them: each pair within the radius agrees under that mask and collides in its table.

Each table's entries are dealt, as packed arrays, by range of the hash of their masked bits. What meets there is sorted,
and fingerprints that share a bucket are compared by counting the bits they differ in, so links are read from the
tables. A bucket gives one link from each linked fingerprint to the least of those it is connected with there, never its pairs. One of
more than ``BUCKET`` fingerprints is cut into blocks, and each pair of blocks is compared by itself. The tables' links are thinned
to forests, a bounded chunk at a time, and components come from alternating star contraction, one shared table a round.

A second fingerprint (``check``) may have to agree as well, within a radius of its own: ``deduplicated`` searches by the set of a
text's words, which near copies hardly change, within six bits, and confirms by five-word shingles within
``CONFIRMED`` bits, a cosine of 0.8.

Scale: equal fingerprints are collapsed first, with partial aggregation; a table's entry is two words; comparisons
inside a bucket grow with the square of its distinct fingerprints, links in proportion.

Defined cases: a null or empty text, or one without words, has fingerprint zero, linked like any other; fewer words than a shingle
takes give one shingle of all of them; repeated rows are members of one component; a null id is never
a component's id unless all are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, byte_list, keep, mix

SEED = 42
#: Bits of 64 that two vectors with a cosine of 0.8 differ in: 64 * arccos(0.8) / pi, rounded.
CONFIRMED = 13


@dataclass(frozen=True)
class Likeness:
    """What makes texts alike: shingles of ``words`` words (``distinct``: each counts once) within ``radius`` bits and, if ``check_words``, shingles of so many within ``check_radius``."""

    words: int = 3
    radius: int = 2
    distinct: bool = False
    check_words: int = 0
    check_radius: int = 64


#: Of near copies, five-word shingles and a similarity of 0.8: the search is wide, the check decides.
NEAR_COPIES = Likeness(words=1, radius=6, distinct=True, check_words=5, check_radius=CONFIRMED)


def vectors(radius: int, bits: int = 64) -> list[int]:
    """phi of each position: all non-zero vectors in turn if there are fewer than positions, else those with an odd number of ones, which every mask keeps half of."""
    n = (1 << (radius + 1)) - 1
    if n <= bits:
        return [1 + i % n for i in range(bits)]
    odd = [x for x in range(1, n + 1) if x.bit_count() & 1]
    return sorted(random.Random(1).sample(odd, bits)) if len(odd) > bits else [odd[i % len(odd)] for i in range(bits)]


def masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each non-zero v; a mask keeps about half of the positions."""
    phi = vectors(radius, bits)
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def shingle_hashes(raw: bytes, words: int) -> list[int]:
    from xxhash import xxh64_intdigest as xx

    found = raw.lower().split()
    n = len(found)
    if not n:
        return []
    if n <= words:
        return [xx(b" ".join(found), SEED)]
    line = b" ".join(found)
    size = [len(w) + 1 for w in found]
    end = list(accumulate(size))
    return [xx(line[e - s : f - 1], SEED) for s, e, f in zip(size, end, end[words - 1 :])]


#: A byte lane of a 64-bit word counts up to 255 shingles.
LANE = 255


def fingerprints(texts: list[bytes], words: int = 3, distinct: bool = False) -> np.ndarray:
    hashes: list[int] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        h = shingle_hashes(t, words)
        h = list(set(h)) if distinct else h
        n[i] = len(h)
        hashes += h
    out = np.zeros(len(texts), dtype=U64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h = np.array(hashes, dtype=U64)
    first = np.concatenate(([0], np.cumsum(n[some])))[:-1]
    pieces = -(-n[some] // LANE)
    piece_first = np.concatenate(([0], np.cumsum(pieces)))[:-1]
    within = np.arange(pieces.sum()) - np.repeat(piece_first, pieces)
    cut = np.repeat(first, pieces) + within * LANE
    bits = np.zeros((len(some), 64), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> U64(k)) & U64(0x0101010101010101), cut)
        bits[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_first, axis=0)
    majority = (2 * bits > n[some][:, None]).astype(U64)
    out[some] = (majority << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)
    return out


def fingerprinted(docs: DataFrame, keys: list[Column], text: str, like: Likeness) -> DataFrame:
    """``__id``, a struct of ``keys``, and ``__fp``, the fingerprint and its check as signed longs (0 without a check)."""
    source = docs.select(F.struct(*keys).alias("__id"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_list(batch.column(1))
            for i, j in blocks(texts):
                fp = fingerprints(texts[i:j], like.words, like.distinct)
                check = fingerprints(texts[i:j], like.check_words) if like.check_words else np.zeros(j - i, dtype=U64)
                both = pa.StructArray.from_arrays([pa.array(fp.view(np.int64)), pa.array(check.view(np.int64))], names=["f", "c"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), both], names=["__id", "__fp"])

    return source.mapInArrow(run, f"__id {source.schema[0].dataType.simpleString()}, __fp struct<f:long,c:long>")


#: Fingerprints of a bucket that are compared in one go; entries of a range of a table, about; entries that a task deals at a time.
BUCKET, RANGE, FLUSH = 4096, 1 << 20, 1 << 16


def connected(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places is connected with through the pairs (one, two)."""
    label = np.arange(n)
    while len(one):
        low = np.minimum(label[one], label[two])
        was = label.copy()
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        label = label[label]
        if (label == was).all():
            break
    return label


#: Linked pairs that are held before they are folded into one link a fingerprint.
FOLD = 1 << 21


def folded(fp: np.ndarray, check: np.ndarray, first: np.ndarray, size: np.ndarray, like: Likeness) -> np.ndarray:
    """For each place the least place it is connected with through pairs within the radii; the places of a bucket are ``size`` in a row from ``first`` on."""
    one, two, held = [], [], 0
    label = np.arange(len(fp))
    for d in range(1, int(size.max(initial=1))):
        long = size > d
        first, size = first[long], size[long]
        n = size - d
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        at = at[(np.bitwise_count(fp[at] ^ fp[at + d]) <= like.radius) & (np.bitwise_count(check[at] ^ check[at + d]) <= like.check_radius)]
        at = at[label[at] != label[at + d]]
        one.append(at)
        two.append(at + d)
        held += len(at)
        if held > FOLD:
            label = connected(len(fp), np.concatenate([*one, np.arange(len(fp))]), np.concatenate([*two, label]))
            one, two, held = [], [], 0
    return connected(len(fp), np.concatenate([*one, np.arange(len(fp))]), np.concatenate([*two, label]))


EDGES = "af long, ac long, bf long, bc long"
LINKS = "bucket long, block int, blob binary, " + EDGES


def link_rows(fp: np.ndarray, check: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    """A link from each place to its root."""
    far = np.flatnonzero(root != np.arange(len(fp)))
    f, c, root = fp.view(np.int64), check.view(np.int64), root[far]
    return pd.DataFrame({"bucket": np.zeros(len(far), dtype=np.int64), "block": np.zeros(len(far), dtype=np.int32), "blob": None, "af": f[root], "ac": c[root], "bf": f[far], "bc": c[far]})


#: Links that are thinned together.
CHUNK = 1 << 17


def thinned(edges: DataFrame) -> DataFrame:
    """Links of the same components, of which chunks have no more than a forest: what several tables say is said once."""

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate([pdf[["af", "ac"]].to_numpy(), pdf[["bf", "bc"]].to_numpy()])
        nodes, place = np.unique(ends, axis=0, return_inverse=True)
        one, two = place.reshape(2, -1)
        return link_rows(nodes[:, 0].copy().view(U64), nodes[:, 1].copy().view(U64), connected(len(nodes), one, two))[["af", "ac", "bf", "bc"]]

    n = edges.count()
    while n:
        parts = -(-n // CHUNK)
        chunk = F.pmod(F.xxhash64(*[c.split()[0] for c in EDGES.split(", ")]), F.lit(parts))
        edges = keep(edges.groupBy(chunk.alias("chunk")).applyInPandas(forest, EDGES), "thinned")
        was, n = n, edges.count()
        if parts == 1 or 4 * n > 3 * was:
            break
    return edges


def links(fps: DataFrame, like: Likeness) -> DataFrame:
    """``a, b``: distinct fingerprints of ``fps(__fp)`` that are connected through a bucket of some table; they span all links."""
    tables = np.array(masks(like.radius), dtype=U64)
    ranges = max(1, -(-fps.count() // RANGE))
    key_of = lambda v, fp: mix((fp & tables[v]) + U64(1 + v) * U64(0x9E3779B97F4A7C15))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            both = np.concatenate(held, axis=1)
            for v in range(len(tables)):
                part = (key_of(v, both[0]) >> U64(48)) * U64(ranges) >> U64(16)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(ranges + 1))
                for p in np.flatnonzero(np.diff(edge)):
                    blob = both[:, order[edge[p] : edge[p + 1]]].tobytes()
                    yield pa.RecordBatch.from_pydict({"v": pa.array([v], pa.int32()), "part": pa.array([p], pa.int32()), "blob": pa.array([blob], pa.binary())})

        for b in batches:
            f, c = (b.column(0).field(k).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for k in (0, 1))
            held.append(np.stack((f, c)))
            if sum(h.shape[1] for h in held) > FLUSH:
                yield from flush()
                held = []
        if held:
            yield from flush()

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = int(key[0])
        fp, check = np.concatenate([np.frombuffer(x, dtype=U64).reshape(2, -1) for x in pdf["blob"]], axis=1)
        k = key_of(v, fp)
        order = np.argsort(k)
        k, fp, check = k[order], fp[order], check[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.concatenate((first, [len(k)])))
        some = (size > 1) & (size <= BUCKET)
        rows = [link_rows(fp, check, folded(fp, check, first[some], size[some], like))]
        for i, n in zip(first[size > BUCKET].tolist(), size[size > BUCKET].tolist()):
            cut = [np.stack((fp[j : min(j + BUCKET // 2, i + n)], check[j : min(j + BUCKET // 2, i + n)])).tobytes() for j in range(i, i + n, BUCKET // 2)]
            bucket = int(k[i : i + 1].view(np.int64)[0])
            rows.append(pd.DataFrame([(bucket, j, x, 0, 0, 0, 0) for j, x in enumerate(cut)], columns=list(rows[0].columns)))
        return pd.concat(rows) if len(rows) > 1 else rows[0]

    def blocks_meet(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([np.frombuffer(x, dtype=U64).reshape(2, -1) for x in pdf["blob"]], axis=1)
        return link_rows(both[0], both[1], folded(both[0], both[1], np.array([0]), np.array([both.shape[1]]), like))

    found = keep(fps.select("__fp.f", "__fp.c").select(F.struct("f", "c").alias("s")).select("s").mapInArrow(deal, "v int, part int, blob binary").groupBy("v", "part").applyInPandas(meet, LINKS), "links")
    large = found.where("blob is not null")
    n = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # a block meets itself along with its first neighbour, so two blocks of a bucket are in one group for each pair of them
    pairs = large.join(n, "bucket").select("bucket", "blob", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("j")).where("i != j")
    more = pairs.groupBy("bucket", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).applyInPandas(blocks_meet, LINKS)
    ends = [c.split()[0] for c in EDGES.split(", ")]
    edges = thinned(found.where("blob is null").select(*ends).union(more.select(*ends)))
    return edges.select(*[F.struct(F.col(x + "f").alias("f"), F.col(x + "c").alias("c")).alias(x) for x in "ab"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the least node that can be reached.

    Alternating large-star and small-star rounds: each keeps the components and ends with stars.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    was = state(edges)
    while was[0]:
        # large star: every larger neighbour of u is joined with the least of u's neighbourhood
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and u itself are joined with the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = keep(small, "edges")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(marked: DataFrame, like: Likeness) -> DataFrame:
    """``__fp, __least``: for each fingerprint the least ``__id`` in its component."""
    fps = keep(marked.groupBy("__fp").agg(F.min("__id").alias("__least")), "distinct-fingerprints")
    found = components(links(fps.select("__fp"), like))
    roots = fps.join(found, fps["__fp"] == found["node"], "left").select("__fp", "__least", F.coalesce("root", "__fp").alias("root"))
    return roots.join(roots.groupBy("root").agg(F.min("__least").alias("__first")), "root").select("__fp", F.col("__first").alias("__least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """``key, fingerprint, component_id`` for every row of ``docs``."""
    own = F.col(f"`{key}`")
    marked = keep(fingerprinted(docs, [own.isNull().alias("none"), own.alias("key")], text, like), "fingerprints")
    return marked.join(grouped(marked, like), "__fp").select(F.col("__id.key").alias(key), F.lower(F.lpad(F.hex("__fp.f"), 16, "0")).alias("fingerprint"), F.col("__least.key").alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = NEAR_COPIES) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the least by key, then by place in the files; a null key comes last. ``docs`` is read from Parquet, or written first."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:
        docs = keep(docs, "rows")
    own = F.col(f"`{key}`")
    keys = [own.isNull().alias("none"), own.alias("key"), F.xxhash64(place[0]).alias("file"), place[1].alias("row")]
    marked = keep(fingerprinted(docs, keys, text, like), "fingerprints")
    first = grouped(marked, like).select(F.col("__least.file").alias("file"), F.col("__least.row").alias("row"))
    # all columns travel in one struct, so that none of theirs is taken for a place
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(place[0]).alias("file"), place[1].alias("row"))
    return placed.join(first, ["file", "row"], "left_semi").select("own.*")
