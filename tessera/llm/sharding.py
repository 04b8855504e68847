"""Minimax contiguous partition of documents into shards, in DataFrame functions alone.

Documents with equal texts form an atomic group. Groups are ordered by the SHA-256 of their text, and the shards are
contiguous runs of groups. The smallest feasible capacity is found by binary search, and each capacity is
checked greedily: a shard takes groups until the next would exceed it. The greedy check needs the largest group end
at or below a position; the driver answers that from sums over digest prefixes (256 children a
node) and asks Spark for the children of just those nodes in which the answer still matters, so it holds
a bounded number of sums however many groups there are. With the capacity known, each cut goes to the group end nearest to an
even share among those cuts that keep every shard within the capacity.

A cut is a digest prefix, so a document's shard is a comparison of its digest with 15 literals: no join on
the text, and a group with a third of all rows stays evenly dealt. Slots are row numbers in two levels, by (shard, hash bucket).

Defined cases: a null text has no bytes, size 1, and groups with empty texts; repeated rows are rows of one group; fewer groups
than shards leave shards empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

ROWS_PER_BUCKET = 4096


class Prefixes:
    """Sums of group sizes by digest prefix, refined on demand. ``groups(key, size)``, one row a group."""

    def __init__(self, groups: DataFrame, digits: int = 2):
        self.groups, self.digits = groups, digits
        self.nodes = self._children([""])
        self._lay()

    def _children(self, prefixes: list[str]) -> list[tuple[str, int, int]]:
        found, by_length = [], {}
        for p in prefixes:
            by_length.setdefault(len(p), []).append(p)
        for n, some in by_length.items():
            own = self.groups if n == 0 else self.groups.where(F.substring("key", 1, n).isin(some))
            rows = own.groupBy(F.substring("key", 1, n + self.digits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
            found += [(r["p"], r["s"], r["n"]) for r in rows]
        return sorted(found)

    def _lay(self) -> None:
        self.starts, at = [], 0
        for _, s, _ in self.nodes:
            self.starts.append(at)
            at += s
        self.total = at

    def refine(self, wanted: set[str]) -> None:
        rest = [x for x in self.nodes if x[0] not in wanted]
        self.nodes = sorted(rest + self._children(sorted(wanted)))
        self._lay()

    def around(self, x: int) -> tuple[int, int, str | None]:
        """Known group edges at or around position ``x``, and the node to refine if there may be one in between."""
        if x <= 0 or x >= self.total:
            edge = 0 if x <= 0 else self.total
            return edge, edge, None
        i = bisect_right(self.starts, x) - 1
        if self.starts[i] == x:
            return x, x, None
        prefix, size, n = self.nodes[i]
        return self.starts[i], self.starts[i] + size, prefix if n > 1 else None

    def open_nodes(self, low: int, high: int) -> set[str]:
        i = max(0, bisect_right(self.starts, low) - 1)
        out = set()
        while i < len(self.nodes) and self.starts[i] < high:
            if self.nodes[i][2] > 1 and self.starts[i] + self.nodes[i][1] > low:
                out.add(self.nodes[i][0])
            i += 1
        return out

    def prefix_at(self, edge: int) -> str | None:
        i = bisect_right(self.starts, edge) - 1
        return self.nodes[i][0] if edge < self.total else None


def walk(p: Prefixes, capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Greedy cuts; where a node is open, at its start, or hopefully at the very position."""
    at, out = 0, []
    for _ in range(shards):
        low, _, unknown = p.around(at + capacity)
        at = max(at, at + capacity if unknown and hopeful else low)
        out.append(min(at, p.total))
    return out


def least(p: Prefixes, shards: int, hopeful: bool) -> int:
    low, high = -(-p.total // shards), p.total
    while low < high:
        mid = (low + high) // 2
        if walk(p, mid, shards, hopeful)[-1] >= p.total:
            high = mid
        else:
            low = mid + 1
    return low


def capacity(p: Prefixes, shards: int) -> int:
    """The smallest feasible capacity."""
    while True:
        bound, sure = least(p, shards, True), least(p, shards, False)
        wanted: set[str] = set()
        if bound < sure:
            for low, high in zip(walk(p, bound, shards, False), walk(p, sure, shards, True)):
                wanted |= p.open_nodes(low, high + 1)
        if not wanted:
            return sure
        p.refine(wanted)


def cuts(p: Prefixes, shards: int) -> list[str | None]:
    """For each of the shards but the first, the digest prefix with which it starts; None after the last group."""
    most = capacity(p, shards)
    while True:
        wanted: set[str] = set()
        lowest = [p.total] * (shards + 1)
        for j in range(shards - 1, 0, -1):
            _, edge, unknown = p.around(lowest[j + 1] - most)
            wanted |= {unknown} - {None}
            lowest[j] = max(0, edge)
        at, edges = 0, []
        for j in range(1, shards):
            below, above, unknown = p.around(j * p.total // shards)
            wanted |= {unknown} - {None}
            even = below if j * p.total // shards - below <= above - j * p.total // shards else above
            limit, _, unknown = p.around(at + most)
            wanted |= {unknown} - {None}
            at = max(at, min(max(even, lowest[j]), limit))
            edges.append(at)
        if not wanted:
            return [p.prefix_at(e) for e in edges]
        p.refine(wanted)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = keep(docs.select(F.col(f"`{key}`").alias("id"), (F.octet_length(content) + F.lit(1)).cast("long").alias("size"), F.crc32(content).alias("crc"), F.sha2(content, 256).alias("key")), "shard-rows")
    groups = keep(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups")
    n = groups.agg(F.sum("n")).first()[0] or 0
    p = Prefixes(groups)
    number = F.lit(0)
    if p.total:
        for prefix in cuts(p, shards):
            if prefix is not None:
                number = number + (F.col("key") >= F.lit(prefix)).cast("int")
    buckets = max(16, -(-n // (shards * ROWS_PER_BUCKET)))
    dealt = rows.withColumn("shard", number).withColumn("b", F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("c")).select("shard", "b", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "b").orderBy("id", "key")
    return (
        dealt.withColumn("i", F.row_number().over(inside))
        .join(offsets, ["shard", "b"])
        .select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("i") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
