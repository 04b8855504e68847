"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target of words: the total is shared by weight, a target stops at ``most_epochs`` times its
source's size, and the excess is shared again by weight until none is above (the fixed point is
``least(cap, level * weight)``, found in one pass over the sources ordered by ``cap / weight``). A
source's documents stand end to end in an order fixed by a digest of their key and are read round and round, so
a document's k-th reading starts at a known cumulative demand. The weight schedule of its source,
a piecewise linear density over training time, is integrated, and the inverse of that integral turns the
demand into the position in [0, 1] at which the document is read. Readings are range-sorted by position.

Scale: prefix sums run in two levels, over (source, digest bucket) and inside each bucket, so a source with a third of
all rows spreads over as many tasks as it has buckets. Only one row per source meets in one task.

Defined cases: a null or empty text has size 0, is never taken and has no position; null sources are a source
of their own, last in order; a null key sorts first; rows that repeat are separate rows; an
empty table gives an empty result. Names in the input stay as they are; what is added starts with ``__mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Words are runs of anything but these bytes.
WORDS = r"[^\x20\x09-\x0D]+"
#: Density knots (time, height) by weight: light sources fade, heavy ones come up; each has integral 1.
SCHEDULES: dict[int, tuple[tuple[float, float], ...]] = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (1.0, 1.5)),
}
ROWS_PER_BUCKET = 4096
#: Sources whose few numbers are broadcast; with more of them the documents are joined by a shuffle.
MOST_BROADCAST = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("long")


def inverse_integral(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the density through ``knots`` reaches the share ``x``."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, out, done = sum(areas), None, 0.0
    for k, ((t0, h0), (t1, h1)) in enumerate(zip(knots, knots[1:])):
        rest = x * F.lit(total) - F.lit(done)
        slope = (h1 - h0) / (t1 - t0)
        if slope == 0:
            t = F.lit(t0) + rest / F.lit(h0) if h0 else F.lit(t0)
        else:
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(h0 * h0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(h0)) / F.lit(slope)
        t = F.least(F.greatest(t, F.lit(t0)), F.lit(t1))
        done += areas[k]
        out = F.when(x * F.lit(total) <= F.lit(done), t) if out is None else out.when(x * F.lit(total) <= F.lit(done), t)
    return out.otherwise(F.lit(knots[-1][0]))


def targets(sizes: DataFrame, weights: Sequence[int], most_epochs: int) -> DataFrame:
    """``sizes(__mix_source, __mix_source_size)`` with rank, weight and target; one row per source."""
    caps = sizes.withColumn("__mix_rank", F.row_number().over(Window.orderBy(F.col("__mix_source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__mix_rank") - 1) % len(weights) + 1).cast("int"))
    caps = caps.withColumn("__mix_weight", weight).withColumn("__cap", F.col("__mix_source_size") * most_epochs)
    order = Window.orderBy(F.col("__cap") / F.col("__mix_weight"), "__mix_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    caps = caps.withColumn("__rest", F.sum("__mix_source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
    caps = caps.withColumn("__level", F.col("__rest") / F.sum("__mix_weight").over(after))
    fits = F.col("__level") * F.col("__mix_weight") <= F.col("__cap")
    level = F.min_by(F.when(fits, F.col("__level")), F.when(fits, F.struct(F.col("__cap") / F.col("__mix_weight"), F.col("__mix_rank")))).over(everything)
    target = F.least(F.col("__cap").cast("double"), F.coalesce(level * F.col("__mix_weight"), F.col("__cap").cast("double")))
    return caps.withColumn("__mix_target", target).drop("__cap", "__rest", "__level")


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, weights: Sequence[int] = (1, 2, 3), most_epochs: int = 3, schedules: dict[int, Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """``docs`` with ``__mix_size, __mix_source_size, __mix_target, __mix_taken, __mix_positions``.

    ``size`` defaults to the number of words of column ``text``. ``__mix_positions`` has one position for each reading
    of the document, the first reading first; the last reading that a source is allowed may be cut short by its target.
    """
    size = word_count("text") if size is None else size
    sized = docs.withColumn("__mix_size", size.cast("long")).withColumn("__mix_order", F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")))
    sized = sized.withColumn("__mix_source", F.col(f"`{source}`"))
    total = keep(sized.groupBy("__mix_source").agg(F.sum("__mix_size").alias("__mix_source_size"), F.count(F.lit(1)).alias("__n")), "sources")
    sources, rows = total.agg(F.count(F.lit(1)), F.coalesce(F.max("__n"), F.lit(0))).first()
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < rows and digits < 8:
        digits += 1
    by_source = targets(total.drop("__n"), weights, most_epochs)
    if sources <= MOST_BROADCAST:
        by_source = F.broadcast(by_source)
    bucket = F.substring("__mix_order", 1, max(digits, 2))
    sized = sized.withColumn("__mix_bucket", bucket)
    same = lambda a, b: a["__mix_source"].eqNullSafe(b["__mix_source"])
    ranked = sized.join(by_source, same(sized, by_source), "left").drop(by_source["__mix_source"])
    parts = sized.groupBy("__mix_source", "__mix_bucket").agg(F.sum("__mix_size").alias("__part"))
    parts = parts.join(by_source.select("__mix_source", "__mix_rank"), parts["__mix_source"].eqNullSafe(by_source["__mix_source"])).select("__mix_rank", "__mix_bucket", "__part")
    ahead = Window.partitionBy("__mix_rank").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__mix_rank", "__mix_bucket", F.coalesce(F.sum("__part").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__mix_rank", "__mix_bucket").orderBy("__mix_order", f"`{key}`", "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("__inside", F.coalesce(F.sum("__mix_size").over(inside), F.lit(0))).join(parts, ["__mix_rank", "__mix_bucket"])
    start, n, whole, target = F.col("__inside") + F.col("__ahead"), F.col("__mix_size"), F.col("__mix_source_size"), F.floor("__mix_target")
    placed = placed.withColumn("__mix_start", start)
    starts = [F.col("__mix_start") + whole * e for e in range(most_epochs)]
    taken = sum((F.least(F.greatest(target - s, F.lit(0)), n) for s in starts), F.lit(0))
    position = {w: [inverse_integral(s / F.col("__mix_target"), k) for s in starts] for w, k in schedules.items()}
    flat = [s / F.col("__mix_target") for s in starts]

    def at(e: int) -> Column:
        out = None
        for w, p in position.items():
            out = (F if out is None else out).when(F.col("__mix_weight") == w, p[e])
        return out.otherwise(flat[e]) if out is not None else flat[e]

    read = F.array(*[F.when((n > 0) & (starts[e] < target), at(e)) for e in range(most_epochs)])
    return placed.withColumn("__mix_taken", taken.cast("long")).withColumn("__mix_positions", F.filter(read, lambda p: p.isNotNull())).select(
        *[F.col(f"`{c}`") for c in docs.columns], "__mix_size", "__mix_source_size", "__mix_target", "__mix_taken", "__mix_positions", "__mix_order"
    )


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The readings of ``docs`` in training order: its columns, one row for each reading, range-sorted by position."""
    planned = plan(docs, key, source, **options).withColumn("__mix_position", F.explode("__mix_positions"))
    return planned.orderBy("__mix_position", "__mix_order").select(*[F.col(f"`{c}`") for c in docs.columns])
