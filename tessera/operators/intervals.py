"""Intervals along holes or time: as-of and interval lookups, overlap joins, re-segmentation, compositing, checks, survey traces."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frame import with_row_id

EPS = 1e-9


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """For each left row, ``values`` of the right row of its keys with the largest ``at`` at or below: one union and a running last, no pairs."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__id", F.monotonically_increasing_id())
    b = right.select(*keys, at, F.struct(*values).alias("__v")).withColumn("__side", F.lit(0))
    both = a.withColumn("__v", F.lit(None).cast(b.schema["__v"].dataType)).unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__f", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    return found.select(*left.columns, *[F.col("__f")[v].alias(v) for v in values])


def covering(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, start: str, end: str, values: Sequence[str]) -> DataFrame:
    """As-of on the start, then the end is tested: the rightmost interval that starts at or below counts."""
    r = right.withColumnRenamed(start, at)
    found = asof(left, r.select(*keys, at, end, *values), keys, at, [end, *values])
    inside = F.col(at) < F.col(end)
    return found.select(*left.columns, *[F.when(inside, F.col(v)).alias(v) for v in values])


def overlaps(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], bucket: float) -> DataFrame:
    """Pairs of a key whose intervals overlap, with the length of the overlap. Intervals are dealt to buckets of their line, so a long hole is many tasks; a pair counts in the bucket where its overlap starts."""
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - EPS) / bucket))).alias("__b")
    x = left.where(F.col(a[1]) > F.col(a[0])).select("*", buckets(*a))
    y = right.where(F.col(b[1]) > F.col(b[0])).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], buckets(*b).alias("__rb"))
    low, high = F.greatest(F.col(a[0]), F.col(f"r_{b[0]}")), F.least(F.col(a[1]), F.col(f"r_{b[1]}"))
    pairs = x.join(y, (F.col(key) == F.col(f"r_{key}")) & (F.col("__b") == F.col("__rb")) & (F.col(a[0]) < F.col(f"r_{b[1]}")) & (F.col(a[1]) > F.col(f"r_{b[0]}")))
    return pairs.where(F.floor(low / bucket) == F.col("__b")).withColumn("overlap", high - low).drop("__b", "__rb")


def segments(a: DataFrame, b: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Each key's line cut at every start and end of both tables, with the columns of the interval of either that covers a piece; pieces that none covers go, clashes get ``_2``."""
    ends = lambda t: t.select(key, F.explode(F.array(start, end)).alias("x"))
    points = ends(a).union(ends(b)).select(key, F.round("x", 9).alias("x")).distinct()
    w = Window.partitionBy(key).orderBy("x")
    pieces = points.select(key, F.col("x").alias(start), F.lead("x").over(w).alias(end)).where(F.col(end).isNotNull() & (F.col(end) - F.col(start) > EPS))
    mid = pieces.withColumn("__at", (F.col(start) + F.col(end)) / 2)
    rest_a = [c for c in a.columns if c not in (key, start, end)]
    rest_b = [c for c in b.columns if c not in (key, start, end)]
    names = {c: f"{c}_2" if c in rest_a else c for c in rest_b}
    one = covering(mid, a.select(key, F.col(start).alias("__s"), F.col(end).alias("__e"), *rest_a, F.lit(True).alias("__a")), [key], "__at", "__s", "__e", [*rest_a, "__a"])
    two = covering(one, b.select(key, F.col(start).alias("__s"), F.col(end).alias("__e"), *[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("__b")), [key], "__at", "__s", "__e", [*names.values(), "__b"])
    return two.where("__a or __b").drop("__at", "__a", "__b")


def composite(df: DataFrame, key: str, start: str, end: str, length: float, split: Sequence[str], values: Sequence[str], categories: Sequence[str] = (), weight: str | None = None, coverage: float = 0.0) -> DataFrame:
    """Windows of one length, restarted where the split values change: weighted means, the commonest category and the length that had a value."""
    w = Window.partitionBy(key).orderBy(start)
    change = F.lit(False)
    for c in split:
        change |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    gap = F.coalesce(F.col(start) - F.lag(end).over(w) > EPS, F.lit(True))
    marked = df.where(F.col(end) > F.col(start)).withColumn("__new", (change | gap).cast("int"))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "__run")
    marked = marked.withColumn("__s", F.min(start).over(run)).withColumn("__e", F.max(end).over(run))
    n = F.ceil((F.col("__e") - F.col("__s") - EPS) / length)
    first = F.floor((F.col(start) - F.col("__s") + EPS) / length)
    last = F.least(F.ceil((F.col(end) - F.col("__s") - EPS) / length), n) - 1
    rows = marked.withColumn("__w", F.explode(F.sequence(first, F.greatest(first, last))))
    low = F.col("__s") + F.col("__w") * length
    high = F.least(low + length, F.col("__e"))
    rows = rows.withColumn("__low", low).withColumn("__high", high)
    rows = rows.withColumn("__o", F.least(F.col(end), F.col("__high")) - F.greatest(F.col(start), F.col("__low"))).where(F.col("__o") > EPS)
    m = F.col("__o") * (F.col(weight) if weight else F.lit(1.0))
    keys = [key, "__run", "__w", "__low", "__high"]
    means = [F.try_divide(F.sum(F.col(v) * m), F.sum(F.when(F.col(v).isNotNull(), m))).alias(v) for v in values]
    support = [F.coalesce(F.sum(F.when(F.col(v).isNotNull(), F.col("__o"))), F.lit(0.0)).alias(f"{v}_support") for v in values]
    out = rows.groupBy(*keys).agg(F.sum("__o").alias("support"), *means, *support)
    for c in categories:
        share = rows.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.sum(m).alias("__m"))
        best = share.groupBy(*keys).agg(F.max_by(c, F.struct("__m", c)).alias(c))
        out = out.join(best, keys, "left")
    kept = out.where(F.col("support") >= coverage * (F.col("__high") - F.col("__low")) - EPS)
    return kept.drop("__run", "__w").withColumnsRenamed({"__low": start, "__high": end})


def default_length(df: DataFrame, start: str, end: str) -> float:
    """The commonest length, to a hundredth; 1 if there is none."""
    n = F.round((F.col(end) - F.col(start)), 2).alias("l")
    row = df.where(F.col(end) > F.col(start)).groupBy(n).count().orderBy(F.col("count").desc(), "l").first()
    return row["l"] if row else 1.0


def findings(df: DataFrame, key: str, start: str, end: str, deepest: str | None = None) -> DataFrame:
    """One row for each interval and check it fails: inverted, empty, missing bound, gap, overlap, past the end of the hole."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.lag(end).over(w)
    s, e = F.col(start), F.col(end)
    checks = {"missing": s.isNull() | e.isNull(), "inverted": e < s, "empty": e == s, "gap": s - before > EPS, "overlap": before - s > EPS}
    if deepest:
        checks["past_end"] = e > F.col(deepest) + EPS
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("check", found).withColumn("check", F.explode("check"))


def summary(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("holes"))


# survey traces


def stations(surveys: DataFrame, key: str, depth: str, azimuth: str, dip: str) -> DataFrame:
    """Valid stations, the last of a depth, with one at depth 0 that repeats the first attitude if there is none."""
    ok = surveys.where(F.col(depth).isNotNull() & ~F.isnan(F.col(depth).cast("double")) & (F.col(depth) >= 0) & F.col(azimuth).isNotNull() & (F.abs(dip) <= 90)).withColumn("__seq", F.monotonically_increasing_id())
    one = ok.groupBy(key, depth).agg(F.max_by(F.struct(azimuth, dip), "__seq").alias("__a")).select(key, F.col(depth).cast("double").alias(depth), "__a.*")
    first = one.groupBy(key).agg(F.min(depth).alias("__d"), F.min_by(F.struct(azimuth, dip), depth).alias("__a")).where("__d > 0").select(key, F.lit(0.0).alias(depth), "__a.*")
    return one.unionByName(first)


def traces(collars: DataFrame, surveys: DataFrame, key: str, depth: str, azimuth: str, dip: str, xyz: Sequence[str] = ("x", "y", "z"), method: str = "minimum") -> DataFrame:
    """Coordinates of each station by minimum curvature, balanced or plain tangents, and the dogleg in degrees. Dip is positive downwards."""
    rad = math.pi / 180
    s = stations(surveys, key, depth, azimuth, dip)
    a, p = F.col(azimuth) * rad, F.col(dip) * rad
    s = s.withColumns({"__tx": F.cos(p) * F.sin(a), "__ty": F.cos(p) * F.cos(a), "__tz": -F.sin(p)})
    w = Window.partitionBy(key).orderBy(depth)
    lag = lambda c: F.lag(c).over(w)
    dl = F.coalesce(F.col(depth) - lag(depth), F.lit(0.0))
    dot = sum((F.col(t) * F.coalesce(lag(t), F.col(t)) for t in ("__tx", "__ty", "__tz")), F.lit(0.0))
    theta = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))
    s = s.withColumn("__l", dl).withColumn("__th", theta)
    rf = F.when((F.col("__th") > 1e-7) & F.lit(method == "minimum"), 2 / F.col("__th") * F.tan(F.col("__th") / 2)).otherwise(1.0)
    steps = {}
    for t in ("__tx", "__ty", "__tz"):
        before = F.coalesce(lag(t), F.col(t))
        steps[t.replace("t", "d", 1)] = F.col("__l") * F.col(t) if method == "tangential" else 0.5 * F.col("__l") * (before + F.col(t)) * rf
    s = s.withColumns(steps)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({f"__s{c}": F.sum(f"__d{c}").over(run) for c in "xyz"})
    out = s.join(collars.select(key, *xyz), key)
    return out.select(key, depth, *[(F.col(c) + F.col(f"__s{c}")).alias(c) if c in "xyz" else F.col(c) for c in xyz], (F.col("__th") / rad).alias("dogleg"), F.when(F.col("__l") > 0, F.col("__th") / rad * 30 / F.col("__l")).alias("severity"))


def first_per_key(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f")).select(key, *[F.col("__f")[c].alias(c) for c in rest])


def grid_resample(df: DataFrame, axes: Sequence[str], size_from: float, size_to: float, value: str) -> DataFrame:
    """Values of cells of one pitch (indices from 0) on a grid of another, weighted by shared volume; ``coverage`` is the share of the target cell that was covered."""
    rows = df
    for a in axes:
        lo, hi = F.col(a) * size_from, (F.col(a) + 1) * size_from
        rows = rows.withColumn(f"__t_{a}", F.explode(F.sequence(F.floor(lo / size_to + EPS), F.ceil(hi / size_to - EPS) - 1)))
        t = F.col(f"__t_{a}") * size_to
        rows = rows.withColumn(f"__o_{a}", F.least(hi, t + size_to) - F.greatest(lo, t))
    volume = F.lit(1.0)
    for a in axes:
        volume *= F.col(f"__o_{a}")
    whole = size_to ** len(axes)
    return rows.groupBy(*[F.col(f"__t_{a}").alias(a) for a in axes]).agg(F.try_divide(F.sum(F.col(value) * volume), F.sum(F.when(F.col(value).isNotNull(), volume))).alias(value), (F.sum(F.when(F.col(value).isNotNull(), volume)) / whole).alias("coverage"))


def validate(collars: DataFrame, surveys: DataFrame, table: DataFrame, key: str, start: str, end: str, xyz: Sequence[str] = ("x", "y", "z"), deepest: str = "eoh", depth: str = "depth") -> tuple[DataFrame, DataFrame]:
    """Rows that can be used, with their collar, and how many were left out for which reason; nothing goes silently. The first collar of a hole counts."""
    numbered = collars.withColumn("__seq", F.monotonically_increasing_id())
    bad = F.lit(False)
    for c in xyz:
        bad |= F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    first = first_per_key(numbered, key, ["__seq"]).withColumn("__bad", bad)
    duplicates = collars.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("n")).select(F.lit("dup-collar").alias("check"), "n")
    bad_collars = first.where("__bad").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad-collar").alias("check"), "n")
    orphan = lambda t, name: t.join(first, key, "left_anti").agg(F.count_distinct(key).alias("n")).select(F.lit(name).alias("check"), "n")
    broken = table.where(~F.coalesce(F.col(end) > F.col(start), F.lit(False))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad-interval").alias("check"), "n")
    past = lambda t, c, name: t.join(first.select(key, deepest), key).where(F.col(c) > F.col(deepest) + EPS).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    counts = duplicates
    for part in (bad_collars, orphan(surveys, "orphan-survey"), orphan(table, "orphan-interval"), broken, past(surveys, depth, "survey-past-eoh"), past(table, end, "interval-past-eoh")):
        counts = counts.unionByName(part)
    usable = table.where(F.col(end) > F.col(start)).join(first.where("not __bad").drop("__bad", "__seq"), key)
    return usable, counts.where("n > 0")


def axis_geometry(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Origin, pitch and count of a regular axis: the commonest gap between neighbouring distinct coordinates."""
    points = df.select(F.round(column, digits).alias("x")).where(F.col("x").isNotNull()).distinct()
    placed = with_row_id(points, ["x"], "i")
    before = placed.select((F.col("i") + 1).alias("i"), F.col("x").alias("b"))
    gaps = placed.join(before, "i").select(F.round(F.col("x") - F.col("b"), digits).alias("g"))
    pitch = gaps.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("g", F.struct(-F.col("n"), "g")).alias("pitch"))
    ends = points.agg(F.min("x").alias("origin"), F.max("x").alias("last"))
    return ends.crossJoin(F.broadcast(pitch)).select("origin", "pitch", (F.round((F.col("last") - F.col("origin")) / F.col("pitch")) + 1).cast("long").alias("count"))
