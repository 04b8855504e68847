"""Mergeable statistics as single aggregations: moments, weights, histograms, grade and tonnage, crosstabs, profiles.

Every function is a partial and final hash aggregation; none gathers a group's values but the exact quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blanks as B
from .frame import running_total


def moments(c: Column) -> Column:
    """count, zeros, mean, variance and std (sample), bias-corrected skewness and excess kurtosis; null below 1, 2, 3 and 4 values."""
    n = F.count(c).cast("double")
    skew = F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
    return F.struct(F.count(c).alias("n"), F.count_if(c == 0).alias("zeros"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.stddev_samp(c).alias("std"), skew.alias("skewness"), kurt.alias("kurtosis"))


def population_moments(c: Column) -> Column:
    """Population variance and skewness, excess kurtosis; zero spread gives 0."""
    flat = F.var_pop(c) == 0
    return F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.when(flat, 0.0).otherwise(F.skewness(c)).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis(c)).alias("kurtosis"))


def weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str, ddof: int = 1) -> DataFrame:
    """Weighted mean and variance with frequency weights. The spread is summed about the mean, which a first aggregation finds, so a tiny spread about a large mean keeps its digits."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    some = df.where(v.isNotNull() & (w > 0)).select(*keys, v.alias("__v"), w.alias("__w"))
    first = some.groupBy(*keys).agg(F.sum("__w").alias("sum_w"), F.try_divide(F.sum(F.col("__v") * F.col("__w")), F.sum("__w")).alias("mean"), F.count(F.lit(1)).alias("n"))
    back = some.crossJoin(F.broadcast(first)) if not keys else some.join(first, list(keys))
    spread = back.groupBy(*keys).agg(F.first("n").alias("n"), F.first("sum_w").alias("sum_w"), F.first("mean").alias("mean"), F.sum(F.col("__w") * (F.col("__v") - F.col("mean")) ** 2).alias("__ss"))
    return spread.withColumn("variance", F.when(F.col("sum_w") - ddof > 0, F.col("__ss") / (F.col("sum_w") - ddof))).drop("__ss")


def weighted_quantiles(df: DataFrame, value: str, weight: str, points: Sequence[float]) -> DataFrame:
    """Quantiles at mid-weight positions, linear between them. Equal values are one, with their weights summed, before any order is made."""
    one = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(weight).cast("double").alias("w"))
    summed = running_total(one, ["v"], "w", "upto").crossJoin(F.broadcast(one.agg(F.sum("w").alias("total"))))
    p = summed.select("v", ((F.col("upto") - F.col("w") / 2) / F.col("total")).alias("p"), F.explode(F.array(*[F.lit(float(x)) for x in points])).alias("q"))
    at, of = F.struct("p", "v"), lambda c, f: f(F.when(c, F.struct("p", "v")))
    ends = p.groupBy("q").agg(of(F.col("p") <= F.col("q"), F.max).alias("a"), of(F.col("p") > F.col("q"), F.min).alias("b"), F.min(at).alias("first"), F.max(at).alias("last"))
    inside = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("q") - F.col("a.p")) / (F.col("b.p") - F.col("a.p"))
    return ends.select("q", F.when(F.col("a").isNull(), F.col("first.v")).when(F.col("b").isNull(), F.col("last.v")).otherwise(inside).alias("value"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return running_total(counts, [value], "n", "upto").crossJoin(F.broadcast(total)).select(value, (F.col("upto") / F.col("total")).alias("share"))


def bin_of(c: Column, low: float, high: float, n: int, closed: bool = False) -> Column:
    """0 .. n - 1; -1 below, n above; ``closed`` puts the upper edge into the last bin."""
    i = F.floor((c - low) / ((high - low) / n)).cast("int")
    i = F.when(c < low, -1).when(c >= high, n).otherwise(F.least(i, F.lit(n - 1)))
    return F.when(c == high, n - 1).otherwise(i) if closed else i


def histogram(df: DataFrame, value: str, low: float, high: float, n: int, weight: str | None = None, closed: bool = False) -> DataFrame:
    """Count and weight by bin, and the weight from each bin to the top."""
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).groupBy(bin_of(F.col(value), low, high, n, closed).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).cast("double").alias("weight"))
    down = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("from_top", F.sum("weight").over(down))


def equal_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """n bins of one width over the extent, the last closed."""
    e = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    width = (F.col("b") - F.col("a")) / n
    i = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("a")) / width), F.lit(n - 1))).otherwise(0)
    return df.crossJoin(F.broadcast(e)).where(F.col(value).isNotNull()).groupBy(i.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values; blanks are skipped, ties by value."""
    c = F.col(column)
    return df.where(c.isNotNull() & (c.cast("string") != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def grade_tonnage(df: DataFrame, grade: str, tonnes: str, cutoffs: Sequence[float]) -> DataFrame:
    """Tonnes and mean grade at or above each cutoff: classes are summed once, then from the top."""
    edges = sorted(cutoffs)
    g, t = F.col(grade), F.col(tonnes)
    k = sum(((g >= e).cast("int") for e in edges), F.lit(0)) - 1
    classes = df.where(g.isNotNull() & (t > 0) & (g >= edges[0])).groupBy(k.alias("k")).agg(F.sum(t).alias("t"), F.sum(g * t).alias("gt"))
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("k"), F.element_at(F.array(*map(F.lit, edges)), (F.col("id") + 1).cast("int")).alias("cutoff"))
    down = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = every.join(classes, "k", "left").select("cutoff", F.sum(F.coalesce("t", F.lit(0.0))).over(down).alias("tonnes"), F.sum(F.coalesce("gt", F.lit(0.0))).over(down).alias("metal"))
    return sums.select("cutoff", "tonnes", F.try_divide("metal", "tonnes").alias("grade"))


def swath(df: DataFrame, coordinates: Sequence[str], direction: Sequence[float], origin: float, width: float, value: str, weight: str | None = None) -> DataFrame:
    """Means in slices across a direction."""
    along = sum((F.col(c) * d for c, d in zip(coordinates, direction)), F.lit(0.0))
    w = F.col(weight) if weight else F.lit(1.0)
    ok = F.col(value).isNotNull()
    return df.groupBy(F.floor((along - origin) / width).cast("long").alias("slice")).agg(F.count(value).alias("n"), F.try_divide(F.sum(F.when(ok, F.col(value) * w)), F.sum(F.when(ok, w))).alias("mean"))


def crosstab(df: DataFrame, key: str, value: str, edges: Sequence[float], weight: str) -> DataFrame:
    """Weight, metal and count by group and grade class; a blank grade has the last class, a blank key is a dash."""
    v = F.col(value)
    k = F.when(v.isNull(), len(edges) + 1).otherwise(sum(((v >= e).cast("int") for e in edges), F.lit(0)))
    name = F.coalesce(B.blank_text(F.col(key).cast("string")), F.lit("—"))
    return df.groupBy(name.alias("key"), k.cast("int").alias("class")).agg(F.sum(weight).alias("weight"), F.sum(F.col(weight) * v).alias("metal"), F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, x: str, y: str, nx: float, ny: float) -> DataFrame:
    """Counts on a grid of cells of size nx by ny."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(F.col(x) / nx).cast("long").alias("i"), F.floor(F.col(y) / ny).cast("long").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def binned(df: DataFrame, by: str, width: float, aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(((F.floor(F.col(by) / width) + 0.5) * width).alias("center")).agg(*[a.alias(n) for n, a in aggregates.items()])


def from_spec(spec: dict[str, dict]) -> list[Column]:
    """Columns of ``{name: {"op": .., "col": .., "weight": ..}}``; all are found in one pass."""
    out = []
    for name, s in spec.items():
        c = F.col(s["col"]) if "col" in s else F.lit(1)
        w = F.col(s["weight"]) if "weight" in s else None
        ops = {"count": lambda: F.sum(w) if w is not None else F.count(c), "sum": lambda: F.sum(c * w) if w is not None else F.sum(c), "mean": lambda: F.try_divide(F.sum(c * w), F.sum(F.when(c.isNotNull(), w))) if w is not None else F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "cardinality": lambda: F.count_distinct(c), "quantile": lambda: F.percentile_approx(c, s.get("p", 0.5), s.get("accuracy", 10000))}
        out.append(ops[s["op"]]().alias(name))
    return out


def geometric_mean(c: Column) -> Column:
    """Null if a value is not above zero."""
    return F.when(F.min(c) > 0, F.exp(F.avg(F.ln(c))))


def harmonic_mean(c: Column) -> Column:
    return F.when(F.min(c) > 0, F.count(c) / F.sum(1 / c))


def welch_t(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """t and degrees of freedom for means of unequal variances."""
    side = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(*[f(side(g)).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    va, vb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return s.select(((F.col("m0") - F.col("m1")) / F.sqrt(va + vb)).alias("t"), ((va + vb) ** 2 / (va**2 / (F.col("n0") - 1) + vb**2 / (F.col("n1") - 1))).alias("df"))


def profile(df: DataFrame, column: str, points: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A text column read as numbers: count, nulls, bad, zeros, mean, std, population skewness, variation and nearest-rank quantiles."""
    raw = B.null_tokens(F.col(column))
    v = B.number(raw)
    n = F.count(v)
    one = df.agg(F.count(F.lit(1)).alias("count"), n.alias("n"), F.count_if(raw.isNull()).alias("nulls"), F.count_if(raw.isNotNull() & v.isNull()).alias("bad"), F.count_if(v == 0).alias("zeros"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.skewness(v).alias("skew"), F.try_divide(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.avg(v)).alias("cv"), F.min(v).alias("min"), F.max(v).alias("max"))
    # quantiles are the values up to which enough rows lie: sums over distinct values, no list of them
    counts = df.select(v.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    upto = running_total(counts, ["v"], "c", "upto").crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))
    nearest = [F.min(F.when(F.col("upto") > B.round_half_up((F.col("n") - 1) * F.lit(p)), F.col("v"))).alias(f"q{int(p * 100)}") for p in points]
    return one.crossJoin(F.broadcast(upto.agg(*nearest)))


def group_with_total(df: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """A row for each group, ``(blank)`` for no key, and one for all."""
    name = F.coalesce(B.blank_text(F.col(key).cast("string")), F.lit("(blank)"))
    v = F.col(value)
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(name.alias("key"), v.alias("v"), w.alias("w")).rollup("key").agg(F.grouping("key").alias("__all"), F.count("v").alias("n"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))).alias("wmean"))
    return rows.withColumn("key", F.when(F.col("__all") == 1, "(total)").otherwise(F.col("key"))).drop("__all")


#: What a data-quality scan looks for in text columns (fixed patterns).
QUALITY = {
    "blank": r"^\s*$",
    "leading_zero": r"^0\d+$",
    "sentinel": r"^-9{2,}(\.0+)?$",
    "thousands": r"^-?\d{1,3}(,\d{3})+(\.\d+)?$",
    "padded": r"^\s+\S|\S\s+$",
    "date_text": r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}$",
}


def quality_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, issue, n`` in one pass, issues without rows left out."""
    counts, names = [], []
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for issue, pattern in QUALITY.items():
            counts.append(F.count_if(text.rlike(pattern)))
            names.append((c, issue))
        counts.append(F.count_if(text.try_cast("double").isNull() & ~text.rlike(QUALITY["blank"])))
        names.append((c, "not_numeric"))
        counts.append(F.when((F.min(text) == F.max(text)), F.count(F.lit(1))).otherwise(0))
        names.append((c, "constant"))
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("issue"), n.cast("long").alias("n")) for (c, i), n in zip(names, counts)]).alias("all"))
    return one.select(F.explode("all").alias("e")).select("e.*").where("n > 0")


def decluster(df: DataFrame, coordinates: Sequence[str], key: str, size: float, offsets: int = 4) -> DataFrame:
    """Weights of one over the count in a cell, averaged over shifted grids, that sum to the number of samples."""
    shifted = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))))
    cells = [F.floor((F.col(c) + F.col("__o") * (size / offsets)) / size).alias(f"__c{i}") for i, c in enumerate(coordinates)]
    shifted = shifted.select(key, "__o", *cells)
    names = ["__o", *[f"__c{i}" for i in range(len(coordinates))]]
    counts = shifted.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    occupied = counts.groupBy("__o").agg(F.count(F.lit(1)).alias("__cells"))
    rows = shifted.join(counts, names).join(F.broadcast(occupied), "__o")
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    return rows.crossJoin(F.broadcast(total)).groupBy(key).agg((F.avg(1 / (F.col("__n") * F.col("__cells"))) * F.first("__total")).alias("weight"))


def variogram(df: DataFrame, key: str, coordinates: Sequence[str], value: str, lag: float, lags: int) -> DataFrame:
    """Semivariance by lag class. Pairs are formed only between neighbouring cells as wide as the longest lag, and summed where they are formed."""
    from .spatial import meet

    reach = lag * lags
    x, y = ([f"{p}{i}" for i in range(len(coordinates))] for p in "xy")
    a = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"), *[F.col(c).alias(o) for c, o in zip(coordinates, x)])
    b = a.select(F.col("k").alias("k_b"), F.col("v").alias("v_b"), *[F.col(c).alias(o) for c, o in zip(x, y)])
    h = F.sqrt(sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(x, y)), F.lit(0.0)))
    on = (F.col("k") < F.col("k_b")) & (h > 0) & (h < reach)
    pairs = meet(a, b, x, y, reach, on).select(h.alias("h"), ((F.col("v") - F.col("v_b")) * (F.col("v") - F.col("v_b"))).alias("d"))
    return pairs.groupBy(F.floor(F.col("h") / lag).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("h").alias("distance"), (F.avg("d") / 2).alias("gamma"))


def decluster_sweep(df: DataFrame, coordinates: Sequence[str], key: str, value: str, sizes: Sequence[float]) -> DataFrame:
    """The declustered mean for each cell size; the size with the least (or greatest) mean is the usual choice."""
    out = None
    for s in sizes:
        one = df.select(key, value).join(decluster(df, coordinates, key, s), key).agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("mean")).select(F.lit(float(s)).alias("size"), "mean")
        out = one if out is None else out.unionByName(one)
    return out


def fit_variogram(lags: Sequence[tuple[float, float, int]], steps: int = 60) -> tuple[float, float, float]:
    """Nugget, sill and range of a spherical model by weighted least squares: for each range of a grid the other two are linear. ``lags`` has (distance, gamma, pairs)."""
    import numpy as np

    h, g, n = (np.array(x, dtype=float) for x in zip(*lags))
    best = (math.inf, (0.0, float(g.mean()), float(h.max())))
    for reach in np.linspace(h.max() / steps, 2 * h.max(), steps):
        r = np.minimum(h / reach, 1)
        shape = 1.5 * r - 0.5 * r**3
        a = np.stack((np.ones_like(h), shape), axis=1) * np.sqrt(n)[:, None]
        nugget, sill = np.linalg.lstsq(a, g * np.sqrt(n), rcond=None)[0]
        nugget = max(nugget, 0.0)
        sill = max(sill, 0.0)
        miss = float((n * (nugget + sill * shape - g) ** 2).sum())
        best = min(best, (miss, (float(nugget), float(sill), float(reach))))
    return best[1]
