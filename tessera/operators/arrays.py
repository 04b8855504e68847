"""Arrays and rasters in long form: (i, j, v). Stencils are sums over shifted cells, not self joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_axis(a: DataFrame, axis: str, of: Callable[[Column], Column]) -> DataFrame:
    return a.groupBy(axis).agg(of(F.col("v")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two long matrices: joined on the inner index, partial sums before the shuffle."""
    left = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), "i").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))


def norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("trace"))


def stack(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    return a.unionByName(b.withColumn("i", F.col("i") + rows))


def solve(a: DataFrame, b: DataFrame, n: int):
    """A dense system of a size that the caller states: n * n numbers come to the driver."""
    import numpy as np

    if n > 4000:
        raise ValueError("too large to solve on the driver")
    m, y = np.zeros((n, n)), np.zeros(n)
    for r in a.collect():
        m[r["i"], r["j"]] = r["v"]
    for r in b.collect():
        y[r["i"]] = r["v"]
    return np.linalg.solve(m, y)


NEAR = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]


def neighbourhood(a: DataFrame) -> DataFrame:
    """``i, j, n``: of each cell the map (3 * di + dj -> value) of its 3 x 3 surroundings. Every cell sends its value to nine, then one aggregation."""
    sent = a.select(F.explode(F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.lit(-3 * di - dj).alias("k"), F.col("v").alias("v"), F.lit(di == dj == 0).alias("own")) for di, dj in NEAR])).alias("e")).select("e.*")
    return sent.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("n"), F.max("own").alias("own")).where("own").drop("own")


def at(di: int, dj: int) -> Column:
    return F.try_element_at("n", F.lit(3 * di + dj))


def horn(size: float) -> tuple[Column, Column]:
    """Gradients to the right and down by Horn's weights; null at the edge."""
    dx = ((at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))) / (8 * size)
    dy = ((at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))) / (8 * size)
    return dx, dy


def terrain(a: DataFrame, size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Slope and aspect in degrees, hillshade, ruggedness (TRI), position (TPI) and roughness, from one neighbourhood."""
    import math

    dx, dy = horn(size)
    around = [at(di, dj) for di, dj in NEAR if di or dj]
    slope = F.atan(F.sqrt(dx * dx + dy * dy))
    aspect = F.pmod(F.lit(450.0) - F.degrees(F.atan2(dy, -dx)), F.lit(360.0))
    z, az = math.radians(90 - altitude), math.radians(360 - azimuth + 90)
    shade = F.greatest(F.lit(0.0), 255 * (math.cos(z) * F.cos(slope) + math.sin(z) * F.sin(slope) * F.cos(az - F.atan2(dy, -dx))))
    mean = sum(around[1:], around[0]) / 8
    tri = F.sqrt(sum(((x - at(0, 0)) ** 2 for x in around), F.lit(0.0)))
    values = [*around, at(0, 0)]
    return neighbourhood(a).select("i", "j", F.degrees(slope).alias("slope"), aspect.alias("aspect"), shade.alias("shade"), tri.alias("tri"), (at(0, 0) - mean).alias("tpi"), (F.greatest(*values) - F.least(*values)).alias("roughness"))


def flow_direction(a: DataFrame) -> DataFrame:
    """The neighbour with the steepest way down, as di, dj; null in a sink."""
    drops = [F.struct(((at(0, 0) - at(di, dj)) / (2**0.5 if di and dj else 1.0)).alias("drop"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in NEAR if di or dj]
    best = F.array_max(F.filter(F.array(*drops), lambda d: d["drop"] > 0))
    return neighbourhood(a).select("i", "j", best["di"].alias("di"), best["dj"].alias("dj"), best["drop"].alias("drop"))


def accumulation(directions: DataFrame) -> DataFrame:
    """Cells that drain through each cell, itself included. Paths double in each round: log of the longest path many rounds, each cut by a shared table."""
    from ..plans.shared import keep

    down = directions.where("di is not null").select("i", "j", (F.col("i") + F.col("di")).alias("ti"), (F.col("j") + F.col("dj")).alias("tj"))
    # reach: each cell with every cell within 2^k - 1 steps below; counted, not kept, by doubling sums
    total = directions.select("i", "j", F.lit(1).cast("long").alias("n"))
    jump = keep(down)
    while True:
        sent = total.join(jump, ["i", "j"]).select(F.col("ti").alias("i"), F.col("tj").alias("j"), "n")
        total = keep(total.unionByName(sent).groupBy("i", "j").agg(F.sum("n").alias("n")))
        nxt = jump.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("ti").alias("ui"), F.col("tj").alias("uj"))
        jump = keep(jump.join(nxt, ["ti", "tj"]).select("i", "j", F.col("ui").alias("ti"), F.col("uj").alias("tj")))
        if jump.isEmpty():
            return total


def contour_crossings(a: DataFrame, level: float) -> DataFrame:
    """Where a level crosses the edges between neighbouring cells, by linear interpolation."""
    rows = neighbourhood(a)
    out = []
    for name, di, dj in (("down", 1, 0), ("right", 0, 1)):
        p, q = at(0, 0), at(di, dj)
        t = (F.lit(level) - p) / (q - p)
        out.append(F.when((p < level) != (q < level), F.struct(F.lit(name).alias("edge"), (F.col("i") + t * di).alias("y"), (F.col("j") + t * dj).alias("x"))))
    return rows.select("i", "j", F.explode(F.array_compact(F.array(*out))).alias("c")).select("i", "j", "c.*")


def fill_sinks(a: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Each inner cell raised to the lowest level from which water gets to the edge. Levels start at infinity and fall to ``max(v, least neighbour)`` until nothing changes; each round is one neighbourhood aggregation into a shared table."""
    from ..plans.shared import keep

    around = [at(di, dj) for di, dj in NEAR if di or dj]
    edge = F.lit(False)
    for c in around:
        edge |= c.isNull()
    start = keep(neighbourhood(a).select("i", "j", at(0, 0).alias("v"), edge.alias("edge")))
    level = keep(start.select("i", "j", F.when(F.col("edge"), F.col("v")).otherwise(F.lit(float("inf"))).alias("v")))
    for _ in range(rounds):
        low = neighbourhood(level).select("i", "j", F.least(*around).alias("low"), at(0, 0).alias("now"))
        new = keep(low.join(start, ["i", "j"]).select("i", "j", F.when(F.col("edge"), F.col("v")).otherwise(F.least("now", F.greatest("v", "low"))).alias("v"), "now"))
        if new.where("v <> now").isEmpty():
            return level
        level = new.select("i", "j", "v")
    return level


def watershed(directions: DataFrame) -> DataFrame:
    """``i, j, oi, oj``: the outlet that each cell drains to, by doubling jumps."""
    from ..plans.shared import keep

    jump = keep(directions.select("i", "j", (F.col("i") + F.coalesce("di", F.lit(0))).alias("oi"), (F.col("j") + F.coalesce("dj", F.lit(0))).alias("oj")))
    while True:
        nxt = jump.select(F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("oi").alias("ui"), F.col("oj").alias("uj"))
        new = keep(jump.join(nxt, ["oi", "oj"]).select("i", "j", F.col("ui").alias("oi"), F.col("uj").alias("oj"), ((F.col("ui") != F.col("oi")) | (F.col("uj") != F.col("oj"))).alias("moved")))
        done = new.where("moved").isEmpty()
        jump = new.drop("moved")
        if done:
            return jump
