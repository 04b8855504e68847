"""Running, trailing and adjacent computations in a declared order, and state machines over events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import keep
from .frame import running_total


def by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def upto(keys: Sequence[str], order: Sequence[str]):
    return by(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def cumulative_sum(c: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """A null carries the total forward."""
    return F.sum(F.coalesce(c, F.lit(0))).over(upto(keys, order))


def difference(c: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return c - F.lag(c).over(by(keys, order))


def rolling(c: Column, width: int, of: Callable[[Column], Column], keys: Sequence[str], order: Sequence[str]) -> Column:
    """Over the last ``width`` rows, fewer at the start."""
    return of(c).over(by(keys, order).rowsBetween(-(width - 1), 0))


def fold(df: DataFrame, value: str, start, step: Callable, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """A running fold by any function of (state, value). Rows are dealt by key and sorted, and one pass carries a state per key: linear, and no group is held."""
    kind = df.schema[value].dataType.simpleString()

    def scan(frames):
        last, state = None, start
        for f in frames:
            out = []
            for k, v in zip(zip(*(f[c] for c in keys)), f[value]):
                if k != last:
                    last, state = k, start
                state = step(state, v)
                out.append(state)
            f[name] = out
            yield f

    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    ddl = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema.fields)
    return sorted_.mapInPandas(scan, f"{ddl}, `{name}` {kind}")


def with_last(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The last ``value`` that is not null up to each row. Without keys, ranges of the order are worked on apart, and each starts from what those before it end with."""
    if keys:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(upto(keys, order)))
    parts = keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    ends = parts.where(F.col(value).isNotNull()).groupBy("__part").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    every = parts.select("__part").distinct().join(ends, "__part", "left")
    ahead = every.select("__part", F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = F.last(value, ignorenulls=True).over(upto(["__part"], order))
    return parts.join(F.broadcast(ahead), "__part").withColumn(name, F.coalesce(own, "__before")).drop("__part", "__before")


def runs(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adjacent equal values as one row: first and last order value and the length."""
    w = by(keys, order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    new = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(upto(keys, order)))
    return marked.groupBy(*keys, "__run").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def average_rank(c: str, keys: Sequence[str]) -> Column:
    """Ties share the mean of their ranks, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(c)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2


def with_average_rank(df: DataFrame, c: str, name: str) -> DataFrame:
    """Ranks among all rows: distinct values are counted and summed in ranges, then joined back; a null has none."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_total(counts, ["__v"], "__n", "__upto").select("__v", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(c) == F.col("__v"), "left").drop("__v")


def rising(c: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """True on the row where a condition becomes true."""
    return c & ~F.coalesce(F.lag(c).over(by(keys, order)), F.lit(False))


def edge_counter(df: DataFrame, trigger: Column, reset: Column, keys: Sequence[str], order: Sequence[str], name: str = "count") -> DataFrame:
    """Rising edges since the last reset."""
    marked = df.withColumn("__t", F.coalesce(trigger, F.lit(False))).withColumn("__r", F.coalesce(reset, F.lit(False)))
    marked = marked.withColumn("__e", rising(F.col("__t"), keys, order)).withColumn("__p", F.sum(F.col("__r").cast("int")).over(upto(keys, order)))
    edges = F.when(~F.col("__r"), F.col("__e").cast("int")).otherwise(0)
    return marked.withColumn(name, F.sum(edges).over(upto([*keys, "__p"], order))).drop("__t", "__r", "__e", "__p")


def sample_and_hold(c: Column, trigger: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The value at the last rising edge of the trigger (a column of its own name)."""
    return F.last(F.when(trigger, c), ignorenulls=True).over(upto(keys, order))


def alarm(c: Column, on: float, off: float, keys: Sequence[str], order: Sequence[str]) -> Column:
    """On from the upper threshold, off from the lower one, else as before."""
    state = F.when(c >= on, F.lit(True)).when(c <= off, F.lit(False))
    return F.coalesce(F.last(state, ignorenulls=True).over(upto(keys, order)), F.lit(False))
