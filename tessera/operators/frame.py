"""Table verbs with the semantics of a small dataframe library: joins, groups, reshaping, order.

Row order is a declared column where a verb depends on it (first, last, dedupe, slice): a distributed table has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import keep


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# projection


def drop_rows(df: DataFrame, key: str, labels: Sequence) -> DataFrame:
    return df.where(~F.coalesce(F.col(key).isin(*labels), F.lit(False)))


def mask(df: DataFrame, condition: Column) -> DataFrame:
    """Two-valued: NULL is false."""
    return df.where(F.coalesce(condition, F.lit(False)))


def complement(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def derive(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """All read the original row."""
    return df.withColumns(columns)


def assign(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Later ones see earlier ones."""
    for name, c in columns.items():
        df = df.withColumn(name, c)
    return df


def is_in(c: Column, values: Sequence) -> Column:
    """Membership in which a null can be a member."""
    some = [v for v in values if v is not None]
    found = F.coalesce(c.isin(*some), F.lit(False)) if some else F.lit(False)
    return found | c.isNull() if len(some) < len(values) else found


def missing(df: DataFrame) -> DataFrame:
    """A frame of booleans: NULL or NaN."""
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([(F.col(c).isNull() | F.isnan(c) if c in real else F.col(c).isNull()).alias(c) for c in df.columns])


def fill(df: DataFrame, value) -> DataFrame:
    """``value`` in place of what is missing in columns that can hold it."""
    kinds = {str: T.StringType, bool: T.BooleanType}.get(type(value), T.NumericType)
    return df.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(value).cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, kinds)})


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """0, 1, ... in the given order. Ranges of the order are numbered apart and then shifted, so no task holds all rows."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parts = keep(parts)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    ahead = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    return parts.join(F.broadcast(ahead), "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__ahead")).drop("__part", "__at", "__first", "__ahead")


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` up to and with each row of the order, in ranges that are summed apart and then shifted."""
    parts = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part").agg(F.sum(value).alias("__n"))
    ahead = sums.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(ahead), "__part").withColumn(name, inside + F.col("__ahead")).drop("__part", "__ahead")


# joins


def join(left: DataFrame, right: DataFrame, on: str | tuple[str, str], how: str = "inner", suffix: str = "_r") -> DataFrame:
    """Nulls match nulls; the right key goes if it has the left one's name, and comes out null for rows of the right alone; other clashes get a suffix."""
    a, b = (on, on) if isinstance(on, str) else on
    names = {c: (c + suffix if c in left.columns and c != b else c) for c in right.columns}
    renamed = right.select([F.col(f"`{c}`").alias("__key" if c == b else n) for c, n in names.items()])
    out = left.join(renamed, F.col(f"`{a}`").eqNullSafe(F.col("__key")), how)
    if how in ("left_semi", "left_anti"):
        return out
    if a == b:
        return out.drop("__key")
    return out.withColumnRenamed("__key", b + suffix if b in left.columns else b)


def semi(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return join(left, right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return join(left, right, on, "left_anti")


def zip_rows(a: DataFrame, a_order: Sequence[str], b: DataFrame, b_order: Sequence[str]) -> DataFrame:
    """Side by side by position, as long as the shorter."""
    return with_row_id(a, a_order, "__row").join(with_row_id(b, b_order, "__row"), "__row").drop("__row")


# groups


def total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def sample_std(c: str | Column) -> Column:
    """0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def sample_variance(c: str | Column) -> Column:
    return F.coalesce(F.var_samp(c), F.lit(0.0))


def first_of(c: str, order: str) -> Column:
    """Value of the first row, null or not."""
    return F.min_by(F.struct(F.col(c)), F.col(order))[c]


def last_of(c: str, order: str) -> Column:
    return F.max_by(F.struct(F.col(c)), F.col(order))[c]


def distinct_values(c: str) -> Column:
    """Null counts as a value."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


OPS = {"sum": total, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": sample_std, "variance": sample_variance, "count": F.count}


def aggregate(df: DataFrame, keys: Sequence[str], ops: dict[str, str]) -> DataFrame:
    """One operation per column, which keeps its name."""
    return df.groupBy(*keys).agg(*[OPS[o](c).alias(c) for c, o in ops.items()])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count mean std min 25% 50% 75% max by column, in one pass but for the quantiles, whose values are counted and summed in ranges."""
    from .learning import quantiles

    columns = list(columns or numeric_columns(df))
    one = df.agg(*[F.struct(F.count(c).cast("double").alias("count"), F.avg(c).alias("mean"), sample_std(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(f"s{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        one = one.crossJoin(quantiles(df, c, (0.25, 0.5, 0.75), f"q{i}"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for i, c in enumerate(columns)])).alias("e")).select("e.column", "e.s.*", "e.q")
    return rows.select("column", "count", "mean", "std", "min", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))], "max")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson over the pairs that are complete; 1 on the diagonal."""
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a))
    one = df.agg(*[(F.lit(1.0) if a == b else F.corr(both(a, b), both(b, a))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


# shape


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all by name, with the first one's columns."""
    names = frames[0].columns
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True).select(*names), frames)


def pivot(df: DataFrame, keys: Sequence[str], values: Sequence[str], op: str = "mean", headers: Sequence | None = None) -> DataFrame:
    """The last key becomes columns; with several values they are called value_header."""
    *rest, last = keys
    grouped = df.groupBy(*rest).pivot(last, list(headers)) if headers is not None else df.groupBy(*rest).pivot(last)
    out = grouped.agg(*[OPS[op](v).alias(v) for v in values])
    if len(values) > 1:
        for c in out.columns[len(rest) :]:
            header, value = next((c[: -len(v) - 1], v) for v in values if c.endswith("_" + v))
            out = out.withColumnRenamed(c, f"{value}_{header}")
    return out


def fold(df: DataFrame, columns: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    rest = [c for c in df.columns if c not in columns]
    return df.unpivot(rest, list(columns), key, value)


def transpose(df: DataFrame, row_id: str) -> DataFrame:
    """Columns become rows; a small frame's verb, as its rows become columns."""
    columns = [c for c in df.columns if c != row_id]
    return df.unpivot([row_id], columns, "column", "value").groupBy("column").pivot(row_id).agg(F.first("value"))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order: an aggregation, so that a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(best).select(*[F.col("__first")[c].alias(c) if c in rest else F.col(c) for c in df.columns])


def ordered(df: DataFrame, *keys: tuple[str, str] | str) -> DataFrame:
    """Mixed directions, nulls last either way."""
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[F.col(k).asc_nulls_last() if way == "asc" else F.col(k).desc_nulls_last() for k, way in pairs])


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def rows_between(df: DataFrame, order: Sequence[str], start: int, end: int | None = None) -> DataFrame:
    """Rows start to end of the order; negative counts from the end."""
    numbered = with_row_id(df, order, "__row")
    n = df.count() if start < 0 or (end or 0) < 0 else 0
    start, end = start + n if start < 0 else start, end + n if end is not None and end < 0 else end
    kept = numbered.where(F.col("__row") >= start)
    return (kept if end is None else kept.where(F.col("__row") < end)).drop("__row")


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n rows, the same for the same seed, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
