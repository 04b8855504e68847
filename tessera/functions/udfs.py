"""Where users bring code of their own: per row, per group, as an accumulator, and one row to many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rowwise(f: Callable, kind: str) -> Callable[..., Column]:
    """A function of scalars, called over Arrow batches."""

    def batch(*columns):
        return pd.Series([f(*v) for v in zip(*columns)])

    return F.pandas_udf(batch, kind, F.PandasUDFType.SCALAR)


def groupwise(f: Callable[[pd.Series], object], kind: str) -> Callable[..., Column]:
    """A function of a group's values; the group comes into one task, so prefer ``accumulate``."""
    return F.pandas_udf(lambda v: f(v), kind, F.PandasUDFType.GROUPED_AGG)


def accumulate(df: DataFrame, keys: list[str], value: str, create: Callable, push: Callable, merge: Callable, result: Callable, state: str, out: str) -> DataFrame:
    """An accumulator by its four functions: partial states per batch, merged per key. ``state`` is the DDL of the state's fields, which are plain numbers or texts."""
    import re

    names = re.findall(r"(\w+) \w+", state)
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held: dict[tuple, tuple] = {}
            for *k, v in f.itertuples(index=False):
                held[tuple(k)] = push(held.get(tuple(k), create()), v)
            yield pd.DataFrame([(*k, *s) for k, s in held.items()], columns=[*keys, *names])

    def final(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        now = create()
        for s in f[names].itertuples(index=False):
            now = merge(now, tuple(s))
        return pd.DataFrame([(*k, result(now))], columns=[*keys, "result"])

    return df.select(*keys, value).mapInPandas(partial, f"{key_ddl}, {state}").groupBy(*keys).applyInPandas(final, f"{key_ddl}, result {out}")


def expand(df: DataFrame, low: str, high: str, step: float, name: str) -> DataFrame:
    """One row to many: a row for each step of an interval."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col(high) - F.col(low)) / step).cast("int") - 1, F.lit(0))))).withColumn(name, F.col(low) + F.col(name) * step)
