"""Clocked operators over streams: windowed aggregates with late data, and state by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import folder


def windowed(events: DataFrame, time: str, width: str, late: str, keys: list[str], *aggregates) -> DataFrame:
    """Tumbling windows; what is later than ``late`` is dropped. The same plan runs on a table and on a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[a_name for a_name in _names(aggregates)])


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2] for a in aggregates]


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggregates) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *_names(aggregates))


def stateful(events: DataFrame, key: str, step, start: tuple, state: str, out: str, order: list[str] | None = None) -> DataFrame:
    """``step(state, row) -> (state, output or None)`` over the rows of each key: batch by batch and, in a batch, by ``order`` (else as they come)."""

    def run(k, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = []
        if order:
            frames = [pd.concat(list(frames)).sort_values(order)]
        for f in frames:
            for r in f.itertuples(index=False):
                now, made = step(now, r)
                if made is not None:
                    rows.append((k[0], *made))
        held.update(now)
        if rows:
            yield pd.DataFrame(rows)

    import re

    names = re.findall(r"(\w+) \w+", out)

    def named(k, frames, held):
        for f in run(k, frames, held):
            f.columns = names
            yield f

    return events.groupBy(key).applyInPandasWithState(named, out, state, "append", "NoTimeout")


def edge_step(threshold: float):
    """Rising edges over a threshold, counted."""

    def step(now, row):
        count, high = now
        rises = row.value > threshold and not high
        return (int(count) + int(rises), bool(row.value > threshold)), ((int(row.event_id), int(count) + 1) if rises else None)

    return step


def alarm_step(on: float, off: float):
    """A Schmitt trigger: one output for each change."""

    def step(now, row):
        (state,) = now
        new = True if row.value >= on else False if row.value <= off else bool(state)
        return (new,), ((int(row.event_id), new) if new != bool(state) else None)

    return step


def slew_step(rate: float):
    """A value that follows by ``rate`` a row at most."""

    def step(now, row):
        (held,) = now
        held = float(held) + max(-rate, min(rate, row.value - float(held)))
        return (held,), (int(row.event_id), held)

    return step


def pid_step(target: float, kp: float, ki: float, kd: float):
    """Proportional, integral and derivative answer to what is missing to ``target``."""

    def step(now, row):
        total, before = (float(x) for x in now)
        e = target - row.value
        total += e
        return (total, e), (int(row.event_id), kp * e + ki * total + kd * (e - before))

    return step


def timer_step(delay: int):
    """On once a condition has held for ``delay`` rows, off at once."""

    def step(now, row):
        n = int(now[0]) + 1 if row.value > 50 else 0
        return (n,), (int(row.event_id), n >= delay)

    return step


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a finite stream gives, written by the executors below the shared folder: what batches append, or the last complete result."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", f"{path}/rows")
    else:
        out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows"))
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
