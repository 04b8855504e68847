"""Named steps wired into a graph and pulled on demand; a step is computed again only if it or something above it changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Step = Callable[..., DataFrame]
KINDS: dict[str, tuple[Step, int]] = {}


def kind(name: str, version: int = 1) -> Callable[[Step], Step]:
    """Registers a kind of step: ``f(spark, params, *inputs)``."""

    def add(f: Step) -> Step:
        KINDS[name] = (f, version)
        return f

    return add


@dataclass
class Flow:
    """A graph of steps. Filters and derived columns only extend the plan, so they run inside the scan of whatever aggregates them."""

    spark: SparkSession
    steps: dict[str, tuple[str, dict, tuple[str, ...]]] = field(default_factory=dict)
    cache: dict[str, DataFrame] = field(default_factory=dict)
    computed: list[str] = field(default_factory=list)

    def add(self, name: str, kind_: str, params: dict | None = None, inputs: tuple[str, ...] = ()) -> Flow:
        if kind_ not in KINDS:
            raise ValueError(f"no kind of step {kind_!r}")
        self.steps[name] = (kind_, params or {}, tuple(inputs))
        self._order(name, ())
        return self

    def _order(self, name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"{name} depends on itself")
        for i in self.steps.get(name, ("", {}, ()))[2]:
            self._order(i, (*above, name))

    def lineage(self, name: str) -> str:
        """A digest of the step, its parameters and everything above it."""
        k, params, inputs = self.steps[name]
        text = json.dumps([k, KINDS[k][1], params, [self.lineage(i) for i in inputs]], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def pull(self, name: str) -> DataFrame:
        key = self.lineage(name)
        if key not in self.cache:
            k, params, inputs = self.steps[name]
            self.cache[key] = KINDS[k][0](self.spark, params, *[self.pull(i) for i in inputs])
            self.computed.append(name)
        return self.cache[key]


@kind("load")
def load(spark: SparkSession, params: dict) -> DataFrame:
    return spark.read.format(params.get("format", "parquet")).options(**params.get("options", {})).load(params["path"])


@kind("calc")
def calc(spark: SparkSession, params: dict, df: DataFrame) -> DataFrame:
    from . import expressions

    return expressions.calc(df, params)


@kind("filter")
def keep_rows(spark: SparkSession, params: dict, df: DataFrame) -> DataFrame:
    from . import expressions

    return expressions.where(df, params["where"])


@kind("rows")
def rows(spark: SparkSession, params: dict, df: DataFrame, *others: DataFrame) -> DataFrame:
    from . import rowlang

    return rowlang.Transform(params["program"]).run(df, dict(zip(params.get("tables", ()), others)), params.get("order"))


@kind("stats")
def stats(spark: SparkSession, params: dict, df: DataFrame) -> DataFrame:
    from ..operators import aggregates

    return df.groupBy(*params.get("by", ())).agg(*aggregates.from_spec(params["spec"]))


@kind("grade_tonnage")
def grade_tonnage(spark: SparkSession, params: dict, df: DataFrame) -> DataFrame:
    from ..operators import aggregates

    return aggregates.grade_tonnage(df, params["grade"], params["tonnes"], params["cutoffs"])


@kind("swath")
def swath(spark: SparkSession, params: dict, df: DataFrame) -> DataFrame:
    from ..operators import aggregates

    return aggregates.swath(df, **params)
