"""Edits over a base table: a log of cell patches, replayed up to a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A patch: which version made it, the row, the column and the new value as text; a null value clears the cell.
PATCH = "version long, key long, column string, value string"


def apply(base: DataFrame, patches: DataFrame, key: str, version: int | None = None) -> DataFrame:
    """``base`` with the last patch of each cell up to ``version``; going back is asking for an earlier one."""
    some = patches if version is None else patches.where(F.col("version") <= version)
    last = some.groupBy("key", "column").agg(F.max_by(F.struct("value"), "version").alias("p"))
    wide = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("p")))).alias("__edits"))
    out = base.join(wide, base[key] == wide["key"], "left")
    edited = {}
    for f in base.schema.fields:
        if f.name != key:
            cell = F.try_element_at("__edits", F.lit(f.name))
            edited[f.name] = F.when(cell.isNotNull(), cell["value"].try_cast(f.dataType)).otherwise(F.col(f"`{f.name}`"))
    return out.select(*[edited[c].alias(c) if c in edited else base[c] for c in base.columns])


def changed(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Patched cells and how often each was."""
    return patches.groupBy("key", "column").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("last"))
