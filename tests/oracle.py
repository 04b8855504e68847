"""Runs queries beside their SQL: ``python tests/oracle.py SF_DIR [NAME...]``."""

import math
import os
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def compare(df, relation):
    """What differs between a Spark frame and a DuckDB relation; nothing if they agree."""
    import datetime

    got, names = df.collect(), sorted(df.columns)
    cols = relation.columns
    if names != sorted(cols):
        return f"columns {names} and {sorted(cols)}"
    want = relation.fetchall()
    at = [cols.index(n) for n in names]
    base = lambda v: "n" if v is None else type(v).__name__
    a = sorted([tuple(plain(r[n]) for n in names) for r in got], key=repr)
    b = sorted([tuple(plain(r[i]) for i in at) for r in want], key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{dict(zip(names, x))} and {dict(zip(names, y))}"
    for i, n in enumerate(names):
        kinds = {base(r[i]) for r in a} | {base(r[i]) for r in b}
        if len(kinds - {"n"}) > 1:
            return f"{n} has types {kinds}"
    del datetime
    return ""


def main(sf, *names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", "/tmp/wh").config("spark.checkpoint.dir", "file:///tmp/checkpoints/oracle").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    c, q, o, bad = connection(sf), e.queries(), e.oracle_sql(), 0
    from tessera.registry import QUERIES

    for n in names or QUERIES:
        try:
            said = compare(q[n](spark, sf), c.sql(o[n])) if n in o else f"rows {q[n](spark, sf).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__} {str(x)[:300]}"
        if said:
            bad += not said.startswith("rows")
            print(n, "|", said[:420].replace("\n", " "), flush=True)
    print("failed", bad, "of", len(names or QUERIES))


if __name__ == "__main__":
    main(*sys.argv[1:])
