"""Delimited and line-based sources: sniffing on a bounded head, then the parallel readers."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blanks as B

#: Lines of a file's head that are looked at.
HEAD_LINES = 200


@dataclass(frozen=True)
class Kind:
    """What a delimited file looks like."""

    separator: str
    header: bool
    decimal: str
    skip: int
    names: tuple[str, ...]
    types: tuple[str, ...]
    #: Whether quoted fields hold line breaks; such a file is read by one task, another in splits.
    multi_line: bool = False


def head(spark: SparkSession, path: str, n: int = HEAD_LINES) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def fields(line: str, separator: str) -> list[str]:
    """Quoted split of one line."""
    out, now, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == '"' and line[i + 1 : i + 2] == '"':
                now += '"'
                i += 1
            elif c == '"':
                quoted = False
            else:
                now += c
        elif c == '"' and not now:
            quoted = True
        elif c == separator:
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [*out, now]


def number_like(text: str, decimal: str) -> bool:
    t = text.strip()
    if decimal == ",":
        t = t.replace(".", "").replace(",", ".")
    return bool(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", t))


def logical(lines: list[str]) -> list[str]:
    """Lines joined while a quote is open; an open one at the end is left as it is."""
    out: list[str] = []
    held: list[str] = []
    for x in lines:
        held.append(x)
        if "\n".join(held).count('"') % 2 == 0:
            out.append("\n".join(held))
            held = []
    return out + held[:1]


def sniff(lines: list[str]) -> Kind:
    """The separator that splits most lines into the same number of fields, and what the columns hold."""
    lines = [x.lstrip("﻿").rstrip("\r") for x in lines]
    multi_line = any(x.count('"') % 2 for x in lines)
    lines = logical(lines) if multi_line else lines
    skip = next((i for i, x in enumerate(lines) if x.strip() and not x.startswith(("#", "//", ";;"))), 0)
    body = [x for x in lines[skip:] if x.strip()]
    best = (0.0, ",")
    for s in (",", ";", "\t", "|"):
        counts = Counter(len(fields(x, s)) for x in body)
        n, often = max(counts.items(), key=lambda c: (c[1], c[0])) if counts else (1, 0)
        if n > 1:
            best = max(best, (often / len(body) * (1 + n / 1000), s))
    separator = best[1]
    rows = [fields(x, separator) for x in body]
    cells = [c for r in rows[1:] for c in r if c.strip()]
    decimal = "," if separator != "," and sum(number_like(c, ",") and "," in c for c in cells) > sum(number_like(c, ".") and "." in c for c in cells) else "."
    header = bool(rows) and not any(number_like(c, decimal) for c in rows[0] if c.strip())
    names = tuple(c.strip() or f"c{i}" for i, c in enumerate(rows[0])) if header else tuple(f"c{i}" for i in range(len(rows[0]) if rows else 0))
    types = []
    for i in range(len(names)):
        column = [r[i].strip() for r in rows[1 if header else 0 :] if i < len(r)]
        some = [c for c in column if c.lower() not in B.TABLE_NULLS]
        types.append("double" if some and sum(number_like(c, decimal) for c in some) >= 0.8 * len(some) else "string")
    return Kind(separator, header, decimal, skip, names, tuple(types), multi_line)


def read_raw(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """All columns as text. Quotes and doubled quotes are honoured, and line breaks inside quotes if ``kind`` says that there are some."""
    schema = ", ".join(f"`{n}` string" for n in kind.names)
    return spark.read.schema(schema).csv(path, sep=kind.separator, header=kind.header, quote='"', escape='"', comment="#" if kind.skip else None, multiLine=kind.multi_line, mode="PERMISSIVE")


def read_csv(spark: SparkSession, path: str, kind: Kind | None = None, nulls: tuple[str, ...] = B.TABLE_NULLS, ignore_case: bool = True) -> DataFrame:
    """Typed columns; null tokens and what does not read as a number are null. Without a ``kind``, the head says how lines are cut and all rows what is a number: four of five values of a column at least."""
    given, kind = kind, kind or sniff(head(spark, path))
    raw = read_raw(spark, path, kind)
    read = B.comma_number if kind.decimal == "," else B.number
    cells = [B.null_tokens(F.col(f"`{n}`"), nulls, ignore_case) for n in kind.names]
    types = kind.types
    if not given and cells:
        counts = raw.agg(*[f(x).alias(f"{k}{i}") for i, c in enumerate(cells) for k, f, x in (("some", F.count, c), ("numbers", F.count, read(c)))]).first()
        types = ["double" if counts[f"some{i}"] and 5 * counts[f"numbers{i}"] >= 4 * counts[f"some{i}"] else "string" for i in range(len(cells))]
    return raw.select([(read(c) if t == "double" else c).alias(n) for n, t, c in zip(kind.names, types, cells)])


def lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """Lines without carriage returns; comment lines are left out."""
    out = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    return out.where(~F.startswith(F.col("line"), F.lit(comment))) if comment else out


def read_geoeas(spark: SparkSession, path: str) -> DataFrame:
    """Title, number of variables, their names, then rows of numbers."""
    top = head(spark, path)
    n = int(top[1].split()[0])
    names = [x.strip() for x in top[2 : 2 + n]]
    # the head is the first lines of the file's first split
    line = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = spark.read.text(path).select("value", line.alias("line"), F.col("_metadata.file_block_start").alias("start")).where((F.col("start") > 0) | (F.col("line") >= 2 + n))
    rows = rows.where(F.trim("value").rlike(r"^[-+.\d]")).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") == n)
    return rows.select([F.get("f", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(names)])


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.csv(path, sep=separator, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of flat objects, or one object a line."""
    return spark.read.schema(schema).json(path, multiLine=True)
