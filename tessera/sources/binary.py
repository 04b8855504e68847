"""Binary sources: workbooks, point clouds and Parquet footers. A file is decoded by one task, columns that are not asked for are skipped."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


# workbooks


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(raw: bytes, sheet: int = 1) -> list[list]:
    """Cells of a sheet: shared and inline texts, numbers and booleans."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    tag = lambda e: e.tag.rpartition("}")[2]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if tag(si) == "si"]
    out = []
    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter():
        if tag(row) != "row":
            continue
        cells: dict[int, object] = {}
        for k, c in enumerate(c for c in row if tag(c) == "c"):
            value = next((v.text for v in c if tag(v) == "v"), None)
            kind = c.get("t", "n")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if tag(t) == "t")
            elif value is not None:
                value = shared[int(value)] if kind == "s" else value == "1" if kind == "b" else float(value) if kind == "n" else value
            cells[column_number(c.get("r")) if c.get("r") else k] = value
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def write_sheet(rows: Sequence[Sequence]) -> bytes:
    """A workbook with one sheet."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def read_workbooks(spark: SparkSession, path: str, schema: str, sheet: int = 1) -> DataFrame:
    """Rows of a sheet of each workbook; the first row has the names."""
    names = re.findall(r"(\w+) \w+", schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                top, *rows = sheet_rows(raw, sheet) or [[]]
                at = {n: i for i, n in enumerate(top)}
                yield pd.DataFrame({n: [r[at[n]] if n in at and at[n] < len(r) else None for r in rows] for n in names})

    return files(spark, path).select("content").mapInPandas(run, schema)


# point clouds


def las_points(raw: bytes, columns: Sequence[str]) -> pd.DataFrame:
    """Points of a LAS file (formats 0 to 3): coordinates scaled and shifted, intensity, class."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, kind, size, n = struct.unpack_from("<I", raw, 96)[0], raw[104] & 63, struct.unpack_from("<H", raw, 105)[0], struct.unpack_from("<I", raw, 107)[0]
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    if kind > 3:
        raise ValueError(f"point format {kind} is not read")
    points = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=start).reshape(n, size)
    whole = lambda at, t: points[:, at : at + np.dtype(t).itemsize].copy().view(t)[:, 0]
    made = {**{c: (lambda k=k: whole(4 * k, "<i4") * scale[k] + shift[k]) for k, c in enumerate("xyz")}, "intensity": lambda: whole(12, "<u2").astype("int32"), "class": lambda: (points[:, 15] & 31).astype("int32")}
    return pd.DataFrame({c: made[c]() for c in columns})


def las_file(x: np.ndarray, y: np.ndarray, z: np.ndarray, intensity: np.ndarray, scale: float = 0.001) -> bytes:
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = b"\1\2"
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, len(x))
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, 0.0, 0.0, 0.0)
    points = np.zeros((len(x), 20), dtype=np.uint8)
    for k, c in enumerate((x, y, z)):
        points[:, 4 * k : 4 * k + 4] = np.rint(c / scale).astype("<i4")[:, None].view(np.uint8)
    points[:, 12:14] = intensity.astype("<u2")[:, None].view(np.uint8)
    return bytes(head) + points.tobytes()


def read_las(spark: SparkSession, path: str, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    kinds = {"intensity": "int", "class": "int"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                yield las_points(raw, columns)

    return files(spark, path).select("content").mapInPandas(run, ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns))


# footers


def parquet_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Row groups of each file with rows, nulls and extremes by column, from the footers, which alone are read: files are opened where ``pyarrow`` knows their store, elsewhere they are read whole."""
    schema = "file string, row_group int, column string, rows long, nulls long, low string, high string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for f in frames:
            for i, name in enumerate(f["path"]):
                if whole:
                    meta, rows = pq.read_metadata(io.BytesIO(f["content"][i])), []
                else:
                    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                    meta, rows = pq.read_metadata(place, filesystem=store), []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for k in range(group.num_columns):
                        c = group.column(k)
                        s = c.statistics
                        rows.append((name, g, c.path_in_schema, group.num_rows, s.null_count if s else None, str(s.min) if s and s.has_min_max else None, str(s.max) if s and s.has_min_max else None))
                yield pd.DataFrame(rows, columns=["file", "row_group", "column", "rows", "nulls", "low", "high"])

    found = files(spark, path)
    whole = not re.match("(file|s3|gs|hdfs):", found.select("path").first()[0])
    return found.select("path", *(["content"] if whole else [])).mapInPandas(run, schema)
