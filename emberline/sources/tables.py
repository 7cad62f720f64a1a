"""Small inventories as rows of text cells: CSV files and sheets of xlsx workbooks, read with the standard library.

Files are opened on the executors, one a row of Spark's binary source. A record is a
map from the header's names to text; blank cells are left out, so the first of several
names that a release may use is a plain ``coalesce``.
"""

from __future__ import annotations

import csv
import gzip
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, n bigint, cells map<string,string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """Cells of the rows of a sheet (by default the first) as text; nothing if there is no such sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iter(MAIN + "t")) for s in root.findall(MAIN + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(PACKAGE + "Relationship")}
        sheets = {s.get("name"): targets[s.get(RELATION)] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet")}
        target = sheets.get(sheet) if sheet is not None else next(iter(sheets.values()), None)
        if target is None:
            return
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != MAIN + "row":
                    continue
                out: list[str] = []
                for cell in row.findall(MAIN + "c"):
                    at = column_number(cell.get("r") or "") if cell.get("r") else len(out)
                    value, kind = cell.findtext(MAIN + "v"), cell.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(MAIN + "t"))
                    out += [""] * (at - len(out))
                    out.append(value or "")
                yield out
                row.clear()


def records(path: str, content: bytes, sheet: str | None) -> Iterator[tuple[int, dict[str, str]]]:
    if path.lower().endswith((".xlsx", ".xls")):
        rows = sheet_rows(content, sheet)
    else:
        raw = gzip.decompress(content) if path.endswith(".gz") else content
        rows = csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))
    header = [h.strip() for h in next(rows, [])]
    for n, row in enumerate(rows):
        cells = dict(reversed([(h, v) for h, v in zip(header, row) if h and v != ""]))
        if cells:
            yield n, cells


def read_cells(spark: SparkSession, path: str | list[str], sheets: dict[str, str] | None = None) -> DataFrame:
    """Records (SCHEMA) of the files at ``path``; ``sheets``: the sheet of a file whose name ends so, else the first."""
    named = dict(sheets or {})

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for p, content in zip(batch["path"], batch["content"]):
                sheet = next((s for end, s in named.items() if p.endswith(end)), None)
                rows = [(p, n, c) for n, c in records(p, bytes(content), sheet)]
                for at in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[at : at + 5000], columns=["path", "n", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def first(*names: str, cells: str = "cells") -> Column:
    """The first of these cells that is there and not blank."""
    return F.coalesce(*[F.nullif(F.col(cells)[n], F.lit("")) for n in names])


def as_cells(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with its other columns as a map of text cells."""
    rest = [c for c in df.columns if c not in keep]
    pairs = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return df.select(*keep, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != "")).alias("cells"))


def split_place(value: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a text ``lat, lon``; both null if it isn't one."""
    parts = F.split(value, ",")
    lat, lon = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    good = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.when(good, lat), F.when(good, lon)
