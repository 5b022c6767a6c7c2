"""Spreadsheets: sheets by name or number, parsed as streams; dates as dates; then shaped like any export."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import shaped

#: Number formats that show a date or a time of day (fixed by the format); others do if their code has such letters.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Rows that are passed on at once.
ROWS = 1000


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _parts(z: zipfile.ZipFile, name: str) -> list[ET.Element]:
    return list(ET.fromstring(z.read(name)).iter()) if name in z.namelist() else []


class Workbook:
    """The tables of a workbook that its sheets refer to."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        targets = {e.get("Id"): e.get("Target") for e in _parts(self.zip, "xl/_rels/workbook.xml.rels") if _tag(e) == "Relationship"}
        book = _parts(self.zip, "xl/workbook.xml")
        ref = lambda e: next((v for k, v in e.attrib.items() if k.endswith("}id")), None)
        self.sheets = [(e.get("name"), targets.get(ref(e), "")) for e in book if _tag(e) == "sheet"]
        old = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book)
        self.epoch = datetime(1904, 1, 1) if old else datetime(1899, 12, 30)
        self.shared = self._shared()
        codes, self.dated, inside = {}, [], False
        for e in _parts(self.zip, "xl/styles.xml"):
            inside = _tag(e) == "cellXfs" or (inside and _tag(e) not in ("cellStyles", "cellStyleXfs", "dxfs"))
            if _tag(e) == "numFmt":
                codes[int(e.get("numFmtId"))] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode") or "")
            elif inside and _tag(e) == "xf":
                n = int(e.get("numFmtId") or 0)
                self.dated.append(n in DATES or bool(re.search("[dmyhs]", codes.get(n, ""), re.I)))

    def _shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ET.iterparse(f):
                if _tag(e) == "si":
                    out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
                    e.clear()
        return out

    def path(self, sheet: str | int) -> str | None:
        """The file of a sheet by name or by number from 1."""
        if isinstance(sheet, int):
            found = [t for _, t in self.sheets][sheet - 1 : sheet] or [f"worksheets/sheet{sheet}.xml"]
        else:
            found = [t for n, t in self.sheets if n == sheet]
        name = found and (found[0].lstrip("/") if found[0].startswith("/") else f"xl/{found[0]}")
        return name if name in self.zip.namelist() else None

    def rows(self, sheet: str | int) -> Iterator[tuple[int, list[str | None]]]:
        """Number and cells of each row, as text; a sheet that is not there has none."""
        name = self.path(sheet)
        if name is None:
            return
        with self.zip.open(name) as f:
            for _, e in ET.iterparse(f):
                if _tag(e) == "row":
                    yield int(e.get("r")), self._cells(e)
                    e.clear()

    def _cells(self, row: ET.Element) -> list[str | None]:
        out: list[str | None] = []
        for c in row:
            at = 0
            for ch in re.match("[A-Z]+", c.get("r")).group():
                at = at * 26 + ord(ch) - 64
            out += [None] * (at - len(out))
            value = next((x.text for x in c if _tag(x) == "v"), None)
            kind, style = c.get("t"), int(c.get("s") or 0)
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
            elif value is not None and kind == "s":
                value = self.shared[int(value)]
            elif value is not None and kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            elif value is not None and kind in (None, "n") and style < len(self.dated) and self.dated[style]:
                value = str(self.epoch + timedelta(seconds=round(float(value) * 86400))).removesuffix(" 00:00:00")
            out[at - 1] = value
        return out


def cells(spark: SparkSession, path: str, sheet: str | int = 1) -> DataFrame:
    """Path, row, values in column order of a sheet of each workbook, dates in ISO form; each workbook is opened by one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple[int, list[str | None]]] = []
                for row in Workbook(data.as_py()).rows(sheet):
                    held.append(row)
                    if len(held) == ROWS:
                        yield told(p, held)
                        held = []
                yield told(p, held)

    def told(p: str, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.string()))], names=["path", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "path string, row int, values array<string>")


def read_workbooks(spark: SparkSession, path: str, sheet: str | int = 1, header_row: int = 1) -> DataFrame:
    """The sheet's rows below header_row as columns of text, plus _file and _row, shaped as read_delimited() does.

    Workbooks of one header are taken together, headers united by name; what comes to the driver is a header a workbook.
    """
    every = cells(spark, path, sheet)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for r in every.where(F.col("row") == header_row).toLocalIterator():
        names = [(n or "").strip() for n in r["values"]]
        layouts.setdefault(tuple((n if names.index(n) == i else f"{n}_{i}") or f"Unnamed: {i}" for i, n in enumerate(names)), []).append(r["path"])
    if not layouts:
        return spark.createDataFrame([], "_file string, _row long")
    below = every.where(F.col("row") > header_row)
    parts = []
    for names, paths in sorted(layouts.items()):
        of = spark.createDataFrame([(p,) for p in paths], "path string")
        rows = below.join(of, "path", "left_semi")
        parts.append(shaped(rows.select(F.col("path").alias("_file"), F.col("row").cast("long").alias("_row"), *(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
