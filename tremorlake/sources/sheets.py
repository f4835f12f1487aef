"""Spreadsheet workbooks (XLSX) as tables, read in the executors from the public format: a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.checks import DataError
from tremorlake.sources.tables import _split, exists, read_csv, typed

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Day 0 of a workbook's dates.
DAY_ZERO = "1899-12-30 00:00:00"


def column_of(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    out = 0
    for c in re.match(r"[A-Z]+", reference).group():
        out = 26 * out + ord(c) - ord("A") + 1
    return out - 1


def _parts(stream, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of that tag one after the other, each forgotten once it was seen."""
    context = ElementTree.iterparse(stream, events=("start", "end"))
    _, root = next(context)
    for event, element in context:
        if event == "end" and element.tag == _MAIN + tag:
            yield element
            element.clear()
            root.clear() if tag == "si" else None


def _text(element: ElementTree.Element) -> str:
    """All runs of a string, without its phonetic marks."""
    runs = [element.find(_MAIN + "t"), *[r.find(_MAIN + "t") for r in element.findall(_MAIN + "r")]]
    return "".join(t.text or "" for t in runs if t is not None)


def _sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")
    names = {s.get("name"): s.get(_REL) for s in listed}
    if sheet is not None and sheet not in names:
        raise DataError(f"no sheet {sheet} among {sorted(names)}")
    wanted = names[sheet] if sheet is not None else next(iter(names.values()))
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == wanted:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise DataError("the workbook doesn't say where its sheet is")


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """Number and cells (by column) of each row that has any, in order; blank cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                strings = [_text(si) for si in _parts(stream, "si")]
        with book.open(_sheet_path(book, sheet)) as stream:
            before = 0
            for row in _parts(stream, "row"):
                before = int(row.get("r") or before + 1)
                cells, at = {}, -1
                for c in row.findall(_MAIN + "c"):
                    at = column_of(c.get("r")) if c.get("r") else at + 1
                    value, kind = c.find(_MAIN + "v"), c.get("t", "n")
                    if kind == "inlineStr":
                        text = _text(c.find(_MAIN + "is"))
                    elif value is None or value.text is None or kind == "e":  # an error is no value
                        continue
                    elif kind == "s":
                        text = strings[int(value.text)]
                    elif kind == "b":
                        text = "true" if value.text == "1" else "false"
                    else:
                        text = value.text
                    if text != "":
                        cells[at] = text
                if cells:
                    yield before, cells


def _number(value: Column, kind: str) -> Column:
    """Cells hold numbers as decimals, whole ones too, and times as days."""
    if kind in ("int", "bigint", "smallint", "long"):
        return F.when(value.try_cast("double") == F.floor(value.try_cast("double")), value.try_cast("double").cast("decimal(38,0)").cast(kind))
    if kind == "timestamp_ntz":
        days = value.try_cast("double")
        serial = F.timestamp_add("MICROSECOND", F.rint(days * 86_400 * 1_000_000).cast("long"), F.lit(DAY_ZERO).cast("timestamp_ntz"))
        return F.when(days.isNotNull(), serial).otherwise(typed(value, kind))
    return typed(value, kind)


def read_sheet(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), sheet: str | None = None) -> DataFrame:
    """Workbooks at path, their first or the named sheet, by the names in its first row that has any; columns are
    typed as schema says, text where it says nothing of one.  Only columns of schema are read, missing ones are null."""
    kinds = dict(part.strip().split(" ", 1) for part in _split(schema))
    names = list(kinds)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(content, sheet)
                _, head = next(rows, (0, {}))
                at = {v.strip(): c for c, v in head.items()}
                missing = sorted(set(required) - set(at))
                if missing:
                    raise DataError(f"{name} lacks the columns {missing}")
                found = []
                for _, cells in rows:
                    found.append([cells.get(at.get(n, -1)) for n in names])
                    if len(found) == 10_000:
                        yield pd.DataFrame(found, columns=names, dtype=object)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=names, dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, ", ".join(f"`{n}` string" for n in names))
    return raw.select(*[_number(F.col(f"`{n}`"), k).alias(n) for n, k in kinds.items()])


def read_layout(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """A sensor layout from a workbook, CSV or Parquet, by its name."""
    if not exists(spark, path):
        raise DataError(f"missing inputs: layout ({path})")
    low = path.lower()
    if low.endswith((".xlsx", ".xlsm")):
        return read_sheet(spark, path, schema, required)
    return read_csv(spark, path, schema, required) if low.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
