"""Workbooks against the same table as CSV."""

from __future__ import annotations

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

import pytest

from tremorlake.checks import DataError
from tremorlake.schemas import LAYOUT
from tremorlake.sources import sheets
from tremorlake.sources.tables import read_csv

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letter(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(path, tables):
    """tables: name -> rows of cells; text goes to the shared strings or, with a mark, stands in its cell."""
    strings: list[str] = []

    def cell(r, c, v):
        at = f'r="{letter(c)}{r}"'
        if v is None:
            return f"<c {at}/>"
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        if v.startswith("#"):
            return f'<c {at} t="e"><v>{v}</v></c>'
        if v.startswith("~"):
            return f'<c {at} t="inlineStr"><is><r><t>{escape(v[1:3])}</t></r><r><t>{escape(v[3:])}</t></r></is></c>'
        strings.append(v)
        return f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for n, rows in enumerate(tables.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
        named = "".join(f'<sheet name="{name}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(tables, 1))
        book.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(tables) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
    return str(path)


HEAD = ["data_channel", "sensor_id", "burial_depth_cm", "x_cm", "geometry_type", "analysis_role", "note"]
ROWS = [[0, "s<0>", 2, 1.5, "ring", "~target", "a"], [1, "s&1", 20.0, None, "line", "control", ""], [12, "s 2", 50.25, -3, "ring", "~target ünit", "b"]]


def test_a_layout_is_that_of_its_csv(spark, tmp_path):
    path = workbook(tmp_path / "layout.xlsx", {"Layout": [["", ""], HEAD, *ROWS], "other": [["x"], [1]]})
    lines = [HEAD, *[["" if v is None else str(v).lstrip("~") for v in r] for r in ROWS]]
    (tmp_path / "layout.csv").write_text("\n".join(",".join(f'"{v}"' if v else "" for v in r) for r in lines), encoding="utf-8-sig")
    book = sheets.read_layout(spark, path, LAYOUT, ["data_channel", "x_cm"])
    names = [n for n in HEAD if n in book.columns]
    text = sheets.read_layout(spark, str(tmp_path / "layout.csv"), LAYOUT, ["data_channel", "x_cm"])
    assert text.columns == read_csv(spark, str(tmp_path / "layout.csv"), LAYOUT).columns
    assert sorted(map(tuple, book.select(*names).collect()), key=str) == sorted(map(tuple, text.select(*names).collect()), key=str)
    assert dict(book.dtypes)["data_channel"] == "int" and [r[0] for r in book.select("z_cm").distinct().collect()] == [None]


def test_cells_of_every_kind(spark, tmp_path):
    rows = [["when", "n", "ok", "name", "x"], [45292.25, 3.0, True, "2024", 1e-3], ["2024-01-02 03:04:05", 2.5, False, "", "#N/A"], [None, 4503599627370497, "yes", "~inline", "text"]]
    path = workbook(tmp_path / "t.xlsx", {"a": [["x"]], "b": rows})
    got = sheets.read_sheet(spark, path, "when timestamp_ntz, n bigint, ok boolean, name string, x double", sheet="b").collect()
    assert [r["when"] for r in got] == [dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 1, 2, 3, 4, 5), None]
    assert [r["n"] for r in got] == [3, None, 4503599627370497] and [r["ok"] for r in got] == [True, False, True]
    assert [r["name"] for r in got] == ["2024", None, "inline"] and [r["x"] for r in got] == [0.001, None, None]


def test_columns_and_references():
    assert [sheets.column_of(x) for x in ("A1", "Z9", "AA10", "BC3")] == [0, 25, 26, 54]
    assert [letter(i) for i in (0, 25, 26, 54)] == ["A", "Z", "AA", "BC"]


def test_what_is_missing_is_told(spark, tmp_path):
    path = workbook(tmp_path / "t.xlsx", {"a": [["x"], [1]], "none": []})
    with pytest.raises(Exception, match="lacks the columns"):
        sheets.read_sheet(spark, path, "x int, y int", ["y"]).collect()
    with pytest.raises(Exception, match="no sheet c"):
        sheets.read_sheet(spark, path, "x int", sheet="c").collect()
    assert sheets.read_sheet(spark, path, "x int", sheet="none").count() == 0
    with pytest.raises(DataError, match="missing inputs"):
        sheets.read_layout(spark, str(tmp_path / "no.xlsx"), "x int")
