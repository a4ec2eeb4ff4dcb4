"""Workbooks as a data source: cells of every kind, sheets in order, broken files, and the ranks in them."""

import zipfile

import pytest

from peaklight.operators import evaluate
from peaklight.sources import workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def column(i):
    return (column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def cell(i, line, value, strings):
    at = f'{column(i)}{line + 1}'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value}</v></c>'
    strings.append(value)
    return f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'


def write(path, sheets, raw=None, entity=""):
    """A workbook of sheets {name: {line: cells}}; ``raw`` is the XML of one more sheet."""
    strings, names = [], [*sheets, *(["raw"] if raw else [])]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, name in enumerate(names):
            rows = raw if name == "raw" else "".join(f'<row r="{line + 1}">' + "".join(cell(k, line, v, strings) for k, v in enumerate(cells)) + "</row>" for line, cells in sheets[name].items())
            book.writestr(f"xl/worksheets/s{i}.xml", f'<?xml version="1.0"?>{entity}<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{s[:1]}</t></r><rPh><t>reading</t></rPh><r><t xml:space=\"preserve\">{s[1:]}</t></r></si>" for s in strings) + "</sst>")


SHEET = {
    0: ["spectrum", "Alpha", "Search", None, "Beta"],
    1: [None, 1, 2.0, "3", 1, 2, 3],
    2: ["q_1", "Quartz", "x", " ", "Calcite", None, "Gypsum"],
    5: ["", "no", "spectrum"],
    6: ["g 2", "Gypsum"],
}


def test_a_workbook_gives_the_rows_of_its_ranked_sheet(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"ranks": SHEET})
    cells = workbook.read_workbooks(spark, f"file://{tmp_path}/a.xlsx")
    same = spark.createDataFrame([(line, [None if v is None else str(v) for v in c]) for line, c in SHEET.items()], "line long, cells array<string>")
    labels = [(("alpha", "search"), "Alpha Search")]
    want = sorted(evaluate.ranked_sheet(same, labels, 3).collect())
    assert len(want) == 4
    assert sorted(evaluate.ranked_sheet(cells.where("sheet = 'ranks'").select("line", "cells"), labels, 3).collect()) == want
    found, bare = evaluate.ranked_sheets(cells, labels, 3)
    assert sorted(tuple(r)[2:] for r in found.collect()) == [tuple(r) for r in want] and bare.count() == 0


def test_a_task_for_each_workbook_and_errors_as_rows(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"b{i}.xlsx", {"one": {0: ["a", i]}, "two": {0: ["b"], 3: [None, None, True, 2.5]}})
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "~$b0.xlsx").write_bytes(b"left by a program")
    (tmp_path / "other.csv").write_text("1,2")
    with zipfile.ZipFile(tmp_path / "empty.xlsx", "w") as book:
        book.writestr("xl/other.xml", "<a/>")
    df = workbook.read_workbooks(spark, f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    name = lambda r: r.path.rsplit("/", 1)[-1]
    assert {name(r) for r in rows if r.error} == {"broken.xlsx", "empty.xlsx"}
    assert sorted((name(r), r.sheet, r.line, r.cells) for r in rows if r.error is None and name(r) == "b1.xlsx") == [("b1.xlsx", "one", 0, ["a", "1"]), ("b1.xlsx", "two", 0, ["b"]), ("b1.xlsx", "two", 3, [None, None, "TRUE", "2.5"])]
    assert {r.sheet for r in workbook.read_workbooks(spark, f"file://{tmp_path}", sheet="two", pathGlobFilter="b*.xlsx").collect() if not r.error} == {"two"}
    with pytest.raises(Exception, match="BadZipFile|zip"):
        workbook.read_workbooks(spark, f"file://{tmp_path}/broken.xlsx", mode="failfast").collect()
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        workbook.read_workbooks(spark, f"file://{tmp_path}/nowhere").collect()
    (tmp_path / "none").mkdir()
    assert workbook.read_workbooks(spark, f"file://{tmp_path}/none").count() == 0


def test_cells_of_every_kind(spark, tmp_path):
    raw = '<row><c><v>1</v></c><c t="inlineStr"><is><t>in</t><r><t>line</t></r></is></c><c r="AB1" t="str"><f>A1&amp;"x"</f><v>1x</v></c></row><row r="9"/><row><c t="e"><v>#N/A</v></c><c t="s"/><c><f>1+1</f></c></row>'
    write(tmp_path / "c.xlsx", {"first": {0: ["_x0041_b", "Ünï & <co".replace("&", "&amp;").replace("<", "&lt;")]}}, raw)
    rows = {(r.sheet, r.line): r.cells for r in workbook.read_workbooks(spark, str(tmp_path / "c.xlsx")).collect()}
    assert rows[("first", 0)][1] == "Ünï & <co"
    assert rows[("raw", 0)][:2] == ["1", "inline"] and rows[("raw", 0)][27] == "1x" and rows[("raw", 0)].count(None) == 25
    assert rows[("raw", 8)] == [] and rows[("raw", 9)] == ["#N/A", None, None]
    assert [workbook.column_number(x) for x in ("A1", "Z9", "AA1", "xfd7")] == [0, 25, 26, 16383]


def test_a_workbook_that_declares_entities_is_not_read(spark, tmp_path):
    write(tmp_path / "d.xlsx", {"s": {0: ["a"]}}, entity='<!DOCTYPE x [<!ENTITY a "aaaa">]>')
    (row,) = workbook.read_workbooks(spark, f"file://{tmp_path}/d.xlsx").collect()
    assert "document type" in row.error


def test_sheets_without_ranks_are_named(spark):
    rows = [("a", "s", 0, ["", "A"]), ("a", "s", 1, ["", "1", "2"]), ("a", "s", 2, ["q", "x", "y"]), ("b", "s", 0, ["h"]), ("c", "s", 0, ["h", None]), ("c", "s", 1, [None, "1"]), (None, None, None, None)]
    found, bare = evaluate.ranked_sheets(spark.createDataFrame(rows, "path string, sheet string, line long, cells array<string>"), (), 2)
    assert [tuple(r) for r in found.collect()] == [("a", "s", "q", "A", 2, "y")] and sorted(r.path for r in bare.collect()) == ["b", "c"]
