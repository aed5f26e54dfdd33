"""Workbooks: round trips, sheets made by hand, marked cells, two-phase writes."""

import datetime as dt
import re
import zipfile

import pytest

from verdigris.operators import summary
from verdigris.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def made_by_hand(path):
    """Shared strings with runs and phonetic marks, styled dates, gaps, errors, formulas, and sheets whose files stand in another order."""
    sheet2 = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c><c r="E1" t="str"><v>when</v></c></row>
    <row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3" t="b"><v>1</v></c><c r="E3" s="1"><v>45292.5</v></c></row>
    <row r="4"><c r="B4" t="b"><v>0</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="D4"><f>1+1</f><v>2.5</v></c><c r="E4" s="2"><v>1</v></c></row>
    <row r="9"><c t="inlineStr"><is><t>x</t></is></c><c r="AB9"><v>7</v></c></row>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="First &amp; one" sheetId="5" r:id="a"/><sheet name="Ground_truth" sheetId="1" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="b" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="a" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>name</t></si><si><r><t>o</t></r><r><t xml:space='preserve'>k </t></r><rPh sb='0' eb='1'><t>NO</t></rPh></si><si><t/></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="&quot;day&quot; 0.0"/><numFmt numFmtId="171" formatCode="[$-409]d\\-mmm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="171"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData><row><c t="inlineStr"><is><t>instance</t></is></c></row><row><c><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{sheet2}</sheetData></worksheet>")


def test_sheets_made_by_hand(spark, tmp_path):
    made_by_hand(tmp_path / "b.xlsx")
    df = workbooks.read_sheet(spark, str(tmp_path / "b.xlsx"))
    assert df.dtypes == [("name", "string"), ("ok ", "boolean"), ("Unnamed: 2", "string"), ("name.1", "double"), ("when", "string")]  # a date and a number
    assert [tuple(r) for r in df.collect()] == [("", True, None, None, "2024-01-01 12:00:00"), (None, False, None, 2.5, "1"), ("x", None, None, None, None)]
    typed = workbooks.read_sheet(spark, str(tmp_path / "b.xlsx"), "First & one", "a string, b boolean, c int, d int, e timestamp_ntz")
    assert [tuple(r)[3:] for r in typed.collect()] == [(None, dt.datetime(2024, 1, 1, 12)), (None, None), (None, None)]
    assert [tuple(r) for r in workbooks.read_sheet(spark, str(tmp_path / "b.xlsx"), "Ground_truth").collect()] == [(1,)]
    with pytest.raises(ValueError, match="no such sheet"):
        workbooks.read_sheet(spark, str(tmp_path / "b.xlsx"), "absent")
    rows = workbooks.sheet_rows(spark, str(tmp_path / "b.xlsx")).collect()
    assert [(r.sheet, r.nth, r.row) for r in rows] == [("First & one", 0, 1), ("First & one", 0, 3), ("First & one", 0, 4), ("First & one", 0, 9), ("Ground_truth", 1, 1), ("Ground_truth", 1, 2)]
    assert len(rows[3]["cells"]) == 28 and rows[3]["cells"][27].text == "7"


def test_round_trip_with_marks(spark, tmp_path):
    kinds = "instance string, a_human string, a_pred string, n long, x double, at timestamp_ntz, big long"
    given = [("n_1_fixed", "correct", "wrong", 1, 0.5, dt.datetime(2024, 2, 29, 1, 2, 3), 10**17), ("n_2_fixed", None, "wrong", -2, None, None, 1), ("n_3<&>\"'\x01", " é\n", " é\n", None, float("nan"), None, None)]
    table = summary.match_flags(spark.createDataFrame(given, kinds), "a_human", "a_pred", "a_match")
    path = str(tmp_path / "report.xlsx")
    for _ in range(2):  # again in its place
        workbooks.write_workbooks(table.orderBy("instance"), path, "Compared", workbooks.comparison_marks(table.columns))
    back = workbooks.read_sheet(spark, path, "Compared")
    assert dict(back.dtypes) == {"instance": "string", "a_human": "string", "a_pred": "string", "n": "bigint", "x": "double", "at": "timestamp_ntz", "big": "string", "a_match": "boolean"}
    assert [tuple(r) for r in back.collect()] == [
        ("n_1_fixed", "correct", "wrong", 1, 0.5, dt.datetime(2024, 2, 29, 1, 2, 3), str(10**17), False), ("n_2_fixed", None, "wrong", -2, None, None, "1", False), ("n_3<&>\"'", " é\n", " é\n", None, None, None, None, True)
    ]
    text = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert re.findall(r'<c r="([A-Z]+\d+)" s="1"', text) == ["B2", "C2", "C3"]  # an empty cell has no font
    assert [p.name for p in tmp_path.iterdir()] == ["report.xlsx"]
    assert workbooks.comparison_marks(["a_match", "a_human", "b_match"]) == {}


def test_folders_of_workbooks_and_full_sheets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many")
    workbooks.write_workbooks(spark.range(100).repartition(3), path)
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == ["part-00000.xlsx", "part-00001.xlsx", "part-00002.xlsx"]
    assert sorted(r.id for r in workbooks.read_sheet(spark, path).collect()) == list(range(100))
    workbooks.write_workbooks(spark.range(0), path)
    assert [p.name for p in (tmp_path / "many").iterdir()] == ["part-00000.xlsx"] and workbooks.read_sheet(spark, path).dtypes == [("id", "string")]
    with pytest.raises(Exception, match="(?s)boom|DIVIDE_BY_ZERO"):
        workbooks.write_workbooks(spark.range(100).selectExpr("id div (id - 50) AS id"), path)
    assert [p.name for p in (tmp_path / "many").iterdir()] == ["part-00000.xlsx"] and [p.name for p in tmp_path.iterdir()] == ["many"]  # what failed shows nowhere
    monkeypatch.setattr(workbooks, "SHEET_ROWS", 11)
    with open(tmp_path / "full.xlsx", "wb") as f:
        assert workbooks.write_rows(f, ["id"], iter([(k,) for k in range(25)]), "S", {}) == 25
    rows = workbooks.sheet_rows(spark, str(tmp_path / "full.xlsx")).where("row > 1").collect()
    assert [r.sheet for r in rows] == ["S"] * 10 + ["S 2"] * 10 + ["S 3"] * 5 and [int(r["cells"][0].text) for r in rows] == list(range(25))
