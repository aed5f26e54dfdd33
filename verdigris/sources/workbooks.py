"""Workbooks (.xlsx): sheets as tables, and tables as workbooks with marked cells.

Workbooks are read as bytes by Spark's own file reader, a task for each, so any
store will do. They are written by a data source of two phases: tasks write files
aside, and those of a job that came to its end are moved to their place; its
folder must be one that pyarrow can open on the driver and on all executors.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter

from verdigris.sources.aside import AsideWriter

#: Fixed values of the format: rows of a sheet, day 0, names of its parts, number formats that show dates.
SHEET_ROWS = 1_048_576
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DATE_FORMATS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
_SCHEMA = "file string, sheet string, nth int, row long, cells array<struct<text:string,kind:string>>"


# -- reading ---------------------------------------------------------------

def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def _text_of(node: ElementTree.Element) -> str:
    """All runs of a text but phonetic ones."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == _tag("t") else part.findall(_tag("t")) if part.tag == _tag("r") else []))


class Workbook:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(targets[s.get(f"{{{RELATIONS}}}id")]) for s in book.iter(_tag("sheet"))}
        flag = book.find(_tag("workbookPr"))
        self.epoch = EPOCH_1904 if flag is not None and flag.get("date1904") in ("1", "true") else EPOCH
        self.shared = [_text_of(s) for s in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).findall(_tag("si"))] if "xl/sharedStrings.xml" in names else []
        self.dated = self._date_styles() if "xl/styles.xml" in names else set()

    def _date_styles(self) -> set[int]:
        """Numbers of the cell styles that show a number as a date."""
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        # texts in quotes and colours or locales in brackets don't make a date
        own = {int(f.get("numFmtId")) for f in styles.iter(_tag("numFmt")) if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[(?!h|m|s)[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
        formats = styles.find(_tag("cellXfs"))
        return {k for k, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in own | set(DATE_FORMATS)}

    def _value(self, cell: ElementTree.Element) -> tuple[str | None, str | None]:
        """Text and kind (n, b, d, s) of a cell; errors and empty cells have neither."""
        kind, v = cell.get("t", "n"), cell.find(_tag("v"))
        if kind == "inlineStr":
            inner = cell.find(_tag("is"))
            return (_text_of(inner), "s") if inner is not None else (None, None)
        if v is None or v.text is None or kind == "e":
            return None, None
        if kind == "s":
            return self.shared[int(v.text)], "s"
        if kind == "b":
            return ("true" if v.text == "1" else "false"), "b"
        if kind == "d":
            return v.text.replace("T", " "), "d"
        if kind == "n" and int(cell.get("s", 0)) in self.dated:
            return str(self.epoch + dt.timedelta(milliseconds=round(float(v.text) * 86_400_000))), "d"
        return v.text, "n" if kind == "n" else "s"

    def rows(self, sheet: str) -> Iterator[tuple[int, list[tuple[str | None, str | None]]]]:
        """Row number, from 1, and cells of the rows that are there; one row at a time is held."""
        number = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != _tag("row"):
                    continue
                number = int(node.get("r", number + 1))
                cells: list[tuple[str | None, str | None]] = []
                for cell in node.findall(_tag("c")):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [(None, None)] * (at - len(cells))
                    cells.append(self._value(cell))
                yield number, cells
                node.clear()


def _column_number(cell: str) -> int:
    """0 of A1, 26 of AA1."""
    n = 0
    for c in cell.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _column_name(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file, sheet, nth, row, cells: the rows of the sheet of this name, or of all sheets, of each workbook at path. A workbook without that sheet has no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                book = Workbook(content.as_py())
                for nth, title in enumerate(book.sheets):
                    if sheet is None or title == sheet:
                        part = []
                        for number, cells in book.rows(title):
                            part.append({"file": name, "sheet": title, "nth": nth, "row": number, "cells": [{"text": t, "kind": k} for t, k in cells]})
                            if len(part) == 1000:
                                yield pa.RecordBatch.from_pylist(part, kind)
                                part = []
                        yield pa.RecordBatch.from_pylist(part, kind)

    kind = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("nth", pa.int32()), ("row", pa.int64()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string())])))])
    return files.mapInArrow(run, _SCHEMA)


def _names(header: list[str | None]) -> list[str]:
    """Column names of a first row: empty ones by their place, repeated ones numbered."""
    out: list[str] = []
    for k, name in enumerate(header):
        name = base = f"Unnamed: {k}" if name is None else name
        n = 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    """The table of a workbook's sheet (its first one without a name) below a first row of column names. Its rows come as they stand in the file, which Spark may change as soon as it shuffles them.

    schema: names and types, by place; without it a column is long, double,
    boolean or timestamp where all its values are, else string. Empty cells are
    null; a value that its type can't hold is null. Workbooks at one path must have the same columns.
    """
    rows = sheet_rows(spark, path, sheet)
    rows = rows if sheet is not None else rows.where("nth = 0")
    head = rows.orderBy("row", "file").select("row", "cells").first()
    if head is None:
        raise ValueError(f"no such sheet, or nothing in it: {sheet or 'the first'} of {path}")
    names = _names([c["text"] for c in head["cells"]])
    body = rows.where(F.col("row") > head["row"])
    if schema is not None:
        fields = [(f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(schema)]
    else:
        long = body.select(F.posexplode("cells").alias("at", "c")).where("c.kind IS NOT NULL")
        whole = F.col("c.text").rlike("^-?[0-9]{1,18}$")
        kinds = {r["at"]: r for r in long.groupBy("at").agg(F.array_sort(F.collect_set("c.kind")).alias("kinds"), F.bool_and(whole).alias("whole")).collect()}  # a row for each column
        typed = {("n",): "double", ("b",): "boolean", ("d",): "timestamp_ntz"}
        fields = []
        for k, name in enumerate(names):
            r = kinds.get(k)
            kind = typed.get(tuple(r["kinds"]), "string") if r else "string"
            fields.append((name, "bigint" if kind == "double" and r["whole"] else kind))
    return body.select(*[F.expr(f"try_cast(try_element_at(cells, {k + 1}).text AS {kind})").alias(name) for k, (name, kind) in enumerate(fields)])


# -- writing ---------------------------------------------------------------

_BLUE, _DATE, _BLUE_DATE = 1, 2, 3
_PARTS = {
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><sz val="11"/><color rgb="FF0000FF"/><name val="Calibri"/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0"/></cellStyleXfs><cellXfs count="4"><xf numFmtId="0" fontId="0"/><xf numFmtId="0" fontId="1" applyFont="1"/><xf numFmtId="22" fontId="0" applyNumberFormat="1"/><xf numFmtId="22" fontId="1" applyFont="1" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
#: Characters that XML can't hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(at: str, value: object, marked: bool) -> str:
    if value is None or isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return ""
    style = f' s="{_BLUE}"' if marked else ""
    if isinstance(value, bool):
        return f'<c r="{at}"{style} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (dt.datetime, dt.date)):
        day = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        return f'<c r="{at}" s="{_BLUE_DATE if marked else _DATE}"><v>{(day.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, (int, float)) and not (isinstance(value, int) and abs(value) > 10**15):
        return f'<c r="{at}"{style}><v>{value!r}</v></c>'
    return f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def write_rows(out: io.IOBase, columns: list[str], rows: Iterator[tuple], sheet: str, marks: dict[str, list[str]]) -> int:
    """Writes a workbook row by row, a further sheet wherever one is full; the number of rows. Where a column of `marks` is false the cells of its columns are blue."""
    place = {c: k for k, c in enumerate(columns)}
    marks_at = [(place[flag], {place[c] for c in names}) for flag, names in marks.items() if flag in place and all(c in place for c in names)]
    titles, n, row = [], 0, next(rows, None)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, text)
        while row is not None or not titles:
            titles.append(sheet if not titles else f"{sheet} {len(titles) + 1}")
            with z.open(f"xl/worksheets/sheet{len(titles)}.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                f.write(f'<row r="1">{"".join(_cell(f"{_column_name(k)}1", c, False) for k, c in enumerate(columns))}</row>'.encode())
                number = 1
                while row is not None and number < SHEET_ROWS:
                    number, n = number + 1, n + 1
                    blue = {c for flag, names in marks_at if row[flag] is False for c in names}
                    f.write(f'<row r="{number}">{"".join(_cell(f"{_column_name(k)}{number}", v, k in blue) for k, v in enumerate(row))}</row>'.encode())
                    row = next(rows, None)
                f.write(b"</sheetData></worksheet>")
        every = range(1, len(titles) + 1)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{"".join(f"""<sheet name={chr(34)}{escape(titles[k - 1], {chr(34): "&quot;"})}{chr(34)} sheetId="{k}" r:id="rId{k}"/>""" for k in every)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(f"""<Relationship Id="rId{k}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in every)}<Relationship Id="rId0" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{"".join(f"""<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>""" for k in every)}</Types>')
    return n


class WorkbookSource(DataSource):
    """Writes a workbook for each partition that has rows (path is a folder), or one workbook (path ends with .xlsx)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(schema.names, dict(self.options), overwrite)


class WorkbookWriter(AsideWriter):
    def __init__(self, columns: list[str], options: dict[str, str], overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.columns, self.sheet, self.marks = columns, options.get("sheet", "Sheet1"), json.loads(options.get("marks", "{}"))

    def write_files(self, rows: Iterator[tuple], create: Callable[[str], io.IOBase]) -> int:
        with create("part.xlsx") as f:
            return write_rows(f, self.columns, rows, self.sheet, self.marks)

    def placed(self, files: list[tuple[str, int]]) -> list[tuple[str, str]]:
        full = [name for name, rows in files if rows] or [name for name, _ in files[:1]]
        if self.path.endswith(".xlsx"):
            if len(full) != 1:
                raise ValueError("one workbook is written from one partition")
            return [(full[0], "")]
        return [(name, f"part-{k:05}.xlsx") for k, name in enumerate(full)]


def write_workbooks(table: DataFrame, path: str, sheet: str = "Sheet1", marks: dict[str, list[str]] | None = None) -> None:
    """table in place of what was at path: one workbook where path ends with .xlsx (a report, of as many sheets as its rows need, in the table's order), else a folder of one for each partition.

    marks: by flag column, the columns whose cells are blue where the flag is
    false. Nulls, NaN and infinite numbers are empty cells, whole numbers beyond
    15 digits texts; other kinds than numbers, booleans, dates and texts are
    written as text. Files show themselves when all are written.
    """
    table.sparkSession.dataSource.register(WorkbookSource)
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    shown = table.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, plain) and not isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`").cast("double" if isinstance(f.dataType, T.DecimalType) else "string").alias(f.name) for f in table.schema])
    rows = shown.coalesce(1) if path.rstrip("/").endswith(".xlsx") else shown
    rows.write.format("workbook").mode("overwrite").option("sheet", sheet).option("marks", json.dumps(marks or {})).save(path)


def comparison_marks(columns: list[str], first: str = "_human", second: str = "_pred", flag: str = "_match") -> dict[str, list[str]]:
    """Marks of a comparison: for each x_match the columns x_human and x_pred."""
    stems = [c[: -len(flag)] for c in columns if c.endswith(flag)]
    return {s + flag: [s + first, s + second] for s in stems if s + first in columns and s + second in columns}
