"""Workbooks in Python, in and out: ``spark.read.format("workbook")``.

A workbook is a zip of XML. One partition reads one workbook's sheet row by
row; a folder's workbooks are read side by side and matched by column names.
The schema is all text. Dates and times, which a sheet stores as numbers with
a date's format, are read as ISO text; other numbers as their shortest decimals.
"""

from __future__ import annotations

import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from verdant.shipping import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Ids of the date and time formats that every workbook has.
DATES, TIMES, BOTH, ELAPSED = [14, 15, 16, 17, *range(27, 32), 36, *range(50, 59)], [18, 19, 20, 21, *range(32, 36), 45, 47], [22], [46]
BUILT_IN = {i: kind for kind, ids in {"date": DATES, "time": TIMES, "datetime": BOTH, "elapsed": ELAPSED}.items() for i in ids}
#: Rows of a sheet, its header included.
MOST_ROWS = 1_048_576
DAY = 86_400_000


def unique_names(names: list[str]) -> list[str]:
    """Trimmed names without a byte order mark; empty ones are numbered by place, repeated ones get the place too."""
    clean = [(n or "").lstrip("﻿").strip() for n in names]
    return [f"{n}...{i}" if not n or clean.count(n) > 1 else n for i, n in enumerate(clean, 1)]


def _column(ref: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def _text(node) -> str:
    text = "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def format_kind(code: str) -> str | None:
    """Whether a number format shows a date, time, datetime or elapsed time; None for numbers and text."""
    if re.search(r"\[[hms]+\]", shown := code.lower()):
        return "elapsed"
    shown = re.sub(r'"[^"]*"|\\.|[_*].|\[[^\]]*\]', "", shown).split(";")[0]
    if "general" in shown:
        return None
    clock = bool(re.search("[hs]", shown))
    return ("datetime" if clock else "date") if re.search("[yd]", shown) or ("m" in shown and not clock) else "time" if clock else None


def number_text(value: str) -> str:
    """The shortest decimals of a stored number, which may have 17 digits or an exponent."""
    if re.fullmatch(r"-?\d{1,15}", value):
        return value
    x = float(value)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def date_text(value: str, kind: str, from_1904: bool = False) -> str:
    """ISO text of a serial number, to the millisecond. What is no date (negative, the 29 February 1900 that never was, beyond 9999) stays a number."""
    days, ms = divmod(round(float(value) * DAY), DAY)
    clock = f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}" + (f".{ms % 1000:03}" if ms % 1000 else "")
    if kind == "elapsed" and days >= 0:
        return f"{24 * days + int(clock[:2]):02}{clock[2:]}"
    if kind == "time" and days == 0:
        return clock
    first = date(1904, 1, 1) if from_1904 else date(1899, 12, 31) if days < 60 else date(1899, 12, 30)
    if days < 0 or (days == 60 and not from_1904) or days > (date.max - first).days:
        return number_text(value)
    return str(first + timedelta(days)) + (f" {clock}" if ms or kind != "date" else "")


def _date_styles(z: zipfile.ZipFile) -> list[str | None]:
    """What each cell style shows."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): format_kind(f.get("formatCode") or "") for f in root.iter(f"{_MAIN}numFmt")}
    return [(BUILT_IN | own).get(int(x.get("numFmtId") or 0)) for xs in root.findall(f"{_MAIN}cellXfs") for x in xs.findall(f"{_MAIN}xf")]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if not path.startswith("/") else (fs.LocalFileSystem(), path)


def workbooks(path: str) -> list[str]:
    """``path`` itself, or the workbooks of the folder that it is."""
    store, root = _store(path)
    if store.get_file_info(root).type != fs.FileType.Directory:
        return [path]
    names = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.is_file and i.extension == "xlsx" and i.base_name[0] not in "~._"]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


@contextmanager
def _opened(path: str):
    store, file = _store(path)
    with store.open_input_file(file) as f, zipfile.ZipFile(f) as z:
        yield z


def sheet_rows(path: str, prefer: str | None = None) -> Iterator[list[str | None]]:
    """Cell texts of the preferred sheet if there is one, else the first. Blank cells and errors are null."""
    with _opened(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        properties = book.find(f"{_MAIN}workbookPr")
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        styles = _date_styles(z)
        sheets = book.findall(f".//{_MAIN}sheet")
        chosen = next((s for s in sheets if s.get("name") == prefer), sheets[0])
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == chosen.get(f"{_REL}id"))
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        with z.open(name) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for k, c in enumerate(node.findall(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else k
                    row += [None] * (at + 1 - len(row))
                    v = c.find(f"{_MAIN}v")
                    kind = c.get("t")
                    if kind == "inlineStr":
                        row[at] = _text(c)
                    elif v is not None and v.text is not None:
                        shows = int(c.get("s") or 0)
                        shows = styles[shows] if shows < len(styles) else None
                        if kind in (None, "n"):
                            row[at] = date_text(v.text, shows, from_1904) if shows else number_text(v.text)
                        elif kind != "e":
                            row[at] = strings[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[v.text] if kind == "b" else v.text
                node.clear()
                yield row


@dataclass
class _Book(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, names: list[str]):
        self.path, self.sheet, self.names = path, sheet, names

    def partitions(self):
        return [_Book(p) for p in workbooks(self.path)]

    def read(self, partition):
        rows = sheet_rows(partition.path, self.sheet)
        place = {n: i for i, n in enumerate(unique_names([h or "" for h in next(rows, [])]))}
        at = [place.get(n, MOST_ROWS) for n in self.names]
        for row in rows:
            yield tuple(row[i] if i < len(row) else None for i in at)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


# The parts of a workbook beside its sheet.
_SHEET = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>', "</sheetData></worksheet>"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    + "".join(f'<Override PartName="/xl/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for n, t in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
    + "</Types>",
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="%s" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_REL[1:-1]}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN[1:-1]}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss.000"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _cell(value) -> str:
    """A cell's XML: dates from 1900 on as styled serials, finite numbers and flags as such, the rest as text."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{value:d}</v></c>'
    if isinstance(value, date) and value.year >= 1900:
        day = date(value.year, value.month, value.day)
        serial = (day - (date(1899, 12, 31) if day < date(1900, 3, 1) else date(1899, 12, 30))).days
        if not isinstance(value, datetime):
            return f'<c s="1"><v>{serial}</v></c>'
        gone = datetime.combine(date.min, value.time()) - datetime.combine(date.min, time())
        return f'<c s="2"><v>{serial + gone / timedelta(days=1)!r}</v></c>'
    if not isinstance(value, str | date) and math.isfinite(value):
        return f"<c><v>{value}</v></c>"
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", str(value))
    text = re.sub("[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


class _Writer(DataSourceWriter):
    def __init__(self, path: str, sheet: str, names: list[str], overwrite: bool):
        self.path, self.sheet, self.names, self.overwrite, self.run = path, sheet, names, overwrite, uuid.uuid4().hex

    def _book(self, folder: str, rows: Iterator, most: int) -> tuple[str, bool]:
        """Writes a workbook of at most so many rows; its name, and whether it is full."""
        store, name, n = _store(self.path)[0], f"part-{uuid.uuid4().hex}.xlsx", 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for part, text in _PARTS.items():
                z.writestr(part, text.replace("%s", escape(self.sheet, {'"': "&quot;"})))
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                f.write(f"{_SHEET[0]}<row>{''.join(map(_cell, self.names))}</row>".encode())
                while n < most and (row := next(rows, None)) is not None:
                    f.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                    n += 1
                f.write(_SHEET[1].encode())
        return name, n == most

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        folder, files, more = f"{root}/_temporary-{self.run}", [], True
        store.create_dir(folder, recursive=True)
        while more:
            name, more = self._book(folder, iterator, MOST_ROWS - 1)
            files.append(name)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Only names go through the driver. A table without partitions becomes a workbook of its header."""
        store, root = _store(self.path)
        folder = f"{root}/_temporary-{self.run}"
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith("part-"):
                    store.delete_file(info.path)
        files = [f for m in messages if m is not None for f in m.files]
        for name in files or [self._book(folder, iter(()), 1)[0]]:
            store.move(f"{folder}/{name}", f"{root}/{name}")
        store.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        folder = f"{root}/_temporary-{self.run}"
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        books = workbooks(self.options["path"])
        header = next(sheet_rows(books[0], self.options.get("sheet")), []) if books else []
        return StructType([StructField(n, StringType()) for n in unique_names([h or "" for h in header])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet"), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("sheet") or "DwC_records", schema.names, overwrite)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = "DwC_records") -> DataFrame:
    """A workbook's rows, or those of all workbooks of a folder, whose columns are those of the first by name."""
    ship(spark)
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def write_xlsx(df: DataFrame, path: str, sheet: str = "DwC_records", mode: str = "overwrite") -> None:
    """``df`` as workbooks in the folder ``path``, one or more for each task; a failed write leaves nothing."""
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(Workbook)
    df.write.format("workbook").option("path", path).option("sheet", sheet).mode(mode).save()
