"""Spreadsheet files by the standard library: a Spark data source to read, a writer for small results."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _open(path: str):
    """A local path or any file system that Arrow knows."""
    if "://" not in path:
        return open(re.sub(r"^file:", "", path), "rb")
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(path: str) -> Iterator[list[str | None]]:
    """Rows of the active sheet as text, read as a stream; rows without any value are left out."""
    with _open(path) as f, zipfile.ZipFile(f) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as s:
                shared = ["".join(t.text or "" for t in e.iter(f"{_NS}t")) for _, e in ElementTree.iterparse(s) if e.tag == f"{_NS}si"]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        view = book.find(f"{_NS}bookViews/{_NS}workbookView")
        at = int(view.get("activeTab", 0)) if view is not None else 0
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with z.open(sheets[min(at, len(sheets) - 1)]) as s:
            for _, row in ElementTree.iterparse(s):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for k, c in enumerate(row.iter(f"{_NS}c")):
                    i = _column(c.get("r")) if c.get("r") else k
                    v, kind = c.find(f"{_NS}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else None if v is None else v.text
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "b" and text is not None:
                        text = "true" if text == "1" else "false"
                    out += [None] * (i - len(out)) + [text]
                row.clear()
                if any(out):
                    yield out


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        rows = read_sheet(partition.value)
        next(rows, None)
        for r in rows:
            yield tuple((r + [None] * len(self.columns))[: len(self.columns)])


class XlsxDataSource(DataSource):
    """format("xlsx_sheet").load(path): the active sheet with its first row as headers, all cells as text."""

    @classmethod
    def name(cls):
        return "xlsx_sheet"

    def _headers(self) -> list[str]:
        return [h or f"column_{i + 1}" for i, h in enumerate(next(read_sheet(self.options["path"]), []))]

    def schema(self):
        return StructType([StructField(h, StringType()) for h in self._headers()])

    def reader(self, schema):
        return _Reader(self.options["path"], [f.name for f in schema.fields])


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_sheet(path: str, headers: list[str], rows: Iterator, title: str = "Products") -> None:
    """One sheet, written row by row; numbers stay numbers, null cells are left out."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def cell(i: int, n: int, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f'<c r="{_name(i)}{n}"><v>{v}</v></c>'
        return f'<c r="{_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS[1:-1]}" xmlns:r="{rel}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as s:
            s.write(f'{head}<worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
            for n, r in enumerate([headers], 1):
                s.write(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(r))}</row>'.encode())
            for n, r in enumerate(rows, 2):
                s.write(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(r))}</row>'.encode())
            s.write(b"</sheetData></worksheet>")
