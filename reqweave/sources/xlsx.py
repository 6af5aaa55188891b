"""Spreadsheets: a Spark data source ``xlsx`` that writes and reads one sheet of texts, from the standard library alone."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Limits and names of the format.
MAX_CELL, MAX_ROWS = 32_767, 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{SHEET_TYPE}.sheet.main+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{SHEET_TYPE}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_x[0-9A-Fa-f]{4}_")


def _encoded(text: str) -> str:
    """XML can't hold control characters; the format writes them as _x000B_, and so what looks like that."""
    return escape(_CONTROL.sub(lambda m: "".join(f"_x{ord(c):04X}_" for c in m[0][:1]) + m[0][1:], text))


def _decoded(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _row(values) -> str:
    cells = (f'<c t="inlineStr"><is><t xml:space="preserve">{_encoded(str(v))}</t></is></c>' if v is not None else "<c/>" for v in values)
    return f"<row>{''.join(cells)}</row>"


def write_file(path: str, names: list[str], rows) -> int:
    """Writes a sheet of a header and rows, as inline texts, so a leading = is no formula. Returns the number of rows.

    Folders are made; the file appears whole or not at all. ValueError for a text or table beyond the format's limits.
    """
    if not isinstance(path, str) or not path.strip():
        raise ValueError("the path is empty")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    os.close(fd)
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in PARTS.items():
                z.writestr(name, HEAD + body)
            with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{_row(names)}'.encode())
                for row in rows:
                    n += 1
                    if n >= MAX_ROWS:
                        raise ValueError(f"a sheet holds {MAX_ROWS} rows")
                    if any(v is not None and len(str(v)) > MAX_CELL for v in row):
                        raise ValueError(f"a cell holds {MAX_CELL} characters")
                    sheet.write(_row(row).encode())
                sheet.write(b"</sheetData></worksheet>")
        os.chmod(part, 0o644)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return n


def read_file(path: str) -> Iterator[list[str | None]]:
    """The rows of a file that ``write_file`` wrote, the header first."""
    with zipfile.ZipFile(path) as z, z.open("xl/worksheets/sheet1.xml") as sheet:
        for _, element in ElementTree.iterparse(sheet):
            if element.tag == f"{{{MAIN}}}row":
                texts = (c.find(f"{{{MAIN}}}is/{{{MAIN}}}t") for c in element)
                yield [None if t is None else _decoded(t.text or "") for t in texts]
                element.clear()


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows) -> _Written:
        return _Written(write_file(self.path, self.names, (list(r) for r in rows)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def read(self, partition):
        rows = read_file(self.path)
        next(rows, None)
        for r in rows:
            yield tuple((r + [None] * self.width)[: self.width])


class XlsxDataSource(DataSource):
    """``df.coalesce(1).write.format("xlsx").mode("overwrite").save(path)``: one task writes, as a sheet is one file.

    The path is one that the task's machine and the reader share.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        names = next(read_file(self.options["path"]))
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], len(schema.fields))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.fieldNames())
