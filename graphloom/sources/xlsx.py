"""Sheets of XLSX files as tables of text: a Spark data source.

A sheet is a compressed stream of rows.  It is parted into ranges of rows by the
size that it states; a task unpacks the stream up to its range, counts the rows
that it passes without parsing them, parses its own and stops.  For the header
only the head of the stream is read.  A sheet that doesn't state its size is one
task.  Nothing but the shared texts and a batch of rows is held.  Cells of numbers
and dates are their stored text (``excel_day`` turns a day's number into a date).
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import cached_property
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.sources.graph_files import files_of

BATCH = 2000
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node) -> str:
    """The text of a string item: its plain part and its runs, without phonetic hints."""
    return "".join(t.text or "" for part in node if _local(part.tag) in ("t", "r") for t in part.iter() if _local(t.tag) == "t")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if _local(node.tag) == "si":
                out.append(_text(node))
                node.clear()
    return out


def _sheet_file(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The sheet's part by name or by place; raises ValueError if there is none."""
    sheets = [n for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"]
    names = [n.get("name") for n in sheets]
    if isinstance(sheet, str) and sheet not in names or isinstance(sheet, int) and not 0 <= sheet < len(sheets):
        raise ValueError(f"no sheet {sheet}; there are {', '.join(map(str, names))}")
    wanted = sheets[names.index(sheet) if isinstance(sheet, str) else sheet].get(_RELATION)
    targets = {n.get("Id"): n.get("Target") for n in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[wanted]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _place(reference: str | None, after: int) -> int:
    """The column of a reference such as ``AB12``, from 0; a cell without one follows the last."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after
    at = 0
    for c in letters[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


_ROW = re.compile(rb"<((?:[\w.-]+:)?)row(?=[\s/>])[^>]*?(/?)>")
_NAMES = re.compile(rb"xmlns(?::[\w.-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')")
CHUNK = 1 << 18


class _Sheet:
    """The row elements of a sheet's stream, by number."""

    def __init__(self, stream):
        self.stream, self.text = stream, b""
        while b">" not in self.text.partition(b"worksheet")[2] and self.more():
            pass
        # elements are parsed by themselves, so they need the names that the root declares
        root = self.text[: self.text.find(b">", self.text.find(b"worksheet")) + 1]
        self.open = b"<r " + b" ".join(dict.fromkeys(_NAMES.findall(root))) + b">"

    def more(self) -> bool:
        raw = self.stream.read(CHUNK)
        self.text += raw
        return bool(raw)

    def size(self) -> int | None:
        """The number of the last row, if the sheet states it before its rows."""
        while (m := _ROW.search(self.text)) is None and b"sheetData" not in self.text and self.more():
            pass
        stated = re.search(rb"<(?:[\w.-]+:)?dimension\b[^>]*\bref\s*=\s*[\"'](?:[A-Z]+[0-9]+:)?[A-Z]+([0-9]+)", self.text[: m.start()] if m else self.text)
        return int(stated[1]) if stated else None

    def rows(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, ElementTree.Element]]:
        """(number, element) of the rows from ``first`` up to ``last``; others are passed by."""
        at = number = 0
        while last is None or number < last:
            m = _ROW.search(self.text, at)
            if not m:
                # a tag may be cut by the end
                self.text = self.text[max(at, len(self.text) - 4096) :]
                at = 0
                if not self.more():
                    return
                continue
            end = m.end() if m[2] else self.text.find(b"</" + m[1] + b"row>", m.end())
            if end < 0:
                self.text, at = self.text[m.start() :], 0
                if not self.more():
                    raise ValueError("the sheet ends inside a row")
                continue
            end += 0 if m[2] else len(m[1]) + 6
            if number >= first:
                yield number, ElementTree.fromstring(self.open + self.text[m.start() : end] + b"</r>")[0]
            number, at = number + 1, end


def _cells(node: ElementTree.Element, strings: list[str]) -> list[str | None]:
    row: list[str | None] = []
    for cell in node:
        if _local(cell.tag) != "c":
            continue
        at, kind = _place(cell.get("r"), len(row)), cell.get("t")
        parts = {_local(x.tag): x for x in cell}
        value = _text(parts["is"]) if "is" in parts else parts["v"].text if "v" in parts else None
        if kind == "s" and value is not None:
            value = strings[int(value)]
        elif kind == "b" and value is not None:
            value = "true" if value == "1" else "false"
        elif kind == "e":
            value = None
        row.extend([None] * (at + 1 - len(row)))
        row[at] = value
    return row


def _numbered(book: zipfile.ZipFile, sheet: str | int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """The rows of a range that have a value, cells that are missing as None."""
    strings = _shared(book)
    with book.open(_sheet_file(book, sheet)) as f:
        for number, node in _Sheet(f).rows(first, last):
            row = _cells(node, strings)
            if any(x is not None for x in row):
                yield number, row


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet, cells that are missing as None; rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for _, row in _numbered(book, sheet):
            yield row


def _open(path: str):
    if "://" in path and not path.startswith("file://"):
        system, inner = pafs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


def _named(header: list[str | None]) -> dict[str, int]:
    """Columns by name; blank names are left out, and a repeated name gets a number."""
    seen: dict[str, int] = {}
    out = {}
    for i, name in enumerate(header):
        name = (name or "").strip()
        if name:
            seen[name] = seen.get(name, 0) + 1
            out[name if seen[name] == 1 else f"{name}_{seen[name]}"] = i
    return out


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int | None):
        super().__init__(path)
        self.path, self.first, self.last = path, first, last


class _SheetReader(DataSourceReader):
    def __init__(self, paths: list[str], sheet: str | int, wanted: list[tuple[str, int]], rows: int):
        self.paths, self.sheet, self.wanted, self.rows = paths, sheet, wanted, rows

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            with _open(path) as f, zipfile.ZipFile(f) as book:
                with book.open(_sheet_file(book, self.sheet)) as stream:
                    size = _Sheet(stream).size()
                header = next(_numbered(book, self.sheet), None)
            # what the sheet states of its size is no more than a hint: the last range is open
            starts = list(range(header[0] + 1, max(size or 0, header[0] + 2), self.rows)) if header else []
            out += [_Range(path, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held: list[list[str | None]] = []
        with _open(partition.path) as f, zipfile.ZipFile(f) as book:
            for _, row in _numbered(book, self.sheet, partition.first, partition.last):
                held.append([row[i] if i < len(row) else None for _, i in self.wanted])
                if len(held) == BATCH:
                    yield self.batch(held)
                    held = []
        if held:
            yield self.batch(held)

    def batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], [n for n, _ in self.wanted])


class SheetSource(DataSource):
    """Options: ``sheet`` (a name or a place, as JSON), ``columns`` (the names wanted, as JSON) and ``rowsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    @property
    def sheet(self) -> str | int:
        return json.loads(self.options.get("sheet", "0"))

    @cached_property
    def paths(self) -> list[str]:
        return files_of(self.options["path"], "*.xlsx")

    @cached_property
    def wanted(self) -> list[tuple[str, int]]:
        """The columns that are read, named by the first file's first row, with their places."""
        if not self.paths:
            return []
        with _open(self.paths[0]) as f, zipfile.ZipFile(f) as book:
            header = next(_numbered(book, self.sheet), (0, []))[1]
        named, asked = _named(header), json.loads(self.options.get("columns", "null"))
        missing = [c for c in asked or () if c not in named]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(named)}")
        return [(n, i) for n, i in named.items() if asked is None or n in asked]

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n, _ in self.wanted])

    def reader(self, schema) -> _SheetReader:
        return _SheetReader(self.paths, self.sheet, self.wanted, int(self.options.get("rowsPerPartition", "100000")))


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0, columns: list[str] | None = None, rows_per_partition: int = 100_000) -> DataFrame:
    """The sheet of each file of ``path`` (a file, a pattern or a folder) as text columns, named by the first file's first row; blank names are left out.

    A repeated name gets a number, ``name_2``.  With ``columns`` only those are
    read.  An empty sheet gives no columns and no rows.
    """
    spark.dataSource.register(SheetSource)
    options = {"sheet": json.dumps(sheet), "rowsPerPartition": str(rows_per_partition)} | ({"columns": json.dumps(columns)} if columns is not None else {})
    source = SheetSource(options | {"path": path})
    if not source.wanted:
        return spark.createDataFrame([], StructType([]))
    return spark.read.format("xlsx").options(**options).load(path)


def excel_day(c: Column) -> Column:
    """The date of a day's number, which counts from 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("double").cast("int"))
