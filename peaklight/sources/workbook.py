"""Spreadsheets (zipped XML workbooks) as a data source: a partition for each workbook, its cells streamed row by row."""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The two forms of a workbook's main name space and that of its relations.
MAIN = ("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://purl.oclc.org/ooxml/spreadsheetml/main}")
RELATION = ("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", "{http://purl.oclc.org/ooxml/officeDocument/relationships}id")
SCHEMA = "path string, sheet string, line long, cells array<string>, error string"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def column_number(reference: str) -> int:
    """The place of a column from 0, of a cell's reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def events(book: zipfile.ZipFile, name: str, kinds: tuple[str, ...] = ("end",)) -> Iterator[tuple[str, ElementTree.Element]]:
    """Elements of a part of a workbook while it is read; one that declares entities isn't read, for they could grow without end."""
    with book.open(name) as part:
        head = part.peek(4096)[:4096] if hasattr(part, "peek") else b""
        if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
            raise ValueError(f"{name} declares a document type")
        yield from ElementTree.iterparse(part, kinds)


def text_of(element: ElementTree.Element) -> str:
    """The text of a string item: its own and that of its runs, without the readings that may stand beside them."""
    out = []
    for child in element:
        if local(child.tag) == "t":
            out.append(child.text or "")
        elif local(child.tag) == "r":
            out += [t.text or "" for t in child if local(t.tag) == "t"]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(out))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    name, out = "xl/sharedStrings.xml", []
    if name in book.namelist():
        for _, e in events(book, name):
            if local(e.tag) == "si":
                out.append(text_of(e))
                e.clear()
    return out


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets in their order, with the parts that hold them."""
    targets = {e.get("Id"): e.get("Target") for _, e in events(book, "xl/_rels/workbook.xml.rels") if local(e.tag) == "Relationship"}
    out = []
    for _, e in events(book, "xl/workbook.xml"):
        if local(e.tag) == "sheet":
            target = targets.get(next((e.get(r) for r in RELATION if e.get(r)), ""))
            if target:
                out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def rows_of(book: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(line from 0, cells) of a sheet; cells that aren't there are None, numbers stand as they are written, truth values as TRUE and FALSE."""
    line, cells = -1, []
    for event, e in events(book, part, ("start", "end")):
        kind = local(e.tag)
        if event == "start":
            if kind == "row":
                line, cells = int(e.get("r")) - 1 if e.get("r") else line + 1, []
            continue
        if kind == "c":
            at = column_number(e.get("r")) if e.get("r") else len(cells)
            cells += [None] * (at - len(cells))
            value = next((v.text for v in e if local(v.tag) == "v"), None)
            form = e.get("t", "n")
            if form == "inlineStr":
                value = next((text_of(v) for v in e if local(v.tag) == "is"), None)
            elif value is not None and form == "s":
                value = strings[int(value)]
            elif value is not None and form == "b":
                value = "TRUE" if value.strip() == "1" else "FALSE"
            cells[at:] = [value]
        elif kind == "row":
            yield line, cells
            e.clear()


class Workbook(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    """Plans a task for each workbook; a task reads one through the file system that its address names."""

    def __init__(self, options: dict):
        self.at, self.glob, self.sheet = options.get("path", ""), options.get("pathglobfilter", "*.xlsx"), options.get("sheet")
        self.strict = options.get("mode", "permissive").lower() == "failfast"

    def _open(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.at) if ":/" in self.at else (pafs.LocalFileSystem(), self.at)

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, path = self._open()
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.at)
        if info.type == pafs.FileType.File:
            return [Workbook(path)]
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        # Files that an open program keeps beside a workbook begin with ~$.
        return [Workbook(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob) and not f.base_name.startswith(("~$", "."))] or [Workbook("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = self._open()
        try:
            with fs.open_input_file(partition.path) as source, zipfile.ZipFile(io.BufferedReader(source) if not hasattr(source, "seek") else source) as book:
                strings = shared_strings(book)
                for name, part in sheets(book):
                    if self.sheet is None or name == self.sheet:
                        for line, cells in rows_of(book, part, strings):
                            yield partition.path, name, line, cells, None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, OSError) as e:
            if self.strict:
                raise
            yield partition.path, None, None, None, f"{type(e).__name__}: {e}"


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(file or folder): path, sheet, line, cells, error.

    Options: ``pathGlobFilter`` (*.xlsx) for the files of a folder, ``sheet`` for one sheet alone, ``mode``: "permissive" gives a row with an error
    behind the rows that could be read of a broken workbook, "failfast" ends the job.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()})


def read_workbooks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The cells of one workbook or of all in a folder."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").options(**options).load(path)
