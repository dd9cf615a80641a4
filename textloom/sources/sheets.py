"""Excel workbooks as a data source: a row for each row of a sheet, a partition for each sheet, rows as they stream by.

    spark.dataSource.register(Workbook)
    spark.read.format("workbook").option("path", path).load()

The source opens files with pyarrow, so the path must be one that it knows and that driver and executors share;
`workbooks` takes any folder that Spark itself reads, a task for each file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "path string, sheet string, row_no int, cells array<string>"
BATCH_ROWS = 2000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """A1 is column 0, AB7 is 27."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(node: ET.Element) -> str:
    """All runs of a string, without phonetic hints."""
    return "".join(t.text or "" for child in node for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else []))


def sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """The names of a workbook's sheets in their order, and the member that holds each."""
    links = {e.get("Id"): e.get("Target") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    member = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), member(links[s.get(_LINK)])) for s in sheets]


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ET.iterparse(stream):
            if node.tag == f"{_MAIN}si":
                found.append(_text(node))
                node.clear()
    return found


def _value(cell: ET.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return _text(inline) if inline is not None else None
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "TRUE" if value.text == "1" else "FALSE"
    return value.text


def rows(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of each row of a sheet that has cells, read as the file streams by; cells left out are null."""
    shared = shared_strings(book)
    with book.open(member) as stream:
        number = 0
        for _, node in ET.iterparse(stream):
            if node.tag != f"{_MAIN}row":
                continue
            number = int(node.get("r") or number + 1)
            cells: list[str | None] = []
            for cell in node.iter(f"{_MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                cells[at:] = [_value(cell, shared)]
            if cells:
                yield number, cells
            node.clear()


class _Sheet(InputPartition):
    def __init__(self, path: str, name: str, member: str):
        self.path, self.name, self.member = path, name, member


def _opened(path: str):
    import pyarrow.fs as fs

    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.only = [p for p in options["path"].split(",") if p], options.get("sheet")

    def partitions(self) -> list[_Sheet]:
        found = []
        for path in self.paths:
            with _opened(path) as file, zipfile.ZipFile(file) as book:
                found += [_Sheet(path, name, member) for name, member in sheet_names(book) if self.only in (None, name)]
        return found

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as file, zipfile.ZipFile(file) as book:
            held: list[tuple[int, list[str | None]]] = []
            for row in rows(book, partition.member):
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield self._batch(partition, held)
                    held = []
            if held:
                yield self._batch(partition, held)

    def _batch(self, partition: _Sheet, held: list) -> pa.RecordBatch:
        n = len(held)
        return pa.record_batch({
            "path": pa.array([partition.path] * n), "sheet": pa.array([partition.name] * n),
            "row_no": pa.array([r for r, _ in held], pa.int32()), "cells": pa.array([c for _, c in held], pa.list_(pa.string())),
        })


class Workbook(DataSource):
    """Options: path (one file, or several with commas between them), sheet (one by its name)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, sheet, row_no and cells of the rows of one or more workbooks."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook").option("path", path)
    return (reader.option("sheet", sheet) if sheet else reader).load()


def workbooks(spark: SparkSession, root: str, glob: str = "*.xlsx") -> DataFrame:
    """The same for all workbooks under a folder of any store that Spark reads: a row's file comes whole to its task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    for name, member in sheet_names(book):
                        held = [*rows(book, member)]
                        for at in range(0, len(held), BATCH_ROWS):
                            yield _Reader({"path": ""})._batch(_Sheet(path, name, member), held[at : at + BATCH_ROWS])

    return files.select("path", "content").mapInArrow(run, ROWS)
