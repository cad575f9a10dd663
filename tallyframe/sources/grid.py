"""Statement files as cells: CSV and XLSX, all text, with the file's hash and each cell's coordinates.

`spark.read.format("binaryFile")` lists and reads the files, on any store; each file is cut into records inside its task.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import sys
import zipfile
from array import array
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, content_hash string, sheet string, headers array<string>, row_index long, spreadsheet_row long, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def clean(value: str) -> str:
    """A spreadsheet number without a binary tail: six decimals at most, no needless zeros."""
    if re.fullmatch(r"-?\d+\.\d+(?:[eE][-+]?\d+)?|-?\d+[eE][-+]?\d+", value):
        number = float(value)
        return str(int(number)) if number.is_integer() else f"{number:f}".rstrip("0").rstrip(".")
    return value.strip()


def csv_records(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of the records with a non-blank cell; the delimiter is `;` if the first line has more of them."""
    first = content.split(b"\n", 1)[0]
    csv.field_size_limit(sys.maxsize)
    text = io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline="")
    for i, record in enumerate(csv.reader(text, delimiter=";" if first.count(b";") > first.count(b",") else ","), 1):
        cells = [c.strip() for c in record]
        if any(cells):
            yield i, cells


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class _Strings:
    """A workbook's shared strings as one run of bytes and where each ends."""

    def __init__(self) -> None:
        self.data, self.ends = bytearray(), array("q", [0])

    def add(self, text: str) -> None:
        self.data += text.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        return self.data[self.ends[i] : self.ends[i + 1]].decode("utf-8", "surrogatepass")


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Each element of a tag as it ends; it is gone from the tree when the next one is read."""
    with book.open(part) as file:
        above: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(file, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == tag:
                yield element
                if above:
                    above[-1].remove(element)


def xlsx_records(content: bytes, sheet: str | None = None) -> tuple[str, Iterator[tuple[int, list[str]]]]:
    """The named sheet's name, an error if it is absent, or the first one's, and (number, cells) of its records with a non-blank
    cell; values, not formulas. A sheet is read row by row: what is in memory is a row and the shared strings."""
    book = zipfile.ZipFile(io.BytesIO(content))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    name, target = sheets[0] if sheet is None else next((s for s in sheets if s[0] == sheet), (sheet, None))
    if target is None:
        raise ValueError(f"no sheet is named {sheet!r}")
    return name, _sheet_records(book, "xl/" + target.removeprefix("/xl/"))


def _sheet_records(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str]]]:
    shared = _Strings()
    if "xl/sharedStrings.xml" in book.namelist():
        for s in _elements(book, "xl/sharedStrings.xml", f"{_MAIN}si"):
            shared.add("".join(t.text or "" for t in s.iter(f"{_MAIN}t")))
    number = 0
    for row in _elements(book, part, f"{_MAIN}row"):
        number = int(row.get("r") or number + 1)
        cells: list[str] = []
        for c in row.iter(f"{_MAIN}c"):
            at, kind, value = _column(c.get("r") or "") if c.get("r") else len(cells), c.get("t"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            else:
                text = "" if value is None else value.text or ""
                text = shared[int(text)] if kind == "s" and text else clean(text) if kind in (None, "n") else text
            cells += [""] * (at + 1 - len(cells))
            cells[at] = text.strip()
        if any(cells):
            yield number, cells


def read_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One row for each data record of each file under path: the file's hash, sheet, headers and cells.

    The first record with a value is the header; row_index counts data records from 0, spreadsheet_row is the record's true number
    in its file, blank ones counted.
    Short records are padded with empty cells. The sheet of a CSV file is its name without the ending. A file is read in one
    task and is at most 2 GB, the limit of a binary value; ranges.read_ranges() reads CSV files of any size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows_of(files, sheet)


def rows_of(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """read_rows() of files (path, content) that are there as bytes, such as those of a stream's batch."""
    files = files.select("path", F.sha2("content", 256).alias("content_hash"), "content")

    def run(batches):
        for batch in batches:
            for p, digest, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content_hash", "content")), strict=True):
                if p.lower().endswith((".xlsx", ".xlsm")):
                    name, records = xlsx_records(content, sheet)
                else:
                    name, records = p.rsplit("/", 1)[-1].rsplit(".", 1)[0], csv_records(content)
                _, headers = next(records, (0, None))
                if headers is None:
                    continue
                at = 0
                for some in itertools.batched(records, 10_000):
                    n = len(some)
                    yield pa.RecordBatch.from_pydict({
                        "path": [p] * n, "content_hash": [digest] * n, "sheet": [name] * n, "headers": pa.array([headers] * n, pa.list_(pa.string())),
                        "row_index": pa.array(range(at, at + n), pa.int64()), "spreadsheet_row": pa.array([i for i, _ in some], pa.int64()),
                        "cells": pa.array([c + [""] * (len(headers) - len(c)) for _, c in some], pa.list_(pa.string())),
                    })
                    at += n

    return files.mapInArrow(run, ROWS)


def to_cells(rows: DataFrame) -> DataFrame:
    """Long form: a row for each cell under a header; of equal headers the first column counts, as in cell()."""
    numbered = rows.select("content_hash", "sheet", "row_index", "spreadsheet_row", "headers", "cells", F.posexplode(F.when(F.col("cells").isNotNull(), F.col("headers"))).alias("col_index", "header"))
    first = numbered.where(F.array_position("headers", F.col("header")) == F.col("col_index") + 1)
    return first.select("content_hash", "sheet", "row_index", "spreadsheet_row", "col_index", "header", F.coalesce(F.get("cells", "col_index"), F.lit("")).alias("raw"))


def cell(header: str | Column) -> Column:
    """The cell under the first column with a header; empty if there is none or the record is short."""
    return F.coalesce(F.get("cells", F.array_position("headers", header).cast("int") - 1), F.lit(""))
