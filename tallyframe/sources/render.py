"""Statement files as bytes: CSV, XLSX and JSON, the same bytes from every run. One row (path, content) for each file, so that
what is rendered can be read back by sources.grid without touching a disk, or be saved by whoever holds the folder."""

from __future__ import annotations

import io
import os
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: When every entry of a workbook's archive was written, as far as it says.
_EPOCH = (1980, 1, 1, 0, 0, 0)


def _quoted(cell: Column, delimiter: str) -> Column:
    return F.when(cell.rlike(f'["\\n\\r{delimiter}]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _gathered(rows: DataFrame) -> DataFrame:
    """One row for each file: sheet, and its records, the header first. A file is held by one task, as by whoever opens it."""
    records = F.array_sort(F.collect_list(F.struct("row_index", "cells")))
    return rows.groupBy("content_hash").agg(F.min("sheet").alias("sheet"), F.min("headers").alias("headers"), records.alias("r")).select("sheet", F.concat(F.array("headers"), F.transform("r", lambda r: r["cells"])).alias("records"))


def csv_files(rows: DataFrame, delimiter: str = ",", bom: bool = False) -> DataFrame:
    """(path, content) of rows as of sources.grid: a line feed ends each record; cells are quoted only where they must be."""
    line = lambda r: F.array_join(F.transform(r, lambda c: _quoted(c, delimiter)), delimiter)
    text = F.concat(F.lit("﻿" if bom else ""), F.array_join(F.transform("records", line), "\n"), F.lit("\n"))
    return _gathered(rows).select(F.concat("sheet", F.lit(".csv")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def _workbook(sheet: str, records: list[list[str]]) -> bytes:
    cells = ("".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in r) for r in records)
    body = _SHEET + "".join(f'<row r="{n}">{c}</row>' for n, c in enumerate(cells, 1)) + "</sheetData></worksheet>"
    book = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in sorted((_PARTS | {"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": body}).items()):
            archive.writestr(zipfile.ZipInfo(name, _EPOCH), text)
    return out.getvalue()


def xlsx_files(rows: DataFrame) -> DataFrame:
    """(path, content) of rows as of sources.grid: one sheet, every cell text."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sheet, records = batch.column("sheet")[i].as_py(), batch.column("records")[i].as_py()
                yield pa.RecordBatch.from_pydict({"path": [f"{sheet}.xlsx"], "content": pa.array([_workbook(sheet, records)], pa.binary())})

    return _gathered(rows).mapInArrow(run, "path string, content binary")


def json_files(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(path, content): one JSON document for each value of a column, its rows in their order with amounts as text."""
    shown = [F.col(c).cast("string").alias(c) if dict(rows.dtypes)[c].startswith("decimal") else F.col(c) for c in columns]
    found = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("row_index", F.struct(*shown).alias("row")))).alias("r"))
    return found.select(F.concat(by, F.lit(".truth.json")).alias("path"), F.encode(F.to_json(F.struct(F.col(by), F.transform("r", lambda x: x["row"]).alias("rows"))), "UTF-8").alias("content"))


def read_json(files: DataFrame, schema: str) -> DataFrame:
    """What json_files() wrote, as one row for each document."""
    return files.select(F.from_json(F.decode("content", "UTF-8"), schema).alias("x")).select("x.*")


def save(files: DataFrame, folder: str) -> int:
    """Write a few files into a folder of this machine, one after the other, as for a test; how many there were."""
    n = 0
    for r in files.toLocalIterator():
        with open(os.path.join(folder, r["path"]), "wb") as f:
            f.write(bytes(r["content"]))
        n += 1
    return n


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash) of the bytes of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("content_hash"))
