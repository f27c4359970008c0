"""Spreadsheets and word-processor files: one task per file, opened with the standard library.

The files are zip archives of XML. Each file becomes rows of cells; everything after that (header, types,
unions) is done on DataFrames.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import warnings
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .typing import infer_types, na_to_null, typed

# XML name spaces, and the built-in number formats that show dates.
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
SHEET_ROWS = "path string, sheet string, sheet_no int, row_no int, cells array<string>"
WORD_ROWS = "path string, kind string, table_no int, row_no int, header array<string>, cells array<string>"


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _texts(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _column_index(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - ord("A") + 1
    return n - 1


def _date_styles(styles) -> set[int]:
    if styles is None:
        return set()
    custom = {
        int(f.get("numFmtId"))
        for f in styles.iter(SHEET_NS + "numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))
    }
    cell_formats = styles.find(SHEET_NS + "cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cell_formats] if cell_formats is not None else []
    return {i for i, n in enumerate(ids) if n in DATE_FORMATS or n in custom}


def _cell_text(cell, shared: list[str], date_styles: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell, SHEET_NS + "t")
    value = cell.findtext(SHEET_NS + "v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in date_styles:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value))
        return str(moment.replace(microsecond=0) + dt.timedelta(seconds=moment.microsecond >= 500_000))
    return value


def sheet_rows(path: str, content: bytes) -> Iterator[tuple]:
    """(path, sheet, sheet_no, row_no, cells) of one workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings = _xml(archive, "xl/sharedStrings.xml")
        shared = [_texts(s, SHEET_NS + "t") for s in strings] if strings is not None else []
        date_styles = _date_styles(_xml(archive, "xl/styles.xml"))
        targets = {r.get("Id"): r.get("Target") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
        sheets = _xml(archive, "xl/workbook.xml").find(SHEET_NS + "sheets")
        for sheet_no, sheet in enumerate(sheets):
            target = targets[sheet.get(REL_ID)]
            name = target.lstrip("/") if target.startswith("/") else "xl/" + target
            row_no = 0
            for row in _xml(archive, name).iter(SHEET_NS + "row"):
                cells: list[str | None] = []
                for i, cell in enumerate(row):
                    at = _column_index(cell.get("r")) if cell.get("r") else i
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _cell_text(cell, shared, date_styles)
                if any(c is not None for c in cells):
                    yield path, sheet.get("name"), sheet_no, row_no, cells
                    row_no += 1


def _word_cells(row) -> list[str]:
    cells = []
    for cell in row.findall(WORD_NS + "tc"):
        text = "\n".join(_texts(p, WORD_NS + "t") for p in cell.findall(WORD_NS + "p")).strip()
        span = cell.find(f"{WORD_NS}tcPr/{WORD_NS}gridSpan")
        cells += [text] * int(span.get(WORD_NS + "val") if span is not None else 1)
    return cells


def word_rows(path: str, content: bytes) -> Iterator[tuple]:
    """(path, kind, table_no, row_no, header, cells): the table rows of a document, and its paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _xml(archive, "word/document.xml").find(WORD_NS + "body")
    paragraphs = [_texts(p, WORD_NS + "t").strip() for p in body.findall(WORD_NS + "p")]
    for i, text in enumerate((p for p in paragraphs if p), start=1):
        yield path, "paragraph", -1, i, None, [text]
    for table_no, table in enumerate(body.findall(WORD_NS + "tbl")):
        rows = [_word_cells(r) for r in table.findall(WORD_NS + "tr")]
        for row_no, cells in enumerate(rows[1:], start=1):
            yield path, "table", table_no, row_no, rows[0], cells


def _parsed(spark: SparkSession, path, parse, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file_path, content in zip(batch["path"], batch["content"]):
                rows = list(parse(file_path, content))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


@dataclass
class OfficeTable:
    data: DataFrame
    warnings: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> OfficeTable:
    """One sheet of one workbook, the first sheet by default and with a warning when the named one is absent.
    The first row is the header."""
    rows = _parsed(spark, path, sheet_rows, SHEET_ROWS)
    heads = rows.filter("row_no = 0").orderBy("sheet_no").collect()
    if not heads:
        raise ValueError(f"no rows in {path}")
    sheets = [h["sheet"] for h in heads]
    notes = []
    chosen = next((h for h in heads if h["sheet"] == sheet), heads[0])
    if sheet and chosen["sheet"] != sheet:
        notes.append(f"Sheet '{sheet}' not found. Loaded '{chosen['sheet']}'.")
        warnings.warn(notes[-1])
    names: list[str] = []
    for i, cell in enumerate(chosen["cells"]):
        base = name = cell if cell is not None else f"Unnamed: {i}"
        n = 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    body = rows.filter((F.col("sheet_no") == chosen["sheet_no"]) & (F.col("row_no") > 0))
    texts = body.select(*[na_to_null(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)])
    data = typed(texts, infer_types(texts))
    return OfficeTable(data, notes, {"loaded_sheet": chosen["sheet"], "sheet_names": sheets})


def read_docx(spark: SparkSession, path: str) -> OfficeTable:
    """All tables of a document as one table, else its numbered paragraphs."""
    rows = _parsed(spark, path, word_rows, WORD_ROWS)
    tables = rows.filter("kind = 'table'")
    headers = tables.groupBy("table_no").agg(F.first("header").alias("header")).orderBy("table_no").collect()
    if not headers:
        paragraphs = rows.filter("kind = 'paragraph'").select(
            F.col("row_no").alias("paragraph"), F.col("cells")[0].alias("content")
        )
        return OfficeTable(paragraphs, ["No tables found; loaded paragraphs as rows."], {"tables": 0})
    names = list(dict.fromkeys(n for h in headers for n in h["header"]))
    cells = F.map_from_entries(
        F.filter(F.arrays_zip("header", "cells"), lambda e: e["header"].isNotNull())
    )
    merged = tables.withColumn("m", cells)
    data = merged.select(*[F.col("m")[n].alias(n) for n in names])
    return OfficeTable(data, [], {"tables": len(headers)})
