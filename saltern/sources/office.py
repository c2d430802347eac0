"""Word and Excel files as pages and as rows of cells: zipped XML, read in Arrow batches of files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.functions.text import page_text
from saltern.operators.warehouse import HEADER_ROW, QTY_HEADER, SKU_HEADER, name_column, optional_column
from saltern.sources.tables import csv_text, files

#: Characters of a page at most, from which a section stands alone, and at least.
PAGE, SECTION, LEAST = 12_000, 80, 40
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in node.iter()).strip()


def word_parts(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a Word file's body: headings and paragraphs in order, then its tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body, styles = _xml(archive, "word/document.xml").find(f"{_W}body"), _xml(archive, "word/styles.xml")
    names = {} if styles is None else {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val", "").lower() for s in styles.iter(f"{_W}style") if s.find(f"{_W}name") is not None}
    out = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = "" if style is None else names.get(style.get(f"{_W}val"), style.get(f"{_W}val", "").lower())
        if text := _text(p):
            out.append(("heading" if "heading" in name or name.startswith("title") else "text", text))
    for table in body.findall(f"{_W}tbl"):
        rows = [[_text(c) for c in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]
        out.append(("text", "\n".join(["[TABLE]", *(" | ".join(r) for r in rows if any(r)), "[/TABLE]"])))
    return out


def word_pages(parts: list[tuple[str, str]]) -> list[str]:
    """Sections under their headings, short ones put together, none over a page."""
    tidy = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub("[ \t ]+", " ", t)).strip()
    sections, title = [], None
    for kind, group in groupby(parts, key=lambda p: p[0]):
        texts = [t for _, t in group]
        if kind == "heading":
            title = texts[-1]
        elif len(body := "\n".join(texts).strip()) >= LEAST:
            sections.append(tidy((f"# {title}\n\n" if title else "") + body))
    if not sections and (whole := tidy("\n".join(t for k, t in parts if k == "text"))):
        sections = [whole]
    pages, held = [], ""
    for section in sections:
        if len(held) + len(section) > PAGE:
            if held:
                pages.append(held)
                held = section[:PAGE]
            else:
                pages.append(section[:PAGE])
            continue
        held = f"{held}\n\n{section}".strip()
        if len(held) >= SECTION:
            pages.append(held)
            held = ""
    return [p for p in [*pages, held] if len(p) >= LEAST]


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind, value = c.get("t"), c.findtext(f"{_X}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_X}t")).strip()
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)].strip()
    if kind == "b":
        return str(value == "1")
    if kind in ("str", "e"):
        return value.strip()
    return str(float(value)) if re.search("[.eE]", value) else value.strip()


def sheet_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet, row, cells) of an Excel file's rows with any cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings, book, links = _xml(archive, "xl/sharedStrings.xml"), _xml(archive, "xl/workbook.xml"), _xml(archive, "xl/_rels/workbook.xml.rels")
        shared = [] if strings is None else ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in strings.findall(f"{_X}si")]
        target = {r.get("Id"): r.get("Target") for r in links}
        key = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        for number, sheet in enumerate(book.iter(f"{_X}sheet")):
            path = target[sheet.get(key)]
            own = _xml(archive, path.lstrip("/") if path.startswith("/") else f"xl/{path}")
            for at, row in enumerate(own.iter(f"{_X}row")):
                cells: list[str] = []
                for c in row.findall(f"{_X}c"):
                    column = 0
                    for letter in re.match("[A-Z]*", c.get("r", "")).group():
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    cells.append(_cell(c, shared))
                if any(cells):
                    yield number, sheet.get("name"), at, cells


def docx_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pdf_page, text) of a folder's Word files, a page for each section. Broken files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    pages = word_pages(word_parts(content))
                except (zipfile.BadZipFile, ElementTree.ParseError, AttributeError):
                    pages = []
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(pages), pa.string()), "pdf_page": pa.array(range(1, len(pages) + 1), pa.int32()), "text": pa.array(pages, pa.string())})

    return files(spark, path, "*.docx").select("doc_id", "content").mapInArrow(run, "doc_id string, pdf_page int, text string")


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sheet_no, sheet, pos, cells) of a folder's Excel files. Broken files have no rows."""
    names = ["doc_id", "sheet_no", "sheet", "pos", "cells"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(doc, *r) for r in sheet_rows(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, AttributeError, KeyError, TypeError):
                    rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return files(spark, path, "*.xlsx").select("doc_id", "content").mapInArrow(run, "doc_id string, sheet_no int, sheet string, pos long, cells array<string>")


def xlsx_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pdf_page, text): each sheet as a table, cut into pages."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array_join("cells", " | ").alias("line")))), lambda x: x["line"])
    sheets = xlsx_rows(spark, path).groupBy("doc_id", "sheet_no", "sheet").agg(lines.alias("lines"))  # a sheet is part of one file
    text = page_text(F.concat_ws("\n", F.concat(F.lit("# "), "sheet"), F.lit("[TABLE]"), F.array_join("lines", "\n"), F.lit("[/TABLE]")))
    starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / PAGE).cast("int"))
    parts = sheets.withColumn("text", text).filter(F.char_length("text") >= LEAST).select("doc_id", "sheet_no", F.posexplode(F.transform(starts, lambda k: F.col("text").substr(k * PAGE + 1, F.lit(PAGE)))).alias("part", "text"))
    parts = parts.filter(F.char_length("text") >= LEAST)
    pages = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sheet_no", "part", "text"))).alias("pages"))
    return pages.select("doc_id", F.posexplode("pages").alias("at", "p")).select("doc_id", (F.col("at") + 1).alias("pdf_page"), F.col("p.text").alias("text"))


def upload(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw_name, sku, qty) of an inventory, as text: one CSV file, or the first sheet of one Excel
    file, whose header is the first of its first fifteen rows that names a material."""
    if path.lower().endswith(".csv"):
        rows = csv_text(spark, path)
        columns = [c for c in rows.columns if c != "pos"]
        pick = lambda c: F.col(f"`{c}`")
    else:
        folder, _, name = path.rpartition("/")
        rows = xlsx_rows(spark, folder).filter((F.col("sheet_no") == 0) & (F.col("doc_id") == re.sub("[^a-z0-9]+", "_", name.rpartition(".")[0].lower()).strip("_")))
        head = rows.orderBy("pos").limit(15).collect()  # fifteen rows
        if not head:
            return spark.createDataFrame([], "pos long, raw_name string, sku string, qty string")
        header = next((r for r in head if re.search(HEADER_ROW, " ".join(r["cells"]))), head[0])
        columns = list(header["cells"])
        rows = rows.filter(F.col("pos") > header["pos"])
        pick = lambda c: F.get("cells", F.lit(columns.index(c)))
    chosen: list[Column] = []
    for c, alias in ((name_column(columns), "raw_name"), (optional_column(columns, SKU_HEADER), "sku"), (optional_column(columns, QTY_HEADER), "qty")):
        value = pick(c) if c is not None else F.lit(None)
        chosen.append(F.nullif(value.cast("string"), F.lit("")).alias(alias))
    return rows.select("pos", *chosen)
