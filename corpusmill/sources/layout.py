"""Layout, tables and contents of paged files as rows.

A reader is a factory without arguments, called once a task, that gives a function from a file's bytes to pages: dicts with
`lines` (dicts x0, top, x1, text, size, font), `tables` (dicts top and rows, each a list of cells or null) and, on the first
page, `contents` (level, title, page). `pdf_reader` is one for PDF files; any other format is read through one of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "document string, page int, ord int, x double, y double, x1 double, text string, size double, font string"
TABLES = "document string, page int, table int, row int, top double, cells array<string>"
CONTENTS = "document string, ord bigint, level int, title string, page int"


def pdf_reader() -> Callable:
    """Pages of a PDF file by pdfplumber, and its contents by pypdf; the executors must have both."""
    import io

    import pdfplumber
    import pypdf

    def entries(pdf, items, level=1):
        for x in items:
            if isinstance(x, list):
                yield from entries(pdf, x, level + 1)
            else:
                yield level, x.title, pdf.get_destination_page_number(x) + 1

    def read(content: bytes):
        outline = pypdf.PdfReader(io.BytesIO(content))
        contents = list(entries(outline, outline.outline))
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for page in pdf.pages:
                lines = []
                for x in page.extract_text_lines(return_chars=True):
                    first = x["chars"][0]
                    lines.append({"x0": x["x0"], "top": x["top"], "x1": x["x1"], "text": x["text"], "size": first["size"], "font": first["fontname"]})
                tables = [{"top": t.bbox[1], "rows": t.extract()} for t in page.find_tables()]
                yield {"lines": lines, "tables": tables, "contents": contents}

    return read


def _pages(spark: SparkSession, path: str, reader: Callable, rows: Callable, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        read = reader()
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for number, page in enumerate(read(content), start=1):
                    if own := [(name, *r) for r in rows(number, page)]:
                        yield pd.DataFrame(own, columns=names)

    return files.mapInPandas(run, schema)


def read_lines(spark: SparkSession, path: str, reader: Callable = pdf_reader) -> DataFrame:
    """document, page, ord (from 1 on a page), x, y, x1, text, size, font of every line."""

    def rows(number, page):
        for i, x in enumerate(page.get("lines", ()), start=1):
            yield number, i, float(x["x0"]), float(x["top"]), float(x.get("x1", x["x0"])), x["text"], float(x["size"]), x["font"]

    return _pages(spark, path, reader, rows, LINES)


def read_tables(spark: SparkSession, path: str, reader: Callable = pdf_reader) -> DataFrame:
    """document, page, table, row (both from 0), top and cells of every table row; a missing cell is null."""

    def rows(number, page):
        for t, table in enumerate(page.get("tables", ())):
            for r, cells in enumerate(table["rows"]):
                yield number, t, r, float(table["top"]), list(cells)

    return _pages(spark, path, reader, rows, TABLES)


def read_contents(spark: SparkSession, path: str, reader: Callable = pdf_reader) -> DataFrame:
    """document, ord, level, title, page of the table of contents; page is where an entry points to."""

    def rows(number, page):
        for i, (level, title, at) in enumerate(page.get("contents", ()) if number == 1 else (), start=1):
            yield i, int(level), title, int(at)

    return _pages(spark, path, reader, rows, CONTENTS)


def inspection(lines: DataFrame, contents: DataFrame) -> DataFrame:
    """A row a document: pages with text, characters, the least and most of such a page, bookmarks, and whether sections can follow them."""
    pages = lines.groupBy("document", "page").agg(F.sum(F.length("text")).alias("n")).where("n > 0")
    per = pages.groupBy("document").agg(F.count("*").alias("pages_with_text"), F.sum("n").alias("characters"), F.min("n").alias("least"), F.max("n").alias("most"))
    marks = contents.groupBy("document").agg(F.count("*").alias("bookmarks"))
    out = per.join(marks, "document", "full").fillna(0, ["pages_with_text", "characters", "bookmarks"])
    return out.withColumn("sections_follow", F.col("bookmarks") > 0)
