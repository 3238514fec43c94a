"""Sources: plain text, DOCX and rule files, from folders that Spark reads.

Files are read whole by Spark's binaryFile source, so any store that Spark knows will do; what is in one is parsed in
batches on the executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that can be read; PDF takes a hook (``parse_with``), as its text needs a library that isn't here.
EXTENSIONS = ("txt", "docx", "pdf")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
UNIT_SCHEMA = (
    "path string, unit_id string, part_name string, unit_type string, container_type string, text string, order_index int, "
    "table_index int, row_index int, col_index int, page_no int, rewritable boolean, fragment_count int"
)


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, extension, length and content of all files of known extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "length", "content").where(F.col("extension").isin(*EXTENSIONS))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if they are that, else GBK, else UTF-16; null if none of them."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        def one(value: bytes | None) -> str | None:
            for charset in ("utf-8-sig", "gbk", "gb2312", "utf-16"):
                try:
                    return bytes(value).decode(charset)
                except (UnicodeDecodeError, TypeError):
                    continue
            return None

        return values.map(one)

    # the JVM knows valid UTF-8; only other files go to Python
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(decode(content))


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of the .txt files; bytes that no charset reads fail the query, and files without bytes have no row."""
    text = decoded(F.col("content"))
    return scan(spark, folder).where("extension = 'txt'").select("path", F.coalesce(text, F.raise_error(F.concat(F.lit("no known charset: "), "path"))).alias("text"))


def _paragraph(node: ElementTree.Element) -> tuple[str, int]:
    """Visible text and number of runs of text; deleted text isn't visible, inserted text is."""
    out, runs = [], 0
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
            runs += 1
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out), runs


PARTS = (("word/document.xml", "body"), ("word/header", "header"), ("word/footer", "footer"), ("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote"), ("word/comments.xml", "comment"))


def story_of(name: str, data: bytes) -> str | None:
    """The story of a part of a package: by its name, or xml_text for another one that shows text; None for parts that show none."""
    if not name.startswith("word/") or not name.endswith(".xml"):
        return None
    return next((s for prefix, s in PARTS if name.startswith(prefix)), "xml_text" if re.search(rb"<(?:\w+:)?t[ >]", data) else None)


def docx_units(path: str, content: bytes) -> Iterator[dict]:
    """Units of visible text of a DOCX package: paragraphs and table cells of the body, headers, footers, notes, comments."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        order, tables, page = 0, 0, 1
        names = sorted(package.namelist(), key=lambda n: (n != "word/document.xml", n))
        for name in names:
            data = package.read(name)
            story = story_of(name, data)
            if story is None:
                continue
            root = ElementTree.fromstring(data)  # noqa: S314
            in_cell: dict[ElementTree.Element, tuple[int, int, int]] = {}
            for table in root.iter(f"{W}tbl"):
                for r, row in enumerate(table.findall(f"{W}tr")):
                    for c, cell in enumerate(row.findall(f"{W}tc")):
                        for p in cell.findall(f"{W}p"):
                            in_cell[p] = (tables, r, c)
                tables += 1
            for p in root.iter(f"{W}p"):
                if any(b.get(f"{W}type") == "page" for b in p.iter(f"{W}br")) and name == "word/document.xml":
                    page += 1
                text, runs = _paragraph(p)
                if not text.strip():
                    continue
                place = in_cell.get(p)
                yield {
                    "path": path, "unit_id": f"{name}#{order}", "part_name": name, "unit_type": "table_cell" if place else "paragraph",
                    "container_type": "table_cell" if place else story, "text": text, "order_index": order,
                    "table_index": place[0] if place else None, "row_index": place[1] if place else None, "col_index": place[2] if place else None,
                    "page_no": page if story == "body" else None, "rewritable": runs > 0, "fragment_count": runs,
                }
                order += 1


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """Units of all DOCX files of a folder, in the order they are read; a file that isn't a package has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.extend(docx_units(path, bytes(content)))
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in UNIT_SCHEMA.split(", ")])
            yield frame.astype({c: "Int32" for c in ("order_index", "table_index", "row_index", "col_index", "page_no", "fragment_count")})

    return scan(spark, folder).where("extension = 'docx'").select("path", "content").mapInPandas(run, UNIT_SCHEMA)


def damaged_docx(spark: SparkSession, folder: str) -> DataFrame:
    """path and reason of the DOCX files of a folder that can't be read, which read_docx has no units of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    list(docx_units(path, bytes(content)))
                except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "reason"])

    return scan(spark, folder).where("extension = 'docx'").select("path", "content").mapInPandas(run, "path string, reason string")


def parse_with(spark: SparkSession, folder: str, extension: str, parse: object, schema: str) -> DataFrame:
    """Files of an extension by a parser of your own (path, bytes) -> rows: PDF text layers, OCR and the like plug in here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for path, content in zip(batch["path"], batch["content"], strict=True) for row in parse(path, bytes(content))], columns=[c.split()[0] for c in re.split(r",\s*", schema)])

    return scan(spark, folder).where(F.col("extension") == extension).select("path", "content").mapInPandas(run, schema)


def needs_ocr(text: Column) -> Column:
    """Fewer than 80 characters, or fewer than 45 % of them letters or digits."""
    plain = F.regexp_replace(text, r"(?U)\s", "")
    readable = F.length(F.regexp_replace(plain, "[^一-龥A-Za-z0-9]", ""))
    return (F.length(plain) < 80) | (readable < 0.45 * F.length(plain))


def read_rules(spark: SparkSession, path: str) -> tuple[list[dict], dict[str, tuple[list[str], float]]]:
    """Custom rules of a JSON file: patterns, and keywords by type. The file is configuration, so it fits the driver."""
    import json

    whole = spark.read.text(path, wholetext=True).first()
    rules = json.loads(whole[0]) if whole else {}
    words = {k.strip().upper(): ([w for w in v.get("keywords", []) if w.strip()], float(v.get("score", 0.9))) for k, v in rules.get("keywords", {}).items()}
    return list(rules.get("patterns", [])), words


def pages_of(units: DataFrame) -> DataFrame:
    """Pages of units with places: doc_id, page_no, start, end, n_units."""
    return units.groupBy("doc_id", "page_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"))


def estimated_pages(chars: Column, in_properties: Column, breaks: Column, per_page: int = 900) -> Column:
    """Pages of a document: by its properties and page breaks if it has any, else by its characters; at least one."""
    return F.greatest(F.lit(1), F.when(in_properties > 0, F.greatest(in_properties, breaks)).when(breaks > 0, breaks).otherwise(F.round(chars / per_page).cast("int")))
