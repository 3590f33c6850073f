"""Folders of text, Word, PowerPoint and PDF files as one table: path, source, kind, text, pages, error."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are read as plain text, besides files without any.
TEXT = frozenset("""
txt text md markdown mdx rst adoc asciidoc org tex bib log csv tsv psv json jsonl ndjson geojson yaml yml toml ini cfg conf
properties env xml xsd xsl html htm xhtml svg css scss less js mjs cjs ts tsx jsx vue py pyi pyx ipynb rb php pl pm lua r jl go rs
c h cc cpp cxx hpp cs java kt kts scala swift m sh bash zsh fish ps1 bat cmd sql graphql proto dockerfile makefile cmake gradle
diff patch srt vtt eml
""".split())  # fmt: skip
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PAGE = "\f"  # between pages or slides


def _runs(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def docx_text(data: bytes) -> str:
    """Paragraphs, and table rows as cells joined by ' | ', in the order of the document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            out.append(_runs(node, f"{_W}t"))
        elif node.tag == f"{_W}tbl":
            out += [" | ".join(_runs(c, f"{_W}t").strip() for c in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
    return "\n\n".join(x.strip() for x in out if x.strip(" |"))


def pptx_text(data: bytes) -> str:
    """The paragraphs of each slide, then its notes as '[Notes] ...'; slides are separated by form feeds."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((int(m.group(1)), m.group()) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in names) if m)
        out = []
        for number, name in slides:
            lines = [_runs(p, f"{_A}t").strip() for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p")]
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            if notes in names:
                said = " ".join(filter(None, (_runs(p, f"{_A}t").strip() for p in ElementTree.fromstring(z.read(notes)).iter(f"{_A}p"))))
                lines += [f"[Notes] {said}"] if said else []
            out.append("\n\n".join(filter(None, lines)))
    return f"\n{PAGE}\n".join(out)


def pdf_text(data: bytes) -> str:
    """Pages by PyMuPDF, which is optional; without it a PDF is an error row."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return f"\n{PAGE}\n".join(page.get_text() for page in doc)


def clean_pdf(text: Column | str) -> Column:
    """Text of a PDF without page numbers and hyphens at line ends; lines of a paragraph in one, at most two blank lines."""
    c = F.col(text) if isinstance(text, str) else text
    for rule, new in ((r"\n{4,}", "\n\n\n"), (r"(?m)^[ \t]*\d+[ \t]*$", ""), (r"(\w)-\n(\w)", "$1$2"), (r"[ \t]+", " "), (r"(?m)^ | $", ""), (r"(?<!\n)\n(?!\n)", " ")):
        c = F.regexp_replace(c, rule, new)
    return F.trim(c)


_READERS = {"docx": docx_text, "pptx": pptx_text, "pdf": pdf_text}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, kind, data in zip(b["path"], b["kind"], b["content"], strict=True):
            text, error = None, None
            try:
                text = _READERS[kind](data) if kind in _READERS else bytes(data).decode("utf-8")
            except Exception as e:  # noqa: BLE001  one bad file is a row, not the end of the job
                error = f"{type(e).__name__}: {e}"
            rows.append((path, kind, text, error))
        yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])


def read_folder(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, source (file name), kind, text, error of every readable file below `folder`.

    Files of other kinds aren't read.  Text that isn't UTF-8, and files that can't be parsed, have an error; blank ones
    have neither text nor error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    d = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    d = d.select("path", suffix.alias("kind"), "content").filter(F.col("kind").isin("", *_READERS, *TEXT))
    t = d.mapInPandas(_parse, "path string, kind string, text string, error string")
    text = F.when(F.col("kind") == "pdf", clean_pdf("text")).otherwise(F.col("text"))
    return t.select("path", name.alias("source"), "kind", F.when(text.rlike(r"\S"), text).alias("text"), "error")


def with_pages(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Chunk claims with the slot page_start: the page, from 1, on which the chunk's first paragraph (of it
    100 characters) begins.

    files: source, text with form feeds between pages.  A chunk whose start isn't found there has no page.
    """
    at = F.instr(F.col("whole"), F.substring(F.substring_index("assertion", "\n\n", 1), 1, 100))
    page = F.size(F.split(F.substring(F.col("whole"), F.lit(1), at), PAGE))
    d = claims.join(files.select("source", F.col("text").alias("whole")), "source", "left")
    slots = F.when(at > 0, F.map_concat("slots", F.create_map(F.lit("page_start"), page.cast("string")))).otherwise(F.col("slots"))
    return d.withColumn("slots", slots).select(*claims.columns)
