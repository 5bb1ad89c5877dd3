"""One reader for all file kinds: the suffix decides, and the content is read once."""

from __future__ import annotations

import csv
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers.expat import ExpatError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.operators.chunking import BLOCKS
from folionaut.settings import FolioError
from folionaut.sources.books import book_blocks
from folionaut.sources.bytes import any_text, certain_text
from folionaut.sources.markup import markdown_blocks, read_markdown, read_page
from folionaut.sources.office import LAYOUTS, UNITS, office_blocks, too_large, units
from folionaut.sources.pdftext import shown_text
from folionaut.sources.plaintext import CODE_SUFFIXES, TEXT_SUFFIXES, code_blocks, delimited_rows, complete, markdown_text, plain_blocks

RESULT = f"struct<text:string,blocks:{BLOCKS},units:{UNITS},title:string,extractor:string,error:string>"
MARKDOWN_SUFFIXES = ("md", "markdown")
HTML_SUFFIXES = ("html", "htm")
SUPPORTED = (*TEXT_SUFFIXES, *CODE_SUFFIXES, *MARKDOWN_SUFFIXES, *HTML_SUFFIXES, *LAYOUTS, "epub", "pdf")
# What a damaged, encrypted or endlessly nested file can raise; such a file is marked and the others go on.
EXPECTED_ERRORS = (
    FolioError, zipfile.BadZipFile, zlib.error, csv.Error, ExpatError, UnicodeError, LookupError, ValueError, StopIteration, RuntimeError, EOFError,
)


def _structured(data: bytes, suffix: str) -> dict:
    """Blocks of formats with their own structure."""
    if suffix in LAYOUTS:
        return {"units": units(data, suffix), "extractor": suffix}
    if suffix == "epub":
        return {"blocks": book_blocks(data), "extractor": suffix}
    if suffix == "pdf":
        text = shown_text(data)
        if not text.strip():
            raise FolioError("EXTRACTION_FAILED", "no text found")
        return {"blocks": read_markdown(text), "extractor": "pdf_text"}
    text = any_text(data)
    if suffix in MARKDOWN_SUFFIXES:
        return {"blocks": read_markdown(text), "extractor": "markdown"}
    if suffix in HTML_SUFFIXES:
        page = read_page(text)
        return {"blocks": page["blocks"], "title": page["title"], "extractor": "html"}
    rows = delimited_rows(text, "\t" if suffix == "tsv" else ",")
    return {"blocks": [complete(row) for row in rows], "extractor": "delimited_text"}


def read_content(data: bytes, suffix: str, sniff: bool) -> dict:
    """Blocks, or for plain text and source code the text that Spark cuts itself."""
    try:
        if suffix in CODE_SUFFIXES:
            return {"text": any_text(data), "extractor": "source_code"}
        if suffix in TEXT_SUFFIXES and suffix not in ("csv", "tsv"):
            return {"text": any_text(data), "extractor": "text"}
        if suffix in SUPPORTED:
            return _structured(data, suffix)
        text = certain_text(data) if sniff else None
        if text is None:
            return {"error": f"unsupported: {suffix or '(none)'}"}
        return {"text": text, "extractor": "source_code_text_sniff"}
    except EXPECTED_ERRORS as error:
        return {"error": f"{type(error).__name__}: {error}"}


def extract_blocks(files: DataFrame, kind: str = "general") -> DataFrame:
    """Files (content, extension, ...) with ``blocks``, ``title``, ``extractor`` and ``error`` in place of the content.

    ``source_text`` keeps the text of source code, for those who parse it.

    A file of a source-code collection with an unknown suffix is read when its bytes are surely text.
    """
    sniff = kind == "source_code"

    @F.pandas_udf(RESULT)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, suffixes in batches:
            rows = [read_content(bytes(c), s, sniff) for c, s in zip(contents, suffixes)]
            columns = ("text", "blocks", "units", "title", "extractor", "error")
            yield pd.DataFrame({name: pd.Series([row.get(name) for row in rows], dtype=object) for name in columns})

    keep = [c for c in files.columns if c != "content"]
    # Who explodes the blocks makes Spark test their size first; of a reader that counts as not repeatable, no second reading is
    # pushed down for it, past the exchange that spreads the files.
    found = files.select(*keep, read.asNondeterministic()("content", "extension").alias("_r"))
    kind, spread = F.col("_r.extractor"), F.coalesce(too_large(F.col("_r.units"), F.col("_r.extractor")), F.lit(False))
    blocks = (
        F.when(kind.startswith("source_code"), code_blocks(F.col("_r.text")))
        .when(kind == "text", plain_blocks(F.col("_r.text")))
        .when(kind.isin(*LAYOUTS) & ~spread, office_blocks(F.col("_r.units"), kind))
        .otherwise(F.col("_r.blocks"))
    )
    error = F.when(spread, F.lit("FILE_TOO_LARGE: cells repeat too often or lie beyond the last column")).otherwise(F.col("_r.error"))
    return found.select(
        *keep, blocks.alias("blocks"), F.when(kind.startswith("source_code"), F.col("_r.text")).alias("source_text"),
        F.col("_r.title").alias("title"), F.when(~spread, kind).alias("extractor"), error.alias("error"),
    )


def reparsed_as_markdown(extracted: DataFrame) -> DataFrame:
    """General collections keep text as Markdown, so their blocks are those of the Markdown form."""
    native = F.col("extractor").isin("markdown", "text")
    rendered = extracted.withColumn("_markdown", F.when(~native, markdown_text(F.coalesce("blocks", F.array().cast(BLOCKS)))))
    reparsed = markdown_blocks(F.coalesce("_markdown", F.lit("")))
    return rendered.withColumn("blocks", F.when(native, F.col("blocks")).otherwise(reparsed)).drop("_markdown")
