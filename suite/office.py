"""Files of other programs: Spark makes them from the given tables, and the readers give back what went in."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folionaut.sources.cardfiles import read_cards
from folionaut.sources.extract import extract_blocks
from suite.registry import query, table


def zipped(members: dict[str, Column]) -> Column:
    """An archive of texts by their names."""

    @F.pandas_udf("binary")
    def pack(batch: pd.Series) -> pd.Series:
        def one(files) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, text in dict(files).items():
                    archive.writestr(name, text)
            return out.getvalue()

        return batch.map(one)

    return pack(F.create_map(*[part for name, text in members.items() for part in (F.lit(name), text)]))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part.cast("string") for part in parts])


def blocks_of(files, key: str, kind: str):
    """(key, place, the block's columns) of files of one kind."""
    named = files.withColumn("extension", F.lit(kind))
    return extract_blocks(named).select(key, F.posexplode("blocks").alias("place", "b")).select(key, "place", "b.*")


# XML holds no control characters but tab and line feed; both sides leave the others out.
NOT_XML = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"


@query(
    "word_paragraphs",
    rf"""WITH parts AS (
  SELECT doc_id, source, string_split(regexp_replace(text, '{NOT_XML}', '', 'g'), '. ') AS p FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, source, 0 AS n, source AS text, true AS is_heading FROM parts
  UNION ALL SELECT doc_id, source, unnest(generate_series(1, len(p))), unnest(p), false FROM parts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS place, text, is_heading, source AS heading
FROM units WHERE regexp_matches(text, '[^\s\x{{85}}\pZ]')""",
)
def word_paragraphs(spark, folder):
    """A Word file of each document: its source as heading, then a paragraph for each sentence."""
    docs = table(spark, folder, "documents", "doc_id").filter("text IS NOT NULL")
    paragraph = lambda text: joined("<w:p><w:r><w:t>", escaped(text), "</w:t></w:r></w:p>")
    sentences = F.split(F.regexp_replace("text", NOT_XML, ""), r"\. ", -1)
    body = joined(
        '<w:document xmlns:w="urn:w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>', escaped(F.col("source")), "</w:t></w:r></w:p>",
        F.array_join(F.transform(sentences, paragraph), ""), "</w:body></w:document>",
    )
    files = docs.select("doc_id", zipped({"word/document.xml": body}).alias("content"))
    return blocks_of(files, "doc_id", "docx").select("doc_id", "place", "text", "is_heading", "heading")


@query(
    "workbook_rows",
    r"""WITH cells AS (
  SELECT c_custkey, 0 AS place, 'Profile' AS sheet, 1 AS line, 'name' || chr(9) || c_name AS text FROM customer
  UNION ALL SELECT c_custkey, 1, 'Profile', 2, 'balance' || chr(9) || chr(9) || round(c_acctbal * 100)::BIGINT FROM customer
  UNION ALL SELECT c_custkey, 2, 'Profile', 4, 'segment' || chr(9) || c_mktsegment || chr(9) || CASE WHEN c_nationkey < 10 THEN 'True' ELSE 'False' END FROM customer
  UNION ALL SELECT c_custkey, 3, 'Key', 1, c_custkey || chr(9) || chr(9) || chr(9) || c_nationkey FROM customer)
SELECT * FROM cells""",
)
def workbook_rows(spark, folder):
    """A workbook of each customer: shared and inline strings, numbers, truth values, cells left out, sheets not in file order."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    profile = joined(
        '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>2</v></c><c r="B1" t="inlineStr"><is><t>', escaped(F.col("c_name")), "</t></is></c></row>",
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><f>A1</f><v>', cents, '</v></c></row><row r="3"><c r="A3"/></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4" t="str"><v>',
        escaped(F.col("c_mktsegment")), '</v></c><c r="C4" t="b"><v>', (F.col("c_nationkey") < 10).cast("int"), "</v></c></row></sheetData></worksheet>",
    )
    keys = joined('<worksheet><sheetData><row><c><v>', F.col("c_custkey"), '</v></c><c r="D1"><v>', F.col("c_nationkey"), "</v></c></row></sheetData></worksheet>")
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="Profile" sheetId="1" r:id="b"/><sheet name="Key" sheetId="2" r:id="a"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    shared = "<sst><si><r><t>bal</t></r><r><t>ance</t></r></si><si><t>segment</t></si><si><t>name</t></si></sst>"
    members = {
        "xl/workbook.xml": F.lit(book), "xl/_rels/workbook.xml.rels": F.lit(links), "xl/sharedStrings.xml": F.lit(shared),
        "xl/worksheets/sheet1.xml": keys, "xl/worksheets/sheet2.xml": profile,
    }
    files = table(spark, folder, "customer", "c_custkey").select("c_custkey", zipped(members).alias("content"))
    return blocks_of(files, "c_custkey", "xlsx").select("c_custkey", "place", "sheet", F.col("line_start").alias("line"), "text")


@query(
    "open_table_rows",
    r"""WITH rows_ AS (
  SELECT s_suppkey, unnest(generate_series(1, s_nationkey % 3 + 1)) AS line, s_name || chr(9) || chr(9) || chr(9) || s_nationkey AS text FROM supplier
  UNION ALL SELECT s_suppkey, s_nationkey % 3 + 1002, 'a' || chr(9) || 'a b' || chr(9) || 'a b' FROM supplier)
SELECT s_suppkey, (row_number() OVER (PARTITION BY s_suppkey ORDER BY line) - 1)::INT AS place, 'S' AS sheet, line::INT AS line, text FROM rows_""",
)
def open_table_rows(spark, folder):
    """An OpenDocument table of each supplier: repeated rows, cells and blanks, numbers by value, cells of several paragraphs."""
    content = joined(
        '<d xmlns:t="urn:t" xmlns:o="urn:o" xmlns:x="urn:x"><t:table t:name="S"><t:table-row t:number-rows-repeated="', F.col("s_nationkey") % 3 + 1, '"><t:table-cell><x:p>',
        escaped(F.col("s_name")), '</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2"/><t:table-cell o:value="', F.col("s_nationkey"),
        '"/><t:table-cell t:number-columns-repeated="16000"/></t:table-row><t:table-row t:number-rows-repeated="1000"><t:table-cell/></t:table-row>',
        '<t:table-row><t:table-cell><x:p>a</x:p></t:table-cell><t:covered-table-cell t:number-columns-repeated="2"><x:p>a</x:p><x:p>b</x:p></t:covered-table-cell></t:table-row></t:table></d>',
    )
    files = table(spark, folder, "supplier", "s_suppkey").select("s_suppkey", zipped({"content.xml": content}).alias("content"))
    return blocks_of(files, "s_suppkey", "ods").select("s_suppkey", "place", "sheet", F.col("line_start").alias("line"), "text")


@query(
    "slide_paragraphs",
    r"""SELECT p_partkey, 0 AS place, 1 AS slide, p_name AS text FROM part
UNION ALL SELECT p_partkey, 1, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, 2, p_type FROM part""",
)
def slide_paragraphs(spark, folder):
    """Slides of each part, by number and not by name."""
    slide = lambda *names: joined('<s xmlns:a="urn:a">', *[joined("<a:p><a:r><a:t>", escaped(F.col(n)), "</a:t></a:r></a:p>") for n in names], "<a:p/></s>")
    members = {"ppt/slides/slide10.xml": slide("p_type"), "ppt/slides/slide9.xml": slide("p_name", "p_brand"), "ppt/presentation.xml": F.lit("<p/>")}
    files = table(spark, folder, "part", "p_partkey").select("p_partkey", zipped(members).alias("content"))
    return blocks_of(files, "p_partkey", "pptx").select("p_partkey", "place", "slide", "text")


@query(
    "pdf_lines",
    r"""SELECT c_custkey, 0 AS place, c_name || chr(10) || '(' || c_mktsegment || ')' || chr(10) || 'key ' || c_custkey AS text FROM customer""",
)
def pdf_lines(spark, folder):
    """A PDF of each customer: a plain stream with nested brackets and pieces, and a deflated one."""

    @F.pandas_udf("binary")
    def pdf(plain: pd.Series, packed: pd.Series) -> pd.Series:
        form = b"%%PDF-1.4\n1 0 obj << >>\nstream\n%s\nendstream endobj\n2 0 obj << /Filter /FlateDecode >>\nstream\n%s\nendstream endobj\n"
        return pd.Series([form % (a.encode("latin-1"), zlib.compress(b.encode("latin-1"))) for a, b in zip(plain, packed)])

    plain = joined("BT /F1 12 Tf (", F.col("c_name"), ") Tj [(\\050", F.substr("c_mktsegment", F.lit(1), F.lit(2)), ") -20 (", F.substr("c_mktsegment", F.lit(3)), ") <29>] TJ ET")
    packed = joined("BT (key) 3 Td (key ", F.col("c_custkey"), ") ' ET")
    files = table(spark, folder, "customer", "c_custkey").select("c_custkey", pdf(plain, packed).alias("content"))
    return blocks_of(files, "c_custkey", "pdf").select("c_custkey", "place", "text")


@query(
    "card_files",
    r"""SELECT p_partkey, status,
  CASE WHEN status = 'card' THEN 'P' || p_partkey END AS card_id, CASE WHEN status = 'card' THEN p_name END AS title,
  CASE WHEN status = 'card' THEN p_size / 100.0::DOUBLE END AS confidence, CASE WHEN status = 'card' THEN [p_brand, p_type] END AS codes,
  CASE WHEN status = 'card' THEN p_type END AS cost
FROM (SELECT *, CASE WHEN p_size % 7 IN (0, 1, 2) THEN 'invalid' WHEN p_size % 7 = 3 THEN 'not_a_card' ELSE 'card' END AS status FROM part)""",
)
def card_files(spark, folder):
    """A card file of each part: whole cards, files that lack a field, repeated keys, aliases and wrong numbers."""
    turn = F.col("p_size") % 7
    quoted = lambda name: joined("'", F.replace(F.col(name), F.lit("'"), F.lit("''")), "'")
    text = joined(
        "id: P", F.col("p_partkey"), "\ncategory: part\ntitle: ", quoted("p_name"), "\nconfidence: ", F.when(turn == 0, F.lit("1.5")).otherwise(F.format_string("%.2f", F.col("p_size") / 100)),
        "\ncodes: [", quoted("p_brand"), ", ", quoted("p_type"), "]\ncosts: {kind: ", quoted("p_type"), "}\n",
        F.when(turn == 1, F.lit("title: again\n")).when(turn == 2, F.lit("a: &a x\nb: *a\n")).otherwise(F.lit("")), F.when(turn == 3, F.lit("")).otherwise(F.lit("description: |\n  two\n  lines\n")),
    )
    cards = read_cards(table(spark, folder, "part", "p_partkey").select(F.col("p_partkey").alias("source_id"), text.alias("text")))
    return cards.select(F.col("source_id").alias("p_partkey"), "status", "card_id", "title", "confidence", "codes", F.col("costs")["kind"].alias("cost"))
