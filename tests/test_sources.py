"""Readers of all formats, on small inputs made here."""

import base64
import codecs
import io
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folionaut.settings import FolioError
from folionaut.sources import books, bytes as raw, cardfiles, office, pdftext, plaintext
from folionaut.sources.extract import extract_blocks, reparsed_as_markdown
from folionaut.sources.markup import read_markdown, read_page
from folionaut.sources.transcript import duration_seconds, transcript_blocks


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files.items():
            archive.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def pack(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return out.getvalue()


def texts(blocks):
    return [b["text"] for b in blocks]


def test_page():
    page = read_page(
        "<html><head><title>The <b>T</b>&amp;</title><style>x</style></head><h1>A</h1><p>Hello <a href='/x'>wor<i>ld</i></a> &lt;now&gt;<!-- c -->!"
        "<p>inner</p></p><script>bad()</script><ul><li>one<p>in</p></li></ul><pre> a\n b</pre><h2>B</h2><table><tr><td>c</td><td>d</td></tr></table></html>"
    )
    assert page["title"] == "The T &"
    assert texts(page["blocks"]) == ["A", "Hello [wor ld](/x) <now> ! inner", "one in", "a\n b", "B", "c d"]
    assert [b["atomic"] for b in page["blocks"]] == [False, False, False, True, False, True]
    assert page["blocks"][-1]["section_path"] == "A > B"
    assert texts(read_page("just <b>text</b>")["blocks"]) == ["just text"] and read_page("")["blocks"] == []
    assert texts(read_page("<h1>x<p>y</p></h1>")["blocks"]) == ["x y", "y"]


def test_markdown():
    blocks = read_markdown(
        "# Chapter\n\nIntro\nmore\n\nSection\n-------\n\n```python\n# not a heading\n\nx = 1\n```\n\n    code\n\n1. one\n2. two\n\n> said\n\n| a | b |\n|---|---|\n| 1 | |\n\n"
        "<div>\nraw\n</div>\n\n***\n\n### Deep ###\n\nText."
    )
    assert texts(blocks) == ["Chapter", "Intro\nmore", "Section", "# not a heading\n\nx = 1", "code", "one", "two", "said", "a", "b", "1", "<div>\nraw\n</div>", "Deep", "Text."]
    assert blocks[-1]["section_path"] == "Chapter > Section > Deep" and blocks[3]["atomic"] and blocks[11]["atomic"]
    assert [b["text"] for b in blocks if b["is_heading"]] == ["Chapter", "Section", "Deep"]


def test_rendered_markdown_fences(spark):
    rows = [[plaintext.complete({"text": "Heading", "is_heading": True, "section_path": "C > Heading"}), plaintext.complete({"text": "text"}), plaintext.complete({"text": "```in```", "atomic": True})]]
    frame = spark.createDataFrame([(r,) for r in rows], f"blocks {plaintext.BLOCKS}")
    assert frame.select(plaintext.markdown_text(F.col("blocks"))).first()[0] == "## Heading\n\ntext\n\n````\n```in```\n````\n"


def test_delimited():
    rows = plaintext.delimited_rows('name,price\n"two\nlines",25\nx,9,extra\n', ",")
    assert texts(rows) == ["name: two\nlines | price: 25", "name: x | price: 9 | col2: extra"] and rows[0]["heading"] == "row 1"
    assert plaintext.delimited_rows("", ",") == []


CODE = "import x\n\ndef a(b):\n    if c(d) {\n    return 1\n\nstatic int foo(int (*a)) {\n}\npub(crate) fn zed<T>(x) {\n x = y (z);\n    else if (a) {\nint late ();\n"


def test_code_blocks(spark):
    frame = spark.createDataFrame([(1, CODE), (2, "k = 1\n\nv = 2\nw\n\n"), (3, ""), (4, "def first():\n    return 1\n\ndef second():\n    return 2")], "id int, text string")
    found = {}
    for row in frame.select("id", plaintext.code_blocks(F.col("text")).alias("b")).collect():
        found[row["id"]] = [(b["heading"], b["line_start"], b["line_end"]) for b in row["b"]]
    assert found[1] == [(None, 1, 2), ("a", 3, 6), ("foo", 7, 8), ("zed", 9, 12)]
    assert found[2] == [(None, 1, 1), (None, 3, 4)] and found[3] == [] and found[4] == [("first", 1, 3), ("second", 4, 5)]


def test_plain_lines_use_every_line_break(spark):
    text = "a\r\n\n b \x0bc\x85d\u2028e"
    frame = spark.createDataFrame([(text,)], "t string").select(F.inline(plaintext.plain_blocks(F.col("t"))))
    expected = [(line, n) for n, line in enumerate(text.splitlines(), 1) if line.strip()]
    assert [(r["text"], r["line_start"]) for r in frame.collect()] == expected


NOT_TEXT = [b"", b"  \n", b"\x7fELFabc", b"MZ", b"PK\x03\x04", b"\x1f\x8b", b"%PDF-1", b"a\x00b", b"\xff\xfe\x00\xd8", b"caf\xe9", b"a\x1bb", "a\x85b".encode(), None]


def test_decoding(spark):
    texts = [codecs.BOM_UTF8 + "é\t\f".encode(), "hé".encode("utf-16"), "hé".encode("utf-32"), "Wide".encode("utf-16-be"), "Árvíz".encode(), b"\x93hello\x94"]
    texts[3] = codecs.BOM_UTF16_BE + texts[3]
    frame = spark.createDataFrame(list(enumerate([*NOT_TEXT, *texts])), "n int, b binary")
    rows = frame.select("n", raw.sniffed_text(F.col("b")).alias("s"), raw.decoded_text(F.col("b")).alias("d")).orderBy("n").collect()
    assert [r["s"] for r in rows[: len(NOT_TEXT)]] == [None] * len(NOT_TEXT)
    assert [r["s"] for r in rows[len(NOT_TEXT) :]] == ["é\t\f", "hé", "hé", "Wide", "Árvíz", None]
    assert [rows[n]["d"] for n in (-6, -5, -3, -2, -1)] == ["é\t\f", "hé", "Wide", "Árvíz", "“hello”"]
    assert rows[9]["d"] == "café" and rows[12]["d"] is None



W = 'xmlns:w="http://w" xmlns:a="http://a"'


def office_rows(spark, kind, files):
    """Blocks, or the error, of one archive read as the store reads it."""
    frame = spark.createDataFrame([("f", kind, pack(files))], "filename string, extension string, content binary")
    row = extract_blocks(frame).first()
    return row["error"] or row["blocks"]


def test_word_and_slides(spark):
    document = f'<w:document {W}><w:p><w:t>  </w:t></w:p><w:p><w:t>before</w:t></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>Head</w:t></w:p><w:p><w:t>bo</w:t><w:t>dy</w:t><w:x>no</w:x></w:p><w:p/></w:document>'
    blocks = office_rows(spark, "docx", {"word/document.xml": document})
    assert [(b["text"], b["is_heading"], b["section_path"]) for b in blocks] == [("before", False, None), ("Head", True, "Head"), ("body", False, "Head")]
    assert office_rows(spark, "docx", {"word/document.xml": "<a/>"}) == [] and office_rows(spark, "docx", {"other": ""}) == []
    slides = {f"ppt/slides/slide{n}.xml": f"<s {W}><a:p><a:t>text {n}</a:t></a:p></s>" for n in (10, 2, 1)}
    assert [(b["text"], b["slide"]) for b in office_rows(spark, "pptx", slides)] == [("text 1", 1), ("text 2", 2), ("text 10", 3)]


def test_workbook(spark):
    files = {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Prices" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>la</t></r><r><t>mp</t></r></si></sst>",
        "xl/calcChain.xml": '<calcChain><c r="A1"/></calcChain>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2.5</v></c></row><row r="2"><c r="A2"/></row>'
        '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="inlineStr"><is><t>in</t></is></c><c r="C3" t="b"><v>1</v></c></row><row><c><v>x</v></c><c/><c r="D4"><v>y</v></c></row></sheetData></worksheet>',
    }
    found = office_rows(spark, "xlsx", files)
    assert [(b["text"], b["sheet"], b["line_start"]) for b in found] == [("name\t\t2.5", "Prices", 1), ("lamp\tin\tTrue", "Prices", 3), ("x\t\t\ty", "Prices", 4)]
    absolute = {k: v.replace('"worksheets', '"/xl/worksheets') for k, v in files.items()}
    assert office_rows(spark, "xlsx", absolute) == found
    far = {k: v.replace('"C1"', '"ZZZZ1"') for k, v in files.items()}
    assert office_rows(spark, "xlsx", far).startswith("FILE_TOO_LARGE")


T = 'xmlns:t="http://t" xmlns:o="http://o" xmlns:x="http://x"'


def test_open_documents(spark):
    table = (
        f'<d {T}><t:table t:name="S"><t:table-row t:number-rows-repeated="2"><t:table-cell t:number-columns-repeated="2"><x:p>v</x:p></t:table-cell>'
        '<t:table-cell t:number-columns-repeated="16000"/></t:table-row><t:table-row t:number-rows-repeated="5000000"><t:table-cell/></t:table-row>'
        '<t:table-row><t:table-cell o:value="7"/><t:covered-table-cell/><t:table-cell><o:annotation><x:p>note</x:p></o:annotation><x:p>a</x:p><x:p>b<x:s>c</x:s></x:p></t:table-cell></t:table-row></t:table></d>'
    )
    assert [(b["text"], b["line_start"]) for b in office_rows(spark, "ods", {"content.xml": table})] == [("v\tv", 1), ("v\tv", 2), ("7\t\ta bc", 5000003)]
    for endless in (table.replace('repeated="2"><t:table-cell t', 'repeated="20000"><t:table-cell t'), table.replace('columns-repeated="2"', 'columns-repeated="20000"')):
        assert office_rows(spark, "ods", {"content.xml": endless}).startswith("FILE_TOO_LARGE")
    text = f"<d {T}><x:h>Head</x:h><x:p>bo<x:span>dy</x:span></x:p></d>"
    assert [(b["text"], b["section_path"]) for b in office_rows(spark, "odt", {"content.xml": text})] == [("Head", "Head"), ("body", "Head")]
    slides = f"<d {T}><x:p>master</x:p><t:page><x:p>one</x:p></t:page><t:page><x:h>two</x:h></t:page></d>"
    assert [(b["text"], b["slide"]) for b in office_rows(spark, "odp", {"content.xml": slides})] == [("one", 1), ("two", 2)]


def test_large_files_take_linear_time(spark):
    """40,000 paragraphs under 8,000 headings, and 60,000 cells over 20,000 shared strings."""
    paragraph = lambda n: f'<w:p><w:pPr><w:pStyle w:val="{"Heading2" if n % 5 == 0 else "Body"}"/></w:pPr><w:t>p{n}</w:t></w:p>'
    blocks = office_rows(spark, "docx", {"word/document.xml": f"<w:d {W}>" + "".join(map(paragraph, range(40_000))) + "</w:d>"})
    assert len(blocks) == 40_000 and all(b["heading"] == f"p{n - n % 5}" and b["is_heading"] == (n % 5 == 0) for n, b in enumerate(blocks))
    rows = "".join(f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="s"><v>{n}</v></c>' for c in "ABC") + "</row>" for n in range(20_000))
    files = {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>t{n}</t></si>" for n in range(20_000)) + "</sst>", "xl/worksheets/s.xml": f"<w>{rows}</w>",
    }
    started = time.monotonic()
    assert [b["text"] for b in office_rows(spark, "xlsx", files)] == [f"t{n}\tt{n}\tt{n}" for n in range(20_000)]
    assert time.monotonic() - started < 60


def test_book_follows_its_spine():
    files = {
        "META-INF/container.xml": '<c><rootfile full-path="OPS/p.opf"/></c>',
        "OPS/p.opf": '<p><item id="a" href="a.html"/><item id="b" href="sub/b.html#x"/><itemref idref="b"/><itemref idref="a"/></p>',
        "OPS/a.html": "<h1>A</h1><p>x</p>", "OPS/sub/b.html": "<title>B</title><p>y</p>",
    }
    assert [(b["text"], b["section_path"]) for b in books.book_blocks(pack(files))] == [("y", "B"), ("A", "A"), ("x", "A")]


def test_archives_refuse_entities(spark):
    late = "<!-- " + "x" * 5000 + ' --><!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'
    assert "type declarations" in office_rows(spark, "docx", {"word/document.xml": late})
    assert office_rows(spark, "docx", {"word/document.xml": "<a><b></a>"}).startswith("ExpatError")


def test_pdf_streams_and_page_marks():
    shown = b"BT (Hello \\(there\\)) Tj [(Wor) -20 (ld)] TJ ET"
    plain = b"<< /Length 9 >>\nstream\n" + shown + b"\nendstream"
    packed = b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"(deflated \\101) Tj /F1 12 Tf <41 4> Tj % (no) Tj") + b"\nendstream"
    other = b"<< /Filter /DCTDecode >>\nstream\n(no) Tj\nendstream"
    assert pdftext.shown_text(b"%PDF-1.4\n" + plain + b" " * 400 + packed + b" " * 400 + other) == "Hello (there)\nWorld\ndeflated A\nA@"
    far = b"<< /Length 9 " + b" " * 4000 + b"/Filter [/ASCII85Decode /FlateDecode] >>\nstream\n" + base64.a85encode(zlib.compress(b"(a (nested\\) b) c) '")) + b"~>\nendstream"
    cut = b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"(first) Tj " + bytes(range(256)) * 400)[:-20] + b"\nendstream"
    assert pdftext.shown_text(far + cut).splitlines()[:2] == ["a (nested) b) c", "first"]
    assert pdftext.shown_text(b"") == pdftext.shown_text(b"<< /Filter /FlateDecode >>\nstream\nbad\nendstream") == pdftext.shown_text(b"<< >>\nstream\n0 0 m (x) 10 l S\nendstream") == ""
    assert pdftext.marked_pages("a\n{0}-----\nb\n1\n" + "-" * 48 + "\nc") == [(1, "a"), (1, "b"), (2, "c")]


def test_transcripts(spark):
    seconds = '{"segments":[{"text":" hi ","start":0.5,"end":1.2345},{"text":" ","start":2,"end":3}]}'
    offsets = '{"transcription":[{"text":"a","offsets":{"from":10,"to":20}},{"text":"b"}]}'
    wrong = '{"segments":[{"text":"x","start":3,"end":1}]}'
    frame = spark.createDataFrame([(seconds, offsets, wrong)], "s string, o string, w string")
    blocks = transcript_blocks(F.col("s"))
    row = frame.select(blocks.alias("s"), transcript_blocks(F.col("o"), True).alias("o"), transcript_blocks(F.col("w")).alias("w"), duration_seconds(blocks).alias("d")).first()
    assert [(b["text"], b["time_start_ms"], b["time_end_ms"]) for b in row["s"]] == [("hi", 500, 1234)]
    assert [(b["text"], b["time_end_ms"]) for b in row["o"]] == [("a", 20)] and row["w"] is None and row["d"] == 1.234


CARD = "id: BFS\ncategory: graph\ntitle: Search\ndescription: Explores\nconfidence: 0.9\ncodes: ['def f(): pass']\ncosts: {time: O(n)}\nextra: 1\n"


BAD_CARDS = [
    "id: a\nid: b\ncategory: c\ntitle: t\ndescription: d\nconfidence: 1\n", CARD.replace("0.9", ".nan"), CARD.replace("0.9", "1.5"), CARD.replace("0.9", "true"), CARD.replace("0.9", "'0.9'"),
    "id: &x a\ncategory: c\ntitle: *x\ndescription: d\nconfidence: 1\n", CARD.replace("Search", "' '"), CARD.replace("['def f(): pass']", "[1]"), CARD.replace("['def f(): pass']", "[a, null]"), "a: [",
    CARD.replace("Search", "2020-01-01"), CARD.replace("Search", "null"), CARD + "subcategory: 3\n", CARD.replace("{time: O(n)}", "[a]"), CARD + "source: [{a: 1}]\n", CARD + "source: {a: b}\n", CARD + "3: x\n",
    CARD.replace("['def f(): pass']", "null"), CARD + "source: [null]\n",
]


def test_hardened_cards(spark):
    rows = cardfiles.read_cards(spark.createDataFrame(list(enumerate(BAD_CARDS)), "source_id int, text string")).collect()
    assert len(rows) == len(BAD_CARDS) and [BAD_CARDS[r["source_id"]] for r in rows if r["status"] != "invalid" or not r["error"] or r["title"] is not None] == []


def test_cards(spark):
    frame = spark.createDataFrame([("s1", CARD), ("s2", "just: text"), ("s3", "- list"), ("s4", None), ("s5", ""), ("s6", CARD.replace("['def f(): pass']", "[]").replace("0.9", "1") + "source: [{a: b}, {c: d, e: f}]\nmade: 2020-01-01\n")], "source_id string, text string")
    rows = {r["source_id"]: r for r in cardfiles.read_cards(frame).collect()}
    assert rows["s1"]["status"] == "card" and rows["s1"]["costs"] == {"time": "O(n)"} and rows["s1"]["codes"] == ["def f(): pass"]
    assert rows["s2"]["status"] == rows["s3"]["status"] == rows["s4"]["status"] == rows["s5"]["status"] == "not_a_card"
    assert rows["s6"]["status"] == "card" and rows["s6"]["codes"] == [] and rows["s6"]["confidence"] == 1 and rows["s6"]["source"] == [{"a": "b"}, {"c": "d", "e": "f"}]
    assert rows["s1"]["source"] == [] and rows["s1"]["subcategory"] == "" and rows["s1"]["raw_yaml"] == CARD and rows["s2"]["raw_yaml"] is None
    assert cardfiles.dump_cards([CARD + 'note: "a\\nb"\nquoted: \'7\'\nnone: []\n']) == "---\ncategory: graph\ntitle: Search\ndescription: Explores\nconfidence: 0.9\ncodes:\n- 'def f(): pass'\ncosts:\n  time: O(n)\nextra: 1\nnote: |-\n  a\n  b\nquoted: '7'\nnone: []\n"
    dumped = cardfiles.dump_cards([CARD])
    assert "id:" not in dumped and "extra: 1" in dumped and dumped.startswith("---") and cardfiles.dump_cards([]) == cardfiles.EMPTY_RESULT


def test_dispatch_reads_every_kind_once(spark):
    files = [
        ("a.md", "md", b"# H\n\ntext"), ("b.html", "html", b"<p>page</p>"), ("c.csv", "csv", b"h\nv\n"), ("d.tsv", "tsv", b"h\tg\nv\tw\n"),
        ("e.py", "py", b"def f():\n    pass\n"), ("f.log", "log", b"one\ntwo\n"), ("g.docx", "docx", b"broken"), ("h.weird", "weird", b"some text"), ("i.bin", "bin", b"\x00"),
    ]
    frame = spark.createDataFrame(files, "filename string, extension string, content binary")
    code = {r["filename"]: r for r in extract_blocks(frame, "source_code").collect()}
    assert {n: texts(r["blocks"]) if r["blocks"] else None for n, r in code.items()} == {
        "a.md": ["H", "text"], "b.html": ["page"], "c.csv": ["h: v"], "d.tsv": ["h: v | g: w"], "e.py": ["def f():\n    pass"], "f.log": ["one", "two"],
        "g.docx": None, "h.weird": ["some text"], "i.bin": None,
    }
    assert code["g.docx"]["error"] and code["i.bin"]["error"] and code["h.weird"]["extractor"] == "source_code_text_sniff"
    general = {r["filename"]: r for r in reparsed_as_markdown(extract_blocks(frame)).collect()}
    assert general["h.weird"]["error"] and general["c.csv"]["blocks"][0]["atomic"] and general["e.py"]["blocks"][0]["line_start"] is None


def test_queries_give_workers_short_batches(spark, tmp_path):
    import suite.markup  # noqa: F401
    from suite.registry import QUERIES

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = spark.createDataFrame([(i, f"<title>t{i}</title><h1>Head</h1>") for i in range(2500)], "page_id long, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["html_titles_and_links"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["title"], r["headings"]) for r in found) == [(i, f"t{i}", 1) for i in range(2500)]
    sizes = spark.range(2500).coalesce(1).mapInPandas(lambda batches: (type(b)({"n": [len(b)]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 2500 and max(r["n"] for r in sizes) <= 1000
