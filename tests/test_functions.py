"""Facts, tokens, names, citations and stems."""

import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from folionaut.functions import names
from folionaut.functions import text as T
from folionaut.functions.embedding import HashEmbedder
from folionaut.functions.facts import extract_facts
from folionaut.functions.porter import stem, stem_token_lists

LABELLED = [
    ("Price: €1,299", "price", 1299.0), ("cost $2.50", "price", 2.5), ("Amount: 12 USD", "amount", 12.0), ("total £100", "total", 100.0),
    ("discount 15%", "discount_percent", 15.0), ("tax 20%", "tax_percent", 20.0), ("rating 4.6", "rating", 4.6), ("score 92.5", "score", 92.5),
    ("Rank #7", "rank", 7.0), ("count 12", "count", 12.0), ("quantity 6", "quantity", 6.0), ("weight 5kg", "weight", 5.0),
    ("length 15cm", "length", 15.0), ("version v2.1", "version", 2.1),
]
DATED = [
    ("Published 2026-08-22", "published_date"), ("Event date: 2026/08/22", "event_date"), ("Created 22 August 2026", "created_date"),
    ("Updated August 22, 2026", "updated_date"), ("On August 22 2026", "date"),
]
NOTHING = ["The building has 12 floors, he’s unsure.", "2026-02-31", "version 1.2.3", "ratings 5", "0000-01-01", ""]


def facts_of(spark, texts, locale="en"):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [row.asDict() for row in extract_facts(frame, locale=locale).orderBy("id", "fact_order").collect()]


def test_labelled_facts_and_their_spans(spark):
    found = facts_of(spark, [text for text, _, _ in LABELLED])
    assert [(f["field"], f["normalized_number"]) for f in found] == [(field, value) for _, field, value in LABELLED]
    for fact in found:
        text = LABELLED[fact["id"]][0]
        assert text[fact["char_start"] : fact["char_end"]].strip() == fact["raw_value"]
    assert [f["currency_code"] for f in found[:4]] == ["EUR", "USD", "USD", "GBP"]
    assert found[4]["unit"] == "0.15" and found[11]["unit"] == "kg" and found[12]["unit"] == "cm"


def test_dates(spark):
    found = facts_of(spark, [text for text, _ in DATED])
    assert [f["field"] for f in found] == [field for _, field in DATED]
    assert {f["normalized_date_utc"] for f in found} == {"2026-08-22T00:00:00Z"}


def test_no_facts_where_there_are_none(spark):
    assert facts_of(spark, NOTHING) == []


def test_locale_overlaps_and_order(spark):
    assert facts_of(spark, ["Price €1.299,50"], "de")[0]["normalized_number"] == 1299.5
    found = facts_of(spark, ["😀 tax 2,5 % price 5 EUR price 7,5; 2020-10-12 May 2021 \x01 weight 5 length 3 cm total 4. weight 3 kgs"])
    assert [(f["field"], f["normalized_number"] or f["normalized_date_utc"][:10]) for f in found] == [
        ("price", 5.0), ("price", 75.0), ("total", 4.0), ("tax_percent", 25.0), ("weight", 5.0), ("weight", 3.0), ("length", 3.0),
        ("date", "2020-10-12"), ("date", "2021-05-12"),
    ]
    assert found[3]["char_start"] == 2 and found[0]["currency_code"] == "EUR" and found[5]["unit"] is None


def test_facts_are_read_once_and_in_compiled_rows(spark):
    plan = extract_facts(spark.createDataFrame([(1, "tax 5 %")], "id int, text string")).select("id", "field", "normalized_number", "char_end")
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("regexp_replace(" in line for line in lines) == 1
    assert not any("lambda" in line and "regexp_extract" in line for line in lines)


def test_places_of_facts_leave_out_what_is_no_fact(spark):
    text = "May 2, 2021 version 1.2.3 \x03 2021-02-30 versionv2 tax 5 % 2021/01/02 \x01 Created 3 March 2020 price 1 Published: 2020-01-01"
    found = facts_of(spark, [text, None, text])
    expected = [(None, 2.0), ("price", 1.0), ("tax_percent", 5.0), ("published_date", "2020-01-01"), ("date", "2021-01-02"), ("created_date", "2020-03-03"), ("date", "2021-05-02")]
    for n in (0, 2):
        mine = [f for f in found if f["id"] == n]
        assert [f["fact_order"] for f in mine] == list(range(7))
        assert [(f["field"], f["normalized_number"] or f["normalized_date_utc"][:10]) for f in mine] == expected
        assert all(text[f["char_start"] : f["char_end"]].strip() == f["raw_value"] for f in mine)
    assert len(found) == 14


def test_vocabulary_terms(spark):
    frame = spark.range(1).select(T.candidate_terms(F.lit("The Embedding Retrieval System and the Retrieval_x ab Pipeline-2")).alias("t"))
    assert frame.first()["t"] == ["embedding", "retrieval", "system", "retrieval_x", "pipeline-2"]


def test_tokens_fold_like_the_index_of_sqlite(spark):
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.category(chr(c))[0] == "L"]
    samples = [f"a{letter}b" for letter in letters] + ["foo_bar, élan-x9 éte", "ÇA naïve STRAẞE"]
    database = sqlite3.connect(":memory:")
    database.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    database.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    database.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(samples)))
    expected = {}
    for term, row, _ in database.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset"):
        expected.setdefault(row, []).append(term)
    frame = spark.createDataFrame(list(enumerate(samples)), "id int, text string")
    got = {r["id"]: r["t"] for r in frame.select("id", T.tokens(F.col("text")).alias("t")).collect()}
    ours = {n: T.host_tokens(s) for n, s in enumerate(samples)}
    ascii_lower = [n for n, s in enumerate(samples) if s.lower() == s]
    assert all(got[n] == expected[n] for n in ascii_lower)
    assert all(ours[n] == expected[n] for n in ascii_lower)


def test_stems_match_the_stemmer_of_sqlite(spark):
    words = (
        "relational conditional valenci digitizer conformabli radicalli vietnamization operator feudalism decisiveness hopefulness formaliti "
        "sensibiliti triplicate formative formalize electriciti hopeful goodness revival allowance inference airliner adjustable irritant "
        "replacement adjustment dependent adoption communism activate homologous effective bowdlerize probate rate cease controll roll "
        "exploring explored flies dies ies agreed owned humbled sized meeting caresses ponies ties caress cats feed plastered motoring sing "
        "conflated troubled hopping tanned falling hissing fizzed failing filing happy sky élan"
    ).split()
    database = sqlite3.connect(":memory:")
    database.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    database.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    folded = [T.host_tokens(w)[0] for w in words]
    database.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(folded)))
    expected = dict(database.execute("SELECT doc, term FROM v"))
    assert {n: stem(w) for n, w in enumerate(folded)} == expected
    frame = spark.createDataFrame([(1, [folded, []])], "seq int, lists array<array<string>>")
    assert stem_token_lists(frame, "seq").first()["lists"][0] == [expected[n] for n in range(len(words))]


@pytest.mark.parametrize(
    "anchors,label",
    [
        ((3, 3, None, None, 1, 9, None, 50.0), "f.md, p.3"), ((3, 5, None, None, None, None, None, None), "f.md, p.3-5"),
        ((None, None, 2, 2, None, None, None, None), "f.md, slide 2"), ((None, None, None, None, 4, 9, None, None), "f.md, lines 4-9"),
        ((None, None, None, None, None, None, 125_000, None), "f.md, 2:05"), ((None, None, None, None, None, None, None, 12.5), "f.md, ~12% through"),
        ((None,) * 8, "f.md"),
    ],
)
def test_citation_uses_the_most_precise_anchor(spark, anchors, label):
    columns = [F.lit(a).cast("double" if n == 7 else "bigint") for n, a in enumerate(anchors)]
    assert spark.range(1).select(T.citation_label(F.lit("f.md"), *columns)).first()[0] == label


def test_names(spark):
    paths = ["a/b.py", "a/__init__.py", "x/Makefile", ".hid", "a.tar.gz", "src/lib.rs", "src/a/mod.rs", "main.go", "p/q/z.go", "a/index.ts", "k/v.H"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    language = names.language(F.col("p"))
    rows = frame.select("p", names.extension(F.col("p")).alias("e"), language.alias("l"), names.module_key(F.col("p"), language).alias("m")).collect()
    assert {r["p"]: (r["e"], r["l"], r["m"]) for r in rows} == {
        "a/b.py": ("py", "python", "a.b"), "a/__init__.py": ("py", "python", "a"), "x/Makefile": ("sh", None, "x.Makefile"),
        ".hid": ("", None, ".hid"), "a.tar.gz": ("gz", None, "a.tar"), "src/lib.rs": ("rs", "rust", "crate"), "src/a/mod.rs": ("rs", "rust", "crate.a"),
        "main.go": ("go", "go", "main"), "p/q/z.go": ("go", "go", "p.q"), "a/index.ts": ("ts", "typescript", "a"), "k/v.H": ("h", "c", "k/v.H"),
    }


def test_hash_embedder_agrees_on_both_sides(spark):
    embedder = HashEmbedder()
    stored = spark.range(1).select(embedder.column(F.lit("abc")).alias("v")).first()["v"]
    assert stored == embedder.query("abc") and len(stored) == 8
