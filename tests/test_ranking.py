"""BM25 against SQLite, exact ranks and fusion against brute force, filters, cards."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from folionaut.operators import bm25, cards, fusion, vector
from folionaut.operators.filters import filter_chunks
from folionaut.plans.corpus import CorpusCollection, EmbeddingUnavailable, corpus_describe, corpus_query
from folionaut.plans.requests import CorpusQuery, NumericFilter, SearchFilters, SearchRequest
from folionaut.plans.search import DocumentTables, search
from folionaut.functions.embedding import HashEmbedder
from folionaut.functions.facts import extract_facts
from folionaut.operators.vocabulary import keyword_links
from folionaut.settings import FolioError, Settings

WORDS = "red lamp blue chair green table Élan foo_bar the exploring sized foo bar café".split()


def corpus(size=60, seed=3):
    rng = random.Random(seed)
    return [
        (n, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))), rng.choice([None, "Lamp heading", "foo bar"]), f"file-{n}.txt") for n in range(size)
    ]


def rows_frame(spark, rows):
    return spark.createDataFrame([(n, t, h, None, f) for n, t, h, f in rows], "seq long, text string, heading string, section_path string, filename string")


@pytest.mark.parametrize("query", ["lamp", "Élan cafe", "foo_bar", "the the lamp", "foo_bar foo red_lamp", "absent lamp", "file 12", "_ !"])
def test_keyword_scores_equal_sqlite(spark, query):
    rows = corpus()
    database = sqlite3.connect(":memory:")
    database.execute("CREATE VIRTUAL TABLE t USING fts5(text, heading, section_path, filename)")
    database.executemany("INSERT INTO t(rowid, text, heading, section_path, filename) VALUES (?, ?, ?, NULL, ?)", rows)
    import re

    match = " OR ".join(f'"{w}"' for w in re.findall(r"\w+", query))
    expected = {}
    if bm25.query_phrases(query):
        expected = {r: -s for r, s in database.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    frame = rows_frame(spark, rows)
    scanned = {r["seq"]: r["keyword_score"] for r in bm25.keyword_scores(frame, query).collect()}
    assert scanned == pytest.approx(expected, abs=1e-9)
    stats = bm25.corpus_statistics(bm25.lengths(frame))
    indexed = {r["seq"]: r["keyword_score"] for r in bm25.indexed_keyword_scores(bm25.postings(frame), stats, query).collect()}
    assert indexed == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("partitions", [1, 7])
def test_fusion_equals_full_ranking(spark, partitions):
    rng = random.Random(5)
    # Many ties, and one score that a third of all rows share.
    first = {n: 0.5 if n % 3 == 0 else rng.choice([0.1, 0.2, 0.3, 0.9]) for n in range(900)}
    second = {n: rng.choice([1.0, 2.0, 3.0]) for n in range(0, 900, 2)}

    def ranks(scores):
        return {n: r for r, n in enumerate(sorted(scores, key=lambda n: (-scores[n], n)), 1)}

    a, b = ranks(first), ranks(second)
    fused = {n: 0.65 / (60 + a[n]) + (0.35 / (60 + b[n]) if n in b else 0) for n in first}
    expected = sorted(fused, key=lambda n: (-fused[n], n))[:20]
    one = spark.createDataFrame(list(first.items()), "seq long, v double").repartition(partitions)
    two = spark.createDataFrame(list(second.items()), "seq long, k double").repartition(partitions)
    got = fusion.fuse([(one, "v", 0.65), (two, "k", 0.35)], 20, 60).collect()
    assert [r["seq"] for r in got] == expected
    assert [r["score"] for r in got] == pytest.approx([fused[n] for n in expected], abs=1e-12)


def test_unusable_vectors_end_the_job_or_are_left_out_on_request(spark):
    frame = spark.createDataFrame(
        [(1, [0.0, 3.0]), (2, [1.0]), (3, None), (4, [4.0, 0.0]), (5, [float("nan"), 1.0])], "seq long, embedding array<float>"
    )
    for unusable in (2, 3, 5):
        with pytest.raises(Exception, match="vectors of a batch"):
            vector.vector_scores(frame.filter(f"seq in (1, {unusable})"), [0.0, 0.0]).collect()
    got = {r["seq"]: r["distance"] for r in vector.l2_distances(frame, [0.0, 0.0], skip_unusable=True).collect()}
    assert got == pytest.approx({1: 3.0, 4: 4.0})
    same = vector.cosine_similarities(frame.filter("seq in (1, 4)"), [0.0, 0.0])
    assert [r["similarity"] for r in same.collect()] == [None, None]  # a zero query has no direction


OPERATORS = [
    ("equal", {"value": 25}, True), ("not_equal", {"value": 25}, False), ("less_than", {"value": 30}, True), ("less_than_or_equal", {"value": 25}, True),
    ("greater_than", {"value": 30}, False), ("greater_than_or_equal", {"value": "25"}, True), ("between", {"low": 20, "high": 30}, True), ("exists", {}, True),
    ("equal", {"value": "many"}, False),
]


def offer_tables(spark):
    frame = spark.createDataFrame(
        [(1, "c1", "s1", "Offer price $25 published 2026-01-02", None, None, "a.txt", "txt", "/d/a.txt", "indexed", None)],
        "seq long, chunk_id string, source_id string, text string, heading string, section_path string, filename string, extension string, path string, status string, deleted_at timestamp",
    )
    return DocumentTables(frame, extract_facts(frame.select("chunk_id", "text")), keyword_links(frame))


@pytest.mark.parametrize("op,operands,expected", OPERATORS)
def test_numeric_operators(spark, op, operands, expected):
    tables = offer_tables(spark)
    kept, applied, _ = filter_chunks(tables.chunks, tables.facts, None, SearchFilters(numeric=(NumericFilter("Cost", op, **operands),)))
    assert bool(kept.count()) is expected and applied == [f"Cost {op}"]


def test_search_reports_filters_and_truncates(spark):
    tables = offer_tables(spark)
    wanted = SearchFilters(
        source_extensions=(".TXT",), numeric=(NumericFilter("price", "equal", 25, currency="usd"), NumericFilter("colour", "exists")),
        keywords=(" OFFER",), path_prefix="/d/",
    )
    found = search(tables, SearchRequest("offer", "keyword", filters=wanted), Settings(context_chars=5))
    row = found.results.first()
    assert row["text"] == "Offer" and row["truncated"] and row["source_link"] == "file:///d/a.txt"
    assert found.skipped_filters[0]["field"] == "colour" and len(found.applied_filters) == 4
    assert [f["field"] for f in row["metadata_facts"]] == ["price", "published_date"]
    assert search(tables, SearchRequest("offer", "keyword", filters=SearchFilters(numeric=(NumericFilter("price", "equal", 25, currency="EUR"),)))).results.count() == 0
    assert search(tables, SearchRequest("", "keyword")).results.count() == 0


def card_frame(spark, *items):
    ddl = (
        "card_id string, title string, category string, subcategory string, description string, positive_text string, negative_text string, "
        "method_texts array<string>, inputs array<string>, outputs array<string>, codes array<string>, confidence double"
    )
    return spark.createDataFrame([(i, "Breadth search", "graph", "", "Explores level by level", "p", "n", [], [], [], [], c) for i, c in items], ddl)


@pytest.mark.parametrize("perspective,missing,expected", [("general", None, 0.48), ("expert", None, 0.896), ("expert", "positive", 0.48), ("expert", "negative", 0.48)])
def test_card_formula(spark, perspective, missing, expected):
    vectors = {"description": [0.6, 0.8], "positive": [1.0, 0.0], "negative": [0.0, 1.0]}
    frame = spark.createDataFrame([("a", k, v) for k, v in vectors.items() if k != missing], "card_id string, field_type string, embedding array<float>")
    scores = cards.semantic_scores(card_frame(spark, ("a", 0.8)), frame, [1.0, 0.0], perspective, 0.0)
    assert scores.first()["vector_score"] == pytest.approx(expected, abs=1e-6)
    assert cards.semantic_scores(card_frame(spark, ("a", 0.8)), frame, [1.0, 0.0], "general", 0.5).count() == 0


def test_card_confidence_prunes_and_ranks(spark):
    frame = card_frame(spark, ("high", 1.0), ("low", 0.1))
    vectors = spark.createDataFrame([(c, "description", [1.0, 0.0]) for c in ("high", "low")], "card_id string, field_type string, embedding array<float>")

    def run(minimum):
        semantic = cards.semantic_scores(frame, vectors, [1.0, 0.0], "general", minimum)
        return cards.retrieve_cards(semantic, cards.lexical_scores(frame, "exploring levels", minimum), True, 3).collect()

    assert [r["card_id"] for r in run(0.65)] == ["high"]
    assert [(r["card_id"], r["rank_score"]) for r in run(0.0)] == [("high", pytest.approx(2 / 61)), ("low", pytest.approx(2 / 62))]


class Unavailable(HashEmbedder):
    def query(self, text):
        raise EmbeddingUnavailable()


def test_corpus_mixes_kinds_and_reports_failures(spark):
    tables = offer_tables(spark)
    tables.vectors = tables.chunks.select("seq", HashEmbedder().column(F.col("text")).alias("embedding"))
    frame = card_frame(spark, ("a", 0.9))
    members = {
        "docs": CorpusCollection("general", HashEmbedder(), tables),
        "code": CorpusCollection("source_code", HashEmbedder(), tables),
        "cards": CorpusCollection("knowledge_cards", Unavailable(), cards=frame, card_vectors=cards.card_vectors(frame, HashEmbedder())),
        "broken": CorpusCollection("general", Unavailable(), tables),
    }
    answer = corpus_query(members, CorpusQuery("offer level", ("docs", "code", "cards", "broken", "absent"), perspective="expert"))
    rows = answer.results.orderBy("rank").collect()
    assert [(r["collection"], r["kind"], r["rank"]) for r in rows] == [("cards", "knowledge_card", 1), ("code", "source_code", 2), ("docs", "document", 3)]
    assert {r["fusion_score"] for r in rows} == {1 / 61}
    codes = [w["code"] for w in answer.warnings]
    assert codes.count("PERSPECTIVE_NOT_APPLICABLE") == 3
    assert {"KEYWORD_FALLBACK", "EMBEDDING_UNAVAILABLE", "COLLECTION_NOT_FOUND"} <= set(codes)
    assert [o["score_policy"] for o in answer.effective_options] == ["weighted_rrf", "weighted_rrf", "confidence_weighted"]
    unknown = CorpusQuery("offer", ("docs",), filters=SearchFilters(numeric=(NumericFilter("colour", "exists"),)))
    assert corpus_query(members, unknown).warnings[0]["code"] == "CONFIG_INVALID"
    assert corpus_describe(members)[1]["perspectives"] == ["general", "expert"] if corpus_describe(members)[1]["kind"] == "knowledge_cards" else True


@pytest.mark.parametrize("build", [lambda: NumericFilter("a", "between", low=1), lambda: NumericFilter("a", "equal"), lambda: CorpusQuery(" "), lambda: SearchRequest(mode="x")])
def test_requests_are_validated(build):
    with pytest.raises(FolioError):
        build()
