"""Whole requests: evidence of the best chunks, and one question over several collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions.embedding import HashEmbedder
from folionaut.functions.facts import extract_facts
from folionaut.operators import vocabulary
from folionaut.plans.corpus import CorpusCollection, corpus_query
from folionaut.plans.requests import CorpusQuery, NumericFilter, SearchFilters, SearchRequest
from folionaut.plans.search import DocumentTables, search
from folionaut.settings import Settings
from suite.cards import LEXICAL_SQL, QUESTION, part_cards
from suite.registry import DOCUMENTS_SQL, documents, query
from suite.structured import OFFERS_SQL, offers


@query(
    "search_with_evidence",
    "WITH" + OFFERS_SQL + """, texts AS (
  SELECT p_partkey AS seq, p_brand || '.txt' AS filename, printf('%s: Price: $%.2f for size %d. Rating %d.%d, published %s', p_name, p_retailprice, p_size,
         p_size % 5, p_size % 10, strftime(DATE '2020-01-01' + (p_partkey % 1000)::INTEGER, '%Y-%m-%d')) AS text FROM part)
SELECT seq, 1.0::DOUBLE AS score, substr(text, 1, 24) AS text, true AS truncated, filename AS citation_label,
       'file:///parts/' || replace(split_part(path, '/', 3), '#', '%23') || '/' || seq AS source_link,
       'price=' || price::DOUBLE || ' USD;published_date=' || day AS facts
FROM offers JOIN texts USING (seq) WHERE price BETWEEN 910 AND 990 AND list_contains(string_split(name, ' '), 'red') ORDER BY seq LIMIT 50""",
)
def search_with_evidence(spark, folder):
    rows = offers(spark, folder).withColumns({"status": F.lit("indexed"), "deleted_at": F.lit(None).cast("timestamp")})
    tables = DocumentTables(rows, extract_facts(rows.select("chunk_id", "text")), vocabulary.keyword_links(rows))
    wanted = SearchFilters(numeric=(NumericFilter("price", "between", low=910, high=990),), keywords=("red",))
    found = search(tables, SearchRequest(mode="structured", top_k=50, filters=wanted), Settings(context_chars=24)).results
    fact = lambda f: F.concat_ws(
        " ", F.concat(f["field"], F.lit("="), F.coalesce(f["normalized_date_utc"], f["normalized_number"].cast("string"))), f["currency_code"]
    )
    shown = F.filter("metadata_facts", lambda f: f["field"] != "rating")
    return found.select(
        "seq", "score", "text", "truncated", "citation_label", "source_link", F.array_join(F.transform(shown, fact), ";").alias("facts")
    )


LANGUAGES = ("de", "en", "es", "fr")
WORDS = "thtion the mentre blue widgets for small sizes"
CORPUS_TOP = 50


@query(
    "corpus_keyword_query",
    "WITH" + DOCUMENTS_SQL.replace("docs AS", "docs_ AS").replace("FROM docs)", "FROM docs_)") + "," + LEXICAL_SQL.replace("('blue', 'widget', 'for', 'small', 'size')", "('thtion', 'the', 'mentr', 'blue', 'widget', 'for', 'small', 'size')") + r""",
dtoks AS (SELECT seq, lang, candidate, regexp_extract_all(strip_accents(lower(text || ' ' || filename)), '[\p{L}\p{N}]+') AS t FROM rows_),
dstats AS (SELECT lang, count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM dtoks GROUP BY lang),
dhits AS (
  SELECT seq, lang, candidate, len(t) AS dl, q, len(list_filter(t, lambda x: x = q)) AS tf FROM dtoks,
  (VALUES ('thtion'), ('the'), ('mentre'), ('blue'), ('widgets'), ('for'), ('small'), ('sizes')) v(q)),
dfound AS (SELECT *, count(*) OVER (PARTITION BY q, lang)::DOUBLE AS df FROM dhits WHERE tf > 0),
dscores AS (
  SELECT lang, seq, candidate, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM dfound JOIN dstats USING (lang) GROUP BY ALL),
dranked AS (SELECT lang AS collection, 'document' AS kind, seq, s, row_number() OVER (PARTITION BY lang ORDER BY s DESC, seq) AS r FROM dscores WHERE candidate AND lang IN ('de', 'en', 'es', 'fr')),
cranked AS (SELECT 'parts' AS collection, 'knowledge_card' AS kind, card_id AS seq, score AS s, row_number() OVER (ORDER BY score DESC, card_id) AS r FROM lexical WHERE score >= 0.2),
every_ AS (SELECT * FROM dranked UNION ALL SELECT * FROM cranked)
SELECT collection, kind, r::INTEGER AS collection_rank, round(s, 6) AS score, (row_number() OVER (ORDER BY r, collection))::INTEGER AS rank
FROM every_ WHERE r <= 50 AND (kind <> 'document' OR s >= 0.2) ORDER BY r, collection LIMIT 50""",
)
def corpus_keyword_query(spark, folder):
    rows = documents(spark, folder).withColumn("deleted_at", F.when(F.col("deleted"), F.current_timestamp()))
    members = {
        lang: CorpusCollection("general", HashEmbedder(), DocumentTables(rows.filter(F.col("lang") == lang))) for lang in LANGUAGES
    }
    members["parts"] = CorpusCollection("knowledge_cards", HashEmbedder(), cards=part_cards(spark, folder))
    asked = CorpusQuery(WORDS, (*LANGUAGES, "parts", "absent"), mode="keyword", limit=CORPUS_TOP, minimum_score=0.2)
    found = corpus_query(members, asked).results
    return found.select("collection", "kind", "collection_rank", F.round("score", 6).alias("score"), "rank")


@query("corpus_hybrid_query")
def corpus_hybrid_query(spark, folder):
    """Documents by weighted, cards by unweighted rank fusion, merged by rank in their collection."""
    embedder = HashEmbedder()
    rows = documents(spark, folder).withColumn("deleted_at", F.when(F.col("deleted"), F.current_timestamp()))
    vectors = rows.select("seq", embedder.column(F.col("text")).alias("embedding"))
    cards = part_cards(spark, folder)
    from folionaut.operators.cards import card_vectors

    members = {
        "documents": CorpusCollection("general", embedder, DocumentTables(rows, vectors=vectors)),
        "parts": CorpusCollection("knowledge_cards", embedder, cards=cards, card_vectors=card_vectors(cards, embedder)),
    }
    asked = CorpusQuery(QUESTION, mode="hybrid", perspective="expert", limit=20)
    return corpus_query(members, asked).results.select("collection", "kind", "title", "collection_rank", "score", "rank")
