"""Cards made from the parts table: retrieval by meaning, by words, and by both."""

from __future__ import annotations

from pyspark.sql import functions as F

from folionaut.functions.embedding import HashEmbedder
from folionaut.operators import cards as C
from suite.registry import query, table
from suite.retrieval import hash_vector_sql

QUESTION = "blue widgets for small sizes"
QUESTION_VECTOR = HashEmbedder().query(QUESTION)
QUESTION_SQL = "[" + ", ".join(repr(x) for x in QUESTION_VECTOR) + "]::DOUBLE[]"


def part_cards(spark, folder):
    part = table(spark, folder, "part", "p_partkey")
    size = F.col("p_size").cast("int")
    return part.select(
        F.col("p_partkey").alias("card_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.format_string("%s made by %s in size %d", "p_name", "p_brand", size).alias("description"),
        F.when(size % 3 != 0, F.format_string("fits size %d or larger", size)).alias("positive_text"),
        F.when(size % 5 != 0, F.format_string("not for sizes below %d", size)).alias("negative_text"),
        F.array(F.concat(F.lit("fit "), "p_name")).alias("method_texts"),
        F.array().cast("array<string>").alias("inputs"),
        F.array().cast("array<string>").alias("outputs"),
        F.when(size % 2 == 0, F.array(F.format_string("fit(%d)", size), F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("codes"),
        ((F.col("p_partkey") % 10 + 1) / 10.0).alias("confidence"),
    )


CARDS_SQL = """
cards AS (
  SELECT p_partkey AS card_id, p_name AS title, p_type AS category, p_brand AS subcategory, (p_partkey % 10 + 1) / 10.0 AS confidence,
         p_name || ' made by ' || p_brand || ' in size ' || p_size AS description,
         CASE WHEN p_size % 3 <> 0 THEN 'fits size ' || p_size || ' or larger' END AS positive_text,
         CASE WHEN p_size % 5 <> 0 THEN 'not for sizes below ' || p_size END AS negative_text,
         'fit ' || p_name AS method_text, CASE WHEN p_size % 2 = 0 THEN 'fit(' || p_size || ')' ELSE '' END AS code_text
  FROM part)"""


@query(
    "card_field_texts",
    "WITH" + CARDS_SQL + """ SELECT card_id, 'description' AS field_type, description AS text FROM cards
    UNION ALL SELECT card_id, 'positive', positive_text FROM cards WHERE positive_text IS NOT NULL
    UNION ALL SELECT card_id, 'negative', negative_text FROM cards WHERE negative_text IS NOT NULL
    UNION ALL SELECT card_id, 'code', code_text || chr(10) || chr(10) || ' ' FROM cards WHERE code_text <> ''""",
)
def card_field_texts(spark, folder):
    return C.field_texts(part_cards(spark, folder))


def similarity_sql(text: str) -> str:
    return f"CASE WHEN {text} IS NOT NULL THEN list_cosine_similarity({hash_vector_sql(text)}, {QUESTION_SQL}) END"


SIMILAR_SQL = CARDS_SQL + f""",
sims AS (SELECT *, {similarity_sql('description')} AS d, {similarity_sql('positive_text')} AS p, {similarity_sql('negative_text')} AS n FROM cards),
semantic AS (
  SELECT card_id, confidence * d AS general,
         confidence * CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN p - 0.3 * n + 0.2 * d ELSE d END AS expert FROM sims)"""


def semantic(spark, folder, perspective, minimum):
    cards, embedder = part_cards(spark, folder), HashEmbedder()
    return C.semantic_scores(cards, C.card_vectors(cards, embedder), QUESTION_VECTOR, perspective, minimum)


for perspective in ("general", "expert"):
    query(
        f"card_{perspective}_scores",
        "WITH" + SIMILAR_SQL + f" SELECT card_id, round({perspective}, 6) AS score FROM semantic WHERE {perspective} >= 0.5",
    )(
        lambda spark, folder, perspective=perspective: semantic(spark, folder, perspective, 0.5).select(
            "card_id", F.round("vector_score", 6).alias("score")
        )
    )

# The words of the question and of the cards with their stems, where a stem differs from the word.
LEXICAL_SQL = SIMILAR_SQL + """,
words AS (
  SELECT card_id, unnest(t) AS word FROM (
    SELECT card_id, regexp_extract_all(lower(concat_ws(' ', title, category, subcategory, description, positive_text, negative_text, method_text, code_text)), '[a-z0-9]+') AS t FROM cards)),
stems AS (SELECT card_id, CASE word WHEN 'fits' THEN 'fit' WHEN 'sizes' THEN 'size' WHEN 'widgets' THEN 'widget' ELSE word END AS term FROM words),
lens AS (SELECT card_id, count(*) AS dl FROM stems GROUP BY card_id),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens),
tfs AS (SELECT card_id, term, count(*) AS tf FROM stems WHERE term IN ('blue', 'widget', 'for', 'small', 'size') GROUP BY ALL),
hits AS (SELECT *, count(*) OVER (PARTITION BY term)::DOUBLE AS df FROM tfs),
bm AS (
  SELECT card_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS strength
  FROM hits JOIN lens USING (card_id), stats GROUP BY card_id),
lexical AS (SELECT card_id, strength / max(strength) OVER () * confidence AS score FROM bm JOIN cards USING (card_id))"""


@query("card_lexical_scores", "WITH" + LEXICAL_SQL + " SELECT card_id, round(score, 6) AS score FROM lexical WHERE score >= 0.3")
def card_lexical_scores(spark, folder):
    scores = C.lexical_scores(part_cards(spark, folder), QUESTION, 0.3)
    return scores.select("card_id", F.round("keyword_score", 6).alias("score"))


@query(
    "card_hybrid_topk",
    "WITH" + LEXICAL_SQL + """,
both_ AS (
  SELECT card_id, round(expert, 9) AS s, row_number() OVER (ORDER BY round(expert, 9) DESC, card_id) AS r FROM semantic WHERE round(expert, 9) >= 0.3
  UNION ALL SELECT card_id, round(score, 9), row_number() OVER (ORDER BY round(score, 9) DESC, card_id) FROM lexical WHERE round(score, 9) >= 0.3)
SELECT card_id, round(sum(1.0 / (60 + r)), 9) AS rank_score, round(max(s), 6) AS score FROM both_ GROUP BY card_id
ORDER BY round(sum(1.0 / (60 + r)), 12) DESC, max(s) DESC, card_id LIMIT 50""",
)
def card_hybrid_topk(spark, folder):
    """Scores are rounded before they are ranked: sums of floats differ in their last bit from run to run."""
    # A little below the threshold, so that it is asked of the rounded scores.
    lexical = C.lexical_scores(part_cards(spark, folder), QUESTION, 0.29).withColumn("keyword_score", F.round("keyword_score", 9))
    vectors = semantic(spark, folder, "expert", 0.29).withColumn("vector_score", F.round("vector_score", 9))
    found = C.retrieve_cards(vectors.where("vector_score >= 0.3"), lexical.where("keyword_score >= 0.3"), True, 50)
    return found.select("card_id", F.round("rank_score", 9).alias("rank_score"), F.round("score", 6).alias("score"))


@query(
    "card_semantic_topk",
    "WITH" + SIMILAR_SQL + " SELECT card_id, round(expert, 6) AS score FROM semantic WHERE expert >= 0.65 ORDER BY expert DESC, card_id LIMIT 50",
)
def card_semantic_topk(spark, folder):
    found = C.retrieve_cards(semantic(spark, folder, "expert", 0.65), None, False, 50)
    return found.select("card_id", F.round("score", 6).alias("score"))
