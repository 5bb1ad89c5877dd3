"""Curated cards: one vector per text field, scores weighted by the author's confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.porter import stem, stem_token_lists
from folionaut.functions.text import query_phrases
from folionaut.operators import bm25, fusion, vector
from folionaut.operators.durable import durable
from folionaut.settings import Settings

FIELD_TYPES = ("description", "positive", "negative", "code")
CARD_TEXT_COLUMNS = (
    "title", "category", "subcategory", "description", "positive_text", "negative_text",
    "method_text", "input_text", "output_text", "code_text",
)


def with_text_columns(cards: DataFrame) -> DataFrame:
    """List columns joined to text, as the keyword index sees them."""
    joined = {"method_text": "method_texts", "input_text": "inputs", "output_text": "outputs", "code_text": "codes"}
    return cards.withColumns({name: F.array_join(source, "\n") for name, source in joined.items()})


def field_texts(cards: DataFrame) -> DataFrame:
    """(card_id, field_type, text): the description always, other fields when they say something."""

    def part(kind: str, text: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(kind).alias("field_type"), text.alias("text")))

    def said(text: Column) -> Column:
        return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))

    parts = F.array(
        part("description", F.col("description"), F.lit(True)),
        part("positive", F.col("positive_text"), said(F.col("positive_text"))),
        part("negative", F.col("negative_text"), said(F.col("negative_text"))),
        part("code", F.array_join("codes", "\n\n"), F.coalesce(F.exists("codes", said), F.lit(False))),
    )
    return cards.select("card_id", F.inline(F.array_compact(parts)))


def card_vectors(cards: DataFrame, embedder) -> DataFrame:
    return field_texts(cards).select("card_id", "field_type", embedder.column(F.col("text")).alias("embedding"))


def raw_similarity(perspective: str, alpha: float, beta: float) -> Column:
    """From the columns description, positive and negative; experts weigh applicability when both sides are known."""
    plain = F.col("description")
    if perspective == "general":
        return plain
    expert = F.col("positive") - alpha * F.col("negative") + beta * plain
    return F.when(F.col("positive").isNotNull() & F.col("negative").isNotNull(), expert).otherwise(plain)


def semantic_scores(
    cards: DataFrame, vectors: DataFrame, query: list[float], perspective: str, minimum: float, settings: Settings = Settings()
) -> DataFrame:
    """(card_id, vector_score) at or above the minimum; a card has at most four vectors."""
    similar = vector.cosine_similarities(vectors, query, keys=("card_id", "field_type"))
    pivoted = similar.groupBy("card_id").agg(
        *[F.max(F.when(F.col("field_type") == kind, F.col("similarity"))).alias(kind) for kind in FIELD_TYPES]
    )
    raw = raw_similarity(perspective, settings.card_alpha, settings.card_beta)
    scored = cards.select("card_id", "confidence").join(pivoted, "card_id").select(
        "card_id", (raw * F.col("confidence")).alias("vector_score")
    )
    return scored.filter((F.col("vector_score") >= minimum) & ~F.isnan("vector_score"))


def lexical_scores(cards: DataFrame, query: str, minimum: float, all_cards: DataFrame | None = None) -> DataFrame:
    """(card_id, keyword_score): stemmed BM25 relative to the strongest hit, times confidence.

    ``all_cards`` are the indexed rows behind the statistics when they are more than the candidates.
    """
    indexed = with_text_columns(all_cards if all_cards is not None else cards)
    listed = indexed.select("card_id", bm25.token_lists(CARD_TEXT_COLUMNS).alias("lists"))
    phrases = [tuple(stem(word) for word in phrase) for phrase in query_phrases(query)]
    strengths = bm25.scores_of_lists(stem_token_lists(listed, "card_id"), phrases, "card_id")
    hits = durable(strengths.join(cards.select("card_id", "confidence"), "card_id"))
    strongest = hits.agg(F.max("keyword_score")).scalar()
    scored = hits.select("card_id", (F.col("keyword_score") / strongest * F.col("confidence")).alias("keyword_score"))
    return scored.filter(F.col("keyword_score") >= minimum)


def retrieve_cards(
    semantic: DataFrame | None, lexical: DataFrame | None, hybrid: bool, k: int, rrf_k: int = Settings.rrf_k
) -> DataFrame:
    """Top k cards: (card_id, score, rank_score, vector_score, keyword_score).

    Ranks are fused without weights; the reported score is the better channel's. Hybrid results are ordered by
    fused rank, single-channel results by score; ties by score, then id.
    """
    channels = [(durable(frame), name) for frame, name in ((semantic, "vector_score"), (lexical, "keyword_score")) if frame is not None]
    fused = fusion.fused_candidates([(frame, name, 1.0) for frame, name in channels], k, rrf_k, "card_id")
    found = fused.withColumnRenamed("score", "rank_score")
    for frame, name in channels:
        found = found.join(frame.select("card_id", name), "card_id", "left")
    for name in ("vector_score", "keyword_score"):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast("double"))
    scored = found.withColumn("score", F.greatest("vector_score", "keyword_score"))
    order = [F.desc("rank_score")] if hybrid else []
    return scored.orderBy(*order, F.desc("score"), "card_id").limit(k).select(
        "card_id", "score", "rank_score", "vector_score", "keyword_score"
    )
