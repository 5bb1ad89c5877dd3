"""One question over several collections of different kinds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.functions.facts import FIELDS
from folionaut.operators import cards as card_operators
from folionaut.operators.filters import resolve_field
from folionaut.plans.requests import CorpusQuery, SearchRequest
from folionaut.plans.search import DocumentTables, search
from folionaut.settings import FolioError, Settings

# What the score of each mode means.
SCORE_POLICY = {"keyword": "bm25_strength", "semantic": "inverse_l2", "hybrid": "weighted_rrf", "structured": "constant_match"}


class EmbeddingUnavailable(FolioError):
    def __init__(self, message: str = "embedding model unavailable"):
        super().__init__("EMBEDDING_UNAVAILABLE", message)


@dataclass
class CorpusCollection:
    """A named member of the corpus: document tables, or cards with their vectors."""

    kind: str  # general, source_code or knowledge_cards
    embedder: object
    documents: DocumentTables | None = None
    cards: DataFrame | None = None
    card_vectors: DataFrame | None = None
    description: str = ""


@dataclass
class CorpusAnswer:
    results: DataFrame | None
    warnings: list[dict] = field(default_factory=list)
    collections_searched: list[str] = field(default_factory=list)
    effective_options: list[dict] = field(default_factory=list)


RESULT_COLUMNS = ("kind", "collection", "title", "score", "vector_score", "keyword_score", "citation_label", "content", "collection_rank", "fusion_score")


def _card_results(name: str, member: CorpusCollection, request: CorpusQuery, limit: int, settings: Settings, warnings: list) -> DataFrame:
    if request.mode == "structured" or request.filters.any():
        raise FolioError("CONFIG_INVALID", "cards do not support document filters")
    minimum = settings.card_min_similarity if request.minimum_score is None else request.minimum_score
    semantic = lexical = None
    if request.mode != "keyword":
        try:
            vector = member.embedder.query(request.query)
            semantic = card_operators.semantic_scores(member.cards, member.card_vectors, vector, request.perspective, minimum, settings)
        except EmbeddingUnavailable:
            if request.mode != "hybrid":
                raise
            warnings.append({"collection": name, "code": "KEYWORD_FALLBACK"})
    if request.mode != "semantic":
        lexical = card_operators.lexical_scores(member.cards, request.query, minimum)
    found = card_operators.retrieve_cards(semantic, lexical, request.mode == "hybrid", limit, settings.rrf_k)
    rows = member.cards.join(F.broadcast(found), "card_id")
    order = ([F.desc("rank_score")] if request.mode == "hybrid" else []) + [F.desc("score"), F.asc("card_id")]
    content = F.col("description") if request.include_text else F.lit(None).cast("string")
    return rows.select(
        F.lit("knowledge_card").alias("kind"), F.lit(name).alias("collection"), "title", "score", "vector_score", "keyword_score",
        F.col("title").alias("citation_label"), content.alias("content"), F.row_number().over(_window(order)).alias("collection_rank"),
    )


def _window(order):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # over at most max_top_k rows


def _document_results(name: str, member: CorpusCollection, request: CorpusQuery, limit: int, settings: Settings) -> DataFrame:
    if any(resolve_field(wanted.field) is None for wanted in request.filters.numeric):
        raise FolioError("CONFIG_INVALID", "a numeric filter field is unknown to this collection")
    mode = "vector" if request.mode == "semantic" else request.mode
    asked = SearchRequest(request.query, mode, settings.max_top_k, request.filters, request.include_text, request.include_links)
    found = search(member.documents, asked, settings, member.embedder).results
    if request.minimum_score is not None:
        found = found.filter(F.col("score") >= request.minimum_score)
    kind = "source_code" if member.kind == "source_code" else "document"
    rank = F.row_number().over(_window([F.desc("score"), F.asc("seq")]))
    return found.select(
        F.lit(kind).alias("kind"), F.lit(name).alias("collection"), F.coalesce("heading", "source_filename").alias("title"),
        "score", "vector_score", "keyword_score", "citation_label", F.col("text").alias("content"), rank.alias("collection_rank"),
    ).filter(F.col("collection_rank") <= limit)


def corpus_query(collections: dict[str, CorpusCollection], request: CorpusQuery, settings: Settings = Settings()) -> CorpusAnswer:
    """Ranks inside each collection are merged; raw scores of different collections are never compared."""
    names = list(dict.fromkeys(request.collections if request.collections is not None else sorted(collections)))
    limit = settings.limit(request.limit)
    answer, merged = CorpusAnswer(None), None
    for name in names:
        member = collections.get(name)
        try:
            if member is None:
                raise FolioError("COLLECTION_NOT_FOUND", name)
            is_card = member.kind == "knowledge_cards"
            if request.perspective == "expert" and not is_card:
                answer.warnings.append({"collection": name, "code": "PERSPECTIVE_NOT_APPLICABLE"})
            if is_card:
                part = _card_results(name, member, request, limit, settings, answer.warnings)
            else:
                part = _document_results(name, member, request, limit, settings)
        except FolioError as error:
            answer.warnings.append({"collection": name, "code": error.code, "message": str(error)})
            continue
        answer.collections_searched.append(name)
        minimum = request.minimum_score
        if minimum is None and is_card:
            minimum = settings.card_min_similarity
        answer.effective_options.append(
            {
                "collection": name, "mode": request.mode, "perspective": request.perspective if is_card else "general", "minimum_score": minimum,
                "score_policy": "confidence_weighted" if is_card else SCORE_POLICY[request.mode],
            }
        )
        part = part.withColumn("fusion_score", 1.0 / (settings.rrf_k + F.col("collection_rank"))).select(*RESULT_COLUMNS)
        merged = part if merged is None else merged.unionByName(part)
    if merged is not None:
        best = merged.orderBy(F.desc("fusion_score"), "collection", "collection_rank").limit(limit)
        place = F.row_number().over(_window([F.desc("fusion_score"), F.asc("collection"), F.asc("collection_rank")]))
        answer.results = best.withColumn("rank", place)
    return answer


def corpus_describe(collections: dict[str, CorpusCollection], names: list[str] | None = None) -> list[dict]:
    """What each collection can be asked."""
    out = []
    for name in sorted(collections) if names is None else names:
        member = collections[name]
        is_card = member.kind == "knowledge_cards"
        out.append(
            {
                "name": name, "kind": member.kind, "description": member.description,
                "modes": ["keyword", "semantic", "hybrid"] + ([] if is_card else ["structured"]),
                "perspectives": ["general", "expert"] if is_card else ["general"],
                "filters": [] if is_card else ["source_extensions", "numeric", "keywords", "path_prefix", "source_ids"],
                "fields": [] if is_card else [{"canonical_name": f, "value_type": kind} for f, (kind, _) in FIELDS.items()],
                "graph_traversal": member.kind == "source_code",
            }
        )
    return out
