"""Search over one document collection: filter, score, rank, and attach the evidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.text import citation_label, query_phrases
from folionaut.operators import bm25, fusion, vector
from folionaut.operators.filters import filter_chunks
from folionaut.plans.requests import SearchRequest
from folionaut.settings import Settings

SPAN_COLUMNS = (
    "page_start", "page_end", "slide_start", "slide_end", "time_start_ms", "time_end_ms", "line_start", "line_end", "percent_position",
)


@dataclass
class DocumentTables:
    """What a search reads. ``chunks`` hold all indexed rows with their source's columns.

    Needed in chunks: seq, chunk_id, source_id, text, heading, section_path, filename, extension, path,
    status, deleted_at. Without ``postings`` keyword scores come from the text. ``texts`` are the same rows without
    their source's columns, and ``sources`` (source_id, status, deleted_at) has these: the few ranked rows are then
    taken from the texts before any join.
    """

    chunks: DataFrame
    facts: DataFrame | None = None
    keywords: DataFrame | None = None
    vectors: DataFrame | None = None  # seq, embedding
    postings: DataFrame | None = None
    statistics: DataFrame | None = None
    texts: DataFrame | None = None
    sources: DataFrame | None = None


@dataclass
class SearchResult:
    results: DataFrame
    applied_filters: list[str] = field(default_factory=list)
    skipped_filters: list[dict] = field(default_factory=list)


def file_uri(path: Column) -> Column:
    """file:// link of an absolute path; every character but the unreserved ones is escaped."""
    escaped = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.when(path.startswith("/"), F.concat(F.lit("file://"), escaped))


CARRIED = ("chunk_id", "source_id", "extension", "path", "status", "deleted_at")


def candidates_of(tables: DocumentTables, rows: DataFrame, request: SearchRequest) -> tuple[DataFrame, list[str], list[dict]]:
    """Those of the rows that are live and pass the filters; works on chunks and on scored rows alike."""
    live = rows.filter((F.col("status") == "indexed") & F.col("deleted_at").isNull())
    return filter_chunks(live, tables.facts, tables.keywords, request.filters)


def ranked(tables: DocumentTables, candidates: DataFrame, request: SearchRequest, settings: Settings, embedder, k: int) -> DataFrame:
    """(seq, score, vector_score, keyword_score) of the best k candidates."""
    none = F.lit(None).cast("double")
    if request.mode == "structured":
        return candidates.select("seq", F.lit(1.0).alias("score"), none.alias("vector_score"), none.alias("keyword_score")).orderBy("seq").limit(k)
    channels = {}
    if request.mode in ("vector", "hybrid"):
        allowed = tables.vectors.join(candidates.select("seq"), "seq", "left_semi")
        channels["vector_score"] = vector.vector_scores(allowed, embedder.query(request.query))
    if request.mode == "keyword" or (request.mode == "hybrid" and query_phrases(request.query)):
        if tables.postings is not None:
            scores = bm25.indexed_keyword_scores(tables.postings, tables.statistics, request.query)
            channels["keyword_score"] = scores.join(candidates.select("seq"), "seq", "left_semi")
        else:
            scored = bm25.keyword_scores(tables.chunks, request.query, carry=CARRIED)
            channels["keyword_score"] = candidates_of(tables, scored, request)[0].select("seq", "keyword_score")
    if request.mode != "hybrid":
        (name, scores), = channels.items()
        best = fusion.top_k(scores, name, k).withColumn("score", F.col(name))
    else:
        weights = {"vector_score": settings.vector_weight, "keyword_score": settings.keyword_weight}
        kept = {name: fusion.durable(scores) for name, scores in channels.items()}
        fused = fusion.fused_candidates([(frame, name, weights[name]) for name, frame in kept.items()], k, settings.rrf_k)
        best = fusion.top_k(fused, "score", k)
        for name, frame in kept.items():
            best = best.join(frame, "seq", "left")
    for name in ("vector_score", "keyword_score"):
        if name not in best.columns:
            best = best.withColumn(name, none)
    return best.select("seq", "score", "vector_score", "keyword_score")


def search(tables: DocumentTables, request: SearchRequest, settings: Settings = Settings(), embedder=None) -> SearchResult:
    candidates, applied, skipped = candidates_of(tables, tables.chunks, request)
    # Ranking runs once; its few rows then select the evidence.
    best = fusion.durable(ranked(tables, candidates, request, settings, embedder, settings.limit(request.top_k)))
    return SearchResult(assemble(tables, best, request, settings), applied, skipped)


def assemble(tables: DocumentTables, best: DataFrame, request: SearchRequest, settings: Settings) -> DataFrame:
    """Text, anchors, facts and keywords of the ranked chunks. At most ``max_top_k`` rows are broadcast."""
    if tables.texts is not None:
        rows = tables.texts.join(F.broadcast(best), "seq").join(tables.sources, "source_id")
    else:
        rows = tables.chunks.join(F.broadcast(best), "seq")
    rows = fusion.durable(rows)
    for name in SPAN_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("int"))
    chosen = F.broadcast(rows.select("chunk_id"))
    if tables.facts is not None:
        shown = ("field", "raw_value", "normalized_number", "normalized_date_utc", "currency_code", "unit", "confidence")
        facts = tables.facts.join(chosen, "chunk_id", "left_semi").groupBy("chunk_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("fact_order", *shown))), lambda f: f.dropFields("fact_order")).alias("metadata_facts")
        )
        rows = rows.join(facts, "chunk_id", "left")
    if tables.keywords is not None:
        words = tables.keywords.join(chosen, "chunk_id", "left_semi").groupBy("chunk_id").agg(
            F.array_sort(F.collect_set("term")).alias("matched_keywords")
        )
        rows = rows.join(words, "chunk_id", "left")
    text = F.substring("text", 1, settings.context_chars) if request.include_text else F.lit(None).cast("string")
    truncated = F.length("text") > settings.context_chars if request.include_text else F.lit(False)
    label = citation_label(F.col("filename"), *[F.col(name) for name in SPAN_COLUMNS[:4]], F.col("line_start"), F.col("line_end"), F.col("time_start_ms"), F.col("percent_position"))
    extra = [name for name in ("metadata_facts", "matched_keywords") if name in rows.columns]
    return rows.select(
        "seq", "chunk_id", "source_id", "score", "vector_score", "keyword_score",
        text.alias("text"), truncated.alias("truncated"), "heading", "section_path",
        F.col("filename").alias("source_filename"), F.col("path").alias("source_path"),
        (file_uri(F.col("path")) if request.include_links else F.lit(None).cast("string")).alias("source_link"),
        *SPAN_COLUMNS, label.alias("citation_label"), *extra,
    ).orderBy(F.desc("score"), "seq")
