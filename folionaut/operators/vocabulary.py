"""The keyword vocabulary: which term occurs in which chunk, and how often over the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.functions.text import candidate_terms
from folionaut.settings import bounded

#: Rows of one page of a listing, at most.
MAX_PAGE = 10_000

#: Registers of a sketch, as a power of two: 4 kB for a term of very many sources, some bytes for a rare one.
SKETCH_BITS = 12


def keyword_links(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_id, term), each term once per chunk; text, file name and heading count."""
    text = F.concat("text", F.lit(" "), "filename", F.lit(" "), F.coalesce("heading", F.lit("")))
    return chunks.select("chunk_id", "source_id", F.explode(candidate_terms(text)).alias("term"))


def keyword_frequencies(links: DataFrame) -> DataFrame:
    """Chunks and sources per term. Counting per source first keeps a hot term spread over its sources."""
    per_source = links.groupBy("term", "source_id").agg(F.count("*").alias("chunks"))
    return per_source.groupBy("term").agg(
        F.sum("chunks").cast("bigint").alias("chunk_frequency"), F.count("*").alias("doc_frequency")
    )


def partial_counts(links: DataFrame, batch: str = "batch", sketches: bool = True) -> DataFrame:
    """(batch, term, chunks, sources, sketch): what one batch adds to the vocabulary, to be written beside it.

    A term's rows meet by batch, term and source first, so a term of a third of all chunks is counted where they lie.
    Null terms and sources take no part. Without ``sketches`` rows are only counted, which needs no sort of them.
    """
    known = links.filter(F.col("term").isNotNull() & F.col("source_id").isNotNull())
    per_source = known.groupBy(batch, "term", "source_id").agg(F.count("*").alias("chunks"))
    sketch = [F.hll_sketch_agg("source_id", F.lit(SKETCH_BITS)).alias("sketch")] if sketches else []
    return per_source.groupBy(batch, "term").agg(F.sum("chunks").cast("bigint").alias("chunks"), F.count("*").alias("sources"), *sketch)


def merged_counts(parts: DataFrame, live: DataFrame | None = None, batch: str = "batch") -> DataFrame:
    """Term frequencies over all batches, or those of ``live`` (batch), from partial counts alone: no link is read again.

    ``chunk_frequency`` is exact. ``doc_frequency`` is exact where a source lies in one batch, as the store has it.
    ``source_estimate`` (from parts with sketches) holds also where batches share sources: sketches are united, with a standard error of about 1.04 / 2^(SKETCH_BITS / 2), 1.6 %.
    """
    if live is not None:
        parts = parts.join(live.select(batch).distinct(), batch, "left_semi")
    estimate = [F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("source_estimate")] if "sketch" in parts.columns else []
    return parts.groupBy("term").agg(
        F.sum("chunks").cast("bigint").alias("chunk_frequency"), F.sum("sources").cast("bigint").alias("doc_frequency"), *estimate
    )


def with_batch_replaced(parts: DataFrame, links: DataFrame, batch: str = "batch") -> DataFrame:
    """Partial counts after some batches changed (a source was removed or replaced): only those batches are counted again.

    ``links`` are all live links of the changed batches. A batch that lost its last link must be left out by ``live``.
    """
    new = partial_counts(links, batch, sketches="sketch" in parts.columns)
    return parts.join(new.select(batch).distinct(), batch, "left_anti").unionByName(new)


def list_keywords(frequencies: DataFrame, contains: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    wanted = frequencies.filter(F.contains("term", F.lit(contains.lower()))) if contains else frequencies
    ordered = wanted.orderBy(F.desc("chunk_frequency"), "term")
    return ordered.offset(max(offset, 0)).limit(bounded("limit", limit, MAX_PAGE))
