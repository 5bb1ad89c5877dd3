"""Structured filters. Each one keeps the chunks that some fact or keyword satisfies: a left-semi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.facts import FIELDS
from folionaut.plans.requests import NumericFilter, SearchFilters


def resolve_field(name: str) -> tuple[str, str] | None:
    """Canonical name and type of a field or alias; None when unknown."""
    wanted = name.lower()
    for canonical, (kind, aliases) in FIELDS.items():
        if wanted == canonical or wanted in aliases:
            return canonical, kind
    return None


def _operand(value, is_date: bool):
    if value is None:
        return None
    if is_date:
        return f"{value}T00:00:00Z" if len(str(value)) == 10 else str(value)
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def fact_predicate(wanted: NumericFilter) -> Column | None:
    """The condition on one fact row; None for an unknown field. Dates compare as ISO text."""
    known = resolve_field(wanted.field)
    if known is None:
        return None
    canonical, kind = known
    is_date = kind == "date"
    stored = F.col("normalized_date_utc" if is_date else "normalized_number")
    value, low, high = (_operand(v, is_date) for v in (wanted.value, wanted.low, wanted.high))
    base = (F.col("field") == canonical) & stored.isNotNull()
    if wanted.currency:
        base = base & (F.col("currency_code") == wanted.currency.upper())
    if wanted.op == "exists":
        return base
    if wanted.op == "between":
        return base & stored.between(low, high) if low is not None and high is not None else F.lit(False)
    if value is None:
        return F.lit(False)
    compare = {
        "equal": stored == value,
        "not_equal": stored != value,
        "less_than": stored < value,
        "less_than_or_equal": stored <= value,
        "greater_than": stored > value,
        "greater_than_or_equal": stored >= value,
    }[wanted.op]
    return base & compare


def filter_chunks(
    chunks: DataFrame, facts: DataFrame | None, keywords: DataFrame | None, filters: SearchFilters, key: str = "chunk_id"
) -> tuple[DataFrame, list[str], list[dict]]:
    """Chunks that pass all filters, the filters applied, and the ones skipped for an unknown field."""
    applied, skipped = [], []
    for wanted in filters.numeric:
        predicate = fact_predicate(wanted)
        if predicate is None:
            skipped.append({"field": wanted.field, "reason": "unknown field"})
            continue
        chunks = chunks.join(facts.filter(predicate).select(key), key, "left_semi")
        applied.append(f"{wanted.field} {wanted.op}")
    for term in filters.keywords:
        hits = keywords.filter(F.col("term") == term.strip().lower()).select(key)
        chunks = chunks.join(hits, key, "left_semi")
        applied.append(f"keyword:{term}")
    if filters.source_extensions:
        wanted_suffixes = [suffix.lower().lstrip(".") for suffix in filters.source_extensions]
        chunks = chunks.filter(F.col("extension").isin(wanted_suffixes))
        applied.append("source_extensions")
    if filters.source_ids:
        chunks = chunks.filter(F.col("source_id").isin(list(filters.source_ids)))
        applied.append("source_ids")
    if filters.path_prefix:
        chunks = chunks.filter(F.coalesce(F.col("path"), F.lit("")).startswith(filters.path_prefix))
        applied.append("path_prefix")
    return chunks, applied, skipped
