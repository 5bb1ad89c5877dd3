"""Tunable defaults and the one error type used across the package."""

from __future__ import annotations

from dataclasses import dataclass


class FolioError(Exception):
    """An error with a stable machine-readable code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Settings:
    # Fixed default values of the retrieval contract.
    default_top_k: int = 8
    max_top_k: int = 50
    corpus_limit: int = 5
    rrf_k: int = 60
    vector_weight: float = 0.65
    keyword_weight: float = 0.35
    context_chars: int = 2400
    chunk_size: int = 256
    chunk_overlap: int = 64
    code_chunk_size: int = 400
    code_chunk_overlap: int = 60
    card_top_k: int = 3
    card_min_similarity: float = 0.65
    card_alpha: float = 0.30
    card_beta: float = 0.20
    graph_depth: int = 5
    graph_limit: int = 200
    graph_context_limit: int = 20
    locale: str = "en"

    def limit(self, top_k: int | None) -> int:
        """The asked number of results. More than ``max_top_k`` is refused rather than cut."""
        return bounded("top_k", top_k or self.default_top_k, self.max_top_k)


def bounded(name: str, value: int, most: int) -> int:
    """``value`` if it lies in 1..most; an error otherwise."""
    if not 1 <= value <= most:
        raise FolioError("LIMIT_OUT_OF_RANGE", f"{name} is {value}; it must lie between 1 and {most}")
    return value
