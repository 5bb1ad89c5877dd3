"""Validated request objects. A request is the logical plan; there is no query language."""

from __future__ import annotations

from dataclasses import dataclass, field

from folionaut.settings import FolioError

OPERATORS = (
    "equal", "not_equal", "less_than", "less_than_or_equal", "greater_than", "greater_than_or_equal", "between", "exists",
)
DOCUMENT_MODES = ("vector", "keyword", "hybrid", "structured")


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise FolioError("CONFIG_INVALID", message)


@dataclass(frozen=True)
class NumericFilter:
    field: str
    op: str
    value: float | str | None = None
    low: float | str | None = None
    high: float | str | None = None
    currency: str | None = None

    def __post_init__(self):
        _require(self.op in OPERATORS, f"unknown operator {self.op}")
        if self.op == "between":
            _require(self.low is not None and self.high is not None, "between requires low and high")
        elif self.op != "exists":
            _require(self.value is not None, f"{self.op} requires value")


@dataclass(frozen=True)
class SearchFilters:
    source_extensions: tuple[str, ...] = ()
    numeric: tuple[NumericFilter, ...] = ()
    keywords: tuple[str, ...] = ()
    path_prefix: str | None = None
    source_ids: tuple = ()

    def any(self) -> bool:
        return bool(self.source_extensions or self.numeric or self.keywords or self.path_prefix or self.source_ids)


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    mode: str = "hybrid"
    top_k: int | None = None
    filters: SearchFilters = field(default_factory=SearchFilters)
    include_text: bool = True
    include_links: bool = True
    include_graph_context: bool | None = None

    def __post_init__(self):
        _require(self.mode in DOCUMENT_MODES, f"unknown mode {self.mode}")
        _require(self.top_k is None or self.top_k >= 1, "top_k must be positive")


@dataclass(frozen=True)
class CorpusQuery:
    query: str = ""
    collections: tuple[str, ...] | None = None
    mode: str = "hybrid"
    perspective: str = "general"
    limit: int = 5
    minimum_score: float | None = None
    filters: SearchFilters = field(default_factory=SearchFilters)
    include_text: bool = True
    include_links: bool = True
    include_graph_context: bool | None = None

    def __post_init__(self):
        _require(self.mode in ("keyword", "semantic", "hybrid", "structured"), f"unknown mode {self.mode}")
        _require(self.perspective in ("general", "expert"), "unknown perspective")
        _require(self.limit >= 1, "limit must be positive")
        _require(bool(self.query.strip()) or self.mode == "structured", "query must not be empty")
        _require(self.collections is None or len(self.collections) > 0, "collections must not be empty")


GRAPH_ACTIONS = ("find", "neighbors", "callers", "callees", "dependencies", "inheritance", "impact")


@dataclass(frozen=True)
class GraphRequest:
    action: str = "neighbors"
    symbol: str | None = None
    entity_id: str | None = None
    source_id: str | None = None
    direction: str = "outgoing"
    relationships: tuple[str, ...] | None = None
    depth: int = 1
    limit: int = 50

    def __post_init__(self):
        _require(self.action in GRAPH_ACTIONS, f"unknown action {self.action}")
        _require(self.direction in ("outgoing", "incoming", "both"), "unknown direction")
        _require(self.symbol is None or bool(self.symbol.strip()), "symbol must not be blank")
        _require(not (self.symbol and self.entity_id), "give entity_id or symbol, not both")
        _require(
            self.action == "find" or bool(self.entity_id or self.symbol or self.source_id),
            "a symbol, entity_id or source_id is required",
        )
        _require(1 <= self.depth <= 5 and 1 <= self.limit <= 200, "depth is 1..5 and limit is 1..200")
