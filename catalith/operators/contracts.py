"""Typed requests, validated on the driver before any plan is made."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

MAX_INDEX = 4_294_967_295  # sparse indices are 32-bit, unsigned
DEFAULT_LIMIT, MAX_LIMIT, SERVED_LIMIT = 10, 1000, 100
DEFAULT_MULTIPLIER, DEFAULT_RRF_K = 10, 2
DISTANCES = ("cosine", "euclid", "dot")
# Payload fields a request may filter on, with the kind of their values; fixed values.
FILTERABLE = {
    "entity_type": "keyword", "title": "keyword", "type": "keyword", "status": "keyword", "rating": "keyword", "season": "keyword", "source_material": "keyword", "year": "integer", "month": "keyword",
    "genres": "keyword", "tags": "keyword", "demographics": "keyword", "content_warnings": "keyword", "episode_count": "integer", "duration": "integer", "nsfw": "bool",
    "statistics.mal.score": "float", "statistics.mal.scored_by": "integer", "statistics.mal.members": "integer", "statistics.mal.favorites": "integer", "statistics.anilist.score": "float",
    "statistics.anilist.favorites": "integer", "statistics.anidb.score": "float", "statistics.animeplanet.score": "float", "statistics.animeplanet.scored_by": "integer",
    "statistics.animeschedule.score": "float", "statistics.kitsu.score": "float", "score.median": "float", "score.arithmetic_mean": "float",
}


class InvalidRequest(ValueError):
    """A request that breaks its contract; ``code`` tells which part."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Range:
    gt: Any = None
    gte: Any = None
    lt: Any = None
    lte: Any = None

    def __post_init__(self) -> None:
        if all(v is None for v in (self.gt, self.gte, self.lt, self.lte)):
            raise InvalidRequest("INVALID_FILTERS", "a range needs at least one bound")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any
    clause: str = "must"

    def __post_init__(self) -> None:
        if self.clause not in ("must", "must_not", "should"):
            raise InvalidRequest("INVALID_FILTERS", f"unknown clause {self.clause}")
        scalar = lambda v: isinstance(v, (str, int, float, bool))
        ok = {
            "eq": scalar(self.value), "ne": scalar(self.value), "range": isinstance(self.value, Range),
            "in": isinstance(self.value, (list, tuple)) and len(self.value) > 0 and all(map(scalar, self.value)),
            "not_in": isinstance(self.value, (list, tuple)) and len(self.value) > 0 and all(map(scalar, self.value)),
        }
        if self.operator not in ok:
            raise InvalidRequest("INVALID_FILTERS", f"unknown operator {self.operator}")
        if not ok[self.operator]:
            raise InvalidRequest("INVALID_FILTERS", f"{self.operator} cannot take {self.value!r}")


def conditions_from(wire: list[dict[str, Any]]) -> list[Condition]:
    """Conditions from plain dictionaries; whole floats become integers, ranges objects."""
    out = []
    for w in wire:
        unknown = set(w) - {"field", "operator", "value", "clause"}
        if unknown or "field" not in w or not w.get("operator"):
            raise InvalidRequest("INVALID_FILTERS", f"malformed condition {w!r}")
        value = coerce(w.get("value"))
        if w["operator"] == "range":
            if not isinstance(value, dict) or set(value) - {"gt", "gte", "lt", "lte"}:
                raise InvalidRequest("INVALID_FILTERS", f"malformed range {value!r}")
            value = Range(**value)
        out.append(Condition(w["field"], w["operator"], value, w.get("clause", "must")))
    return out


def coerce(value: Any) -> Any:
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [coerce(v) for v in value]
    return {k: coerce(v) for k, v in value.items()} if isinstance(value, dict) else value


def check_fields(conditions: list[Condition], allowed: dict[str, str] | frozenset[str] = frozenset(FILTERABLE)) -> None:
    if bad := [c.field for c in conditions if c.field not in allowed]:
        raise InvalidRequest("INVALID_FILTERS", f"not filterable: {', '.join(bad)}")


@dataclass(frozen=True)
class SparseVector:
    indices: tuple[int, ...]
    values: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.indices) != len(self.values):
            raise InvalidRequest("INVALID_SPARSE", "indices and values differ in number")
        if len(set(self.indices)) != len(self.indices) or any(not 0 <= i <= MAX_INDEX for i in self.indices):
            raise InvalidRequest("INVALID_SPARSE", "indices must be unique and 32-bit unsigned")


@dataclass(frozen=True)
class SearchRequest:
    text: list[float] | None = None
    image: list[float] | None = None
    sparse: SparseVector | None = None
    expansions: tuple[list[float], ...] = ()
    filters: tuple[Condition, ...] = ()
    entity_type: str | None = None
    limit: int = DEFAULT_LIMIT
    score_threshold: float | None = None
    fusion: str = "rrf"
    rrf_k: int = DEFAULT_RRF_K
    rank_base: int = 1
    multiplier: int = DEFAULT_MULTIPLIER
    distance: str = field(default="cosine")

    def __post_init__(self) -> None:
        if not (self.text or self.image or self.sparse):
            raise InvalidRequest("MISSING_QUERY_INPUT", "a search needs an embedding")
        if self.expansions and not self.text:
            raise InvalidRequest("MISSING_QUERY_INPUT", "expansions need a text embedding")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise InvalidRequest("INVALID_LIMIT", f"limit must lie in 1..{MAX_LIMIT}")
        if self.fusion not in ("rrf", "dbsf") or not 1 <= self.rrf_k <= 1000 or self.multiplier < 2:
            raise InvalidRequest("INVALID_FUSION", "unknown fusion or parameters out of range")
        object.__setattr__(self, "distance", check_distance(self.distance))


def check_distance(name: str) -> str:
    if name.lower() not in DISTANCES:
        raise InvalidRequest("INVALID_DISTANCE", f"unknown distance {name}")
    return name.lower()


def served_limit(raw: int) -> int:
    """The limit a service grants: the default for none, at most SERVED_LIMIT."""
    return DEFAULT_LIMIT if raw <= 0 else min(raw, SERVED_LIMIT)
