"""Values that pass between the stages of a search.

Everything here lives on the driver. Tables of candidates and scores are
DataFrames; the small objects below carry what a DataFrame can't: encoder
identities, lazily computed query features, freshness and diagnostics.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime
from typing import Any, Literal

from pyspark.sql import DataFrame

from heronry.errors import IncompatibleQueryError

CANDIDATE_SCHEMA = "corpus string, doc_id string, gather_score float, gather_rank long, provenance string"


@dataclass(frozen=True)
class Representation:
    """Identity of the encoder behind a vector feature; templates only identify it."""

    encoder: str
    encoder_revision: str
    dimension: int
    normalized: bool
    query_template: str = ""
    document_template: str = ""

    def __post_init__(self) -> None:
        for name in ("encoder", "encoder_revision"):
            if not isinstance(getattr(self, name), str) or not getattr(self, name):
                raise ValueError(f"representation {name} must not be empty")
        if isinstance(self.dimension, bool) or not isinstance(self.dimension, int) or self.dimension <= 0:
            raise ValueError("representation dimension must be positive")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, value: Mapping[str, Any]) -> Representation:
        return cls(**value)

    def assert_compatible(self, other: Representation) -> None:
        """Raise IncompatibleQueryError with every field that differs."""
        pairs = ((f.name, getattr(self, f.name), getattr(other, f.name)) for f in fields(self))
        different = [f"{name}: {a!r} != {b!r}" for name, a, b in pairs if a != b]
        if different:
            raise IncompatibleQueryError("encoders differ: " + "; ".join(different))


class Feature:
    """A query feature given as a value, or computed by ``provider`` when first read.

    A value is computed once; a provider that fails is asked again next time.
    """

    def __init__(self, representation: Representation, value: Any = None, *, provider: Callable[[], Any] | None = None) -> None:
        if (value is None) == (provider is None):
            raise ValueError("a feature takes either a value or a provider")
        self.representation = representation
        self._value, self._provider, self._lock = value, provider, threading.RLock()

    @property
    def value(self) -> Any:
        with self._lock:
            if self._provider is not None:
                value = self._provider()
                if value is None:
                    raise ValueError("the provider of a feature returned None")
                self._value, self._provider = value, None
            return self._value


class Query:
    """Text and named features; copies share features."""

    def __init__(self, text: str, **features: Feature) -> None:
        self.text, self.features = text, dict(sorted(features.items()))

    def require(self, name: str, representation: Representation) -> Feature:
        """The feature ``name`` of exactly this representation, not yet computed."""
        if name not in self.features:
            raise IncompatibleQueryError(f"the query lacks the feature {name!r}; it has {sorted(self.features)}")
        found = self.features[name]
        representation.assert_compatible(found.representation)
        return found

    def feature(self, name: str, representation: Representation) -> Any:
        return self.require(name, representation).value


@dataclass(frozen=True)
class Candidate:
    corpus: str
    document_id: str
    gather_score: float
    gather_rank: int
    provenance: str


def check_time(as_of: datetime) -> datetime:
    if not isinstance(as_of, datetime) or as_of.tzinfo is None:
        raise TypeError("as_of must be a datetime with a time zone")
    return as_of


class Gathered:
    """Candidates in rank order, or a DataFrame of them, and how fresh they are."""

    def __init__(self, candidates: Iterable[Candidate] | DataFrame, as_of: datetime) -> None:
        self.as_of = check_time(as_of)
        self._frame = candidates if isinstance(candidates, DataFrame) else None
        self._rows = None if self._frame is not None else tuple(candidates)

    @property
    def frame(self) -> DataFrame | None:
        """The candidates as a DataFrame, if the gatherer made one."""
        return self._frame

    @property
    def candidates(self) -> tuple[Candidate, ...]:
        if self._rows is None:
            rows = self._frame.select("corpus", "doc_id", "gather_score", "gather_rank", "provenance").orderBy("gather_rank").collect()
            self._rows = tuple(Candidate(*r) for r in rows)
        return self._rows


class Scored:
    """One score for each candidate, in their order; None where the index lacks the document."""

    def __init__(self, scores: Iterable[float | None], as_of: datetime) -> None:
        self.scores = [None if s is None else float(s) for s in scores]
        self.as_of = check_time(as_of)


@dataclass(frozen=True, kw_only=True)
class ResourceBudget:
    """Bounds of one scoring batch; ``threads`` is the number of partitions to score in."""

    max_batch_tokens: int = 131_072
    max_documents_per_batch: int = 256
    threads: int | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and value <= 0:
                raise ValueError(f"{f.name} must be positive")


Restriction = tuple[Literal["only", "except"], frozenset[str]]


def document_ids(ids: Iterable[str]) -> list[str]:
    if isinstance(ids, (str, bytes)):
        raise TypeError("document ids must be an iterable of strings, not a single string")
    out = list(ids)
    if not all(isinstance(x, str) for x in out):
        raise TypeError("document ids must be strings")
    return out


class Subset:
    """Documents that a search may return, corpus by corpus.

    A corpus that isn't named contributes nothing; naming one again replaces
    what was said of it. Each call returns a new subset.
    """

    def __init__(self) -> None:
        self._by: dict[str, Restriction] = {}

    def _with(self, corpus: str, restriction: Restriction) -> Subset:
        out = Subset()
        out._by = {**self._by, corpus: restriction}
        return out

    def including(self, corpus: str, ids: Iterable[str]) -> Subset:
        return self._with(corpus, ("only", frozenset(document_ids(ids))))

    def excluding(self, corpus: str, ids: Iterable[str]) -> Subset:
        return self._with(corpus, ("except", frozenset(document_ids(ids))))

    def restriction(self, corpus: str) -> Restriction | None:
        return self._by.get(corpus)

    def allows(self, corpus: str, id: str) -> bool:
        found = self._by.get(corpus)
        return found is not None and (id in found[1]) == (found[0] == "only")

    def corpora(self) -> list[str]:
        return sorted(self._by)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Subset) and self._by == other._by

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return "Subset(" + ", ".join(f"{c}: {k} {len(i)}" for c, (k, i) in sorted(self._by.items())) + ")"


@dataclass(frozen=True)
class RankedDocument:
    corpus: str
    document_id: str
    score: float
    rank: int


@dataclass(frozen=True)
class SearchTimings:
    """Wall seconds of the Spark jobs that materialised each stage."""

    gather_seconds: float
    rerank_seconds: float
    total_seconds: float


@dataclass(frozen=True)
class SearchResult:
    documents: tuple[RankedDocument, ...]
    candidates: tuple[Candidate, ...]
    scores: list[float | None]
    as_of: datetime
    timings: SearchTimings
    diagnostics: dict[str, Any] = field(default_factory=dict)
