"""What the pipeline calls on stages and sources that users supply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Protocol, runtime_checkable

import numpy as np

from heronry.model import Candidate, Gathered, Query, Representation, ResourceBudget, Scored, Subset


@runtime_checkable
class CandidateGenerator(Protocol):
    """First stage. ``requires`` and ``score_semantics`` are read once, when a pipeline is built."""

    requires: Mapping[str, Representation]
    score_semantics: str

    def gather(self, query: Query, limit: int, *, subset: Subset | None = None) -> Gathered:
        """Unique candidates with dense ranks from 0, inside ``subset``."""


@runtime_checkable
class Reranker(Protocol):
    """Second stage: a score for every candidate, None where it lacks the document."""

    requires: Mapping[str, Representation]
    score_semantics: str

    def rerank(self, query: Query, candidates: Sequence[Candidate], *, budget: ResourceBudget) -> Scored: ...


@runtime_checkable
class VectorView(Protocol):
    """One consistent state of a source."""

    as_of: datetime

    def document_lengths(self, document_ids: Sequence[str]) -> Mapping[str, int]: ...

    def fetch(self, document_ids: Sequence[str], *, threads: int | None = None) -> tuple[np.ndarray, np.ndarray]: ...


@runtime_checkable
class MultiVectorSource(Protocol):
    """Token vectors of one corpus."""

    corpus: str
    representation: Representation
    score_semantics: str

    def view(self) -> VectorView: ...
