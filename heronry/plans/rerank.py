"""The MaxSim reranker over stores and other sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame

from heronry.errors import IncompatibleIndexError, IncompatibleQueryError
from heronry.functions.kernel import batches, check_query, maxsim
from heronry.interfaces import MultiVectorSource, VectorView
from heronry.model import Candidate, Feature, Query, Representation, ResourceBudget, Scored, check_time
from heronry.operators.maxsim import maxsim_arrow
from heronry.sources import files
from heronry.sources.store import ATTEMPTS, SEMANTICS, StoreView


class MaxSimReranker:
    """Scores candidates with the token vectors of their corpus's source.

    Stores are scored in Spark tasks, where their vectors are; other sources
    are asked for the vectors of one bounded batch at a time.
    """

    def __init__(self, sources: Iterable[MultiVectorSource], *, feature: str = "multi_vector") -> None:
        self.sources, self.feature = tuple(sources), feature
        if not self.sources:
            raise ValueError("a reranker needs at least one source")
        first, self._by = self.sources[0], {}
        for s in self.sources:
            try:
                first.representation.assert_compatible(s.representation)
            except IncompatibleQueryError as e:
                raise IncompatibleIndexError(f"sources disagree: {e}") from e
            if s.score_semantics != first.score_semantics:
                raise IncompatibleIndexError(f"one source scores as {first.score_semantics!r}, another as {s.score_semantics!r}")
            if s.corpus in self._by:
                raise IncompatibleIndexError(f"corpus {s.corpus!r} has more than one source")
            self._by[s.corpus] = s
        self.representation: Representation = first.representation
        self.score_semantics: str = first.score_semantics

    @property
    def requires(self) -> dict[str, Representation]:
        return {self.feature: self.representation}

    def rerank(self, query: Query, candidates: Sequence[Candidate], *, budget: ResourceBudget) -> Scored:
        """One score or None for each candidate; as fresh as the oldest of all sources."""
        wanted: dict[str, list[str]] = {}
        for c in candidates:
            if c.corpus not in self._by:
                raise IncompatibleIndexError(f"there is no source for corpus {c.corpus!r}")
            wanted.setdefault(c.corpus, []).append(c.document_id)
        feature = query.require(self.feature, self.representation)
        for attempt in range(1, ATTEMPTS + 1):
            views = {corpus: s.view() for corpus, s in self._by.items()}
            try:
                return self._rerank(feature, candidates, wanted, views, budget)
            except Exception as error:
                # files of a view that a newer commit replaced may be gone
                if attempt == ATTEMPTS or not files.vanished(error) or all(self._by[c].view() is v for c, v in views.items()):
                    raise
        raise AssertionError

    def _rerank(self, feature: Feature, candidates: Sequence[Candidate], wanted: dict[str, list[str]], views: dict[str, VectorView], budget: ResourceBudget) -> Scored:
        as_of = min(v.as_of for v in views.values())
        if not candidates:
            return Scored([], as_of)
        try:
            matrix = check_query(feature.value, self.representation.dimension)
        except ValueError as e:
            raise IncompatibleQueryError(str(e)) from e
        found: dict[tuple[str, str], float] = {}
        for corpus, ids in wanted.items():
            score = self._score_store if isinstance(views[corpus], StoreView) else self._score_source
            found |= {(corpus, d): s for d, s in score(views[corpus], sorted(set(ids)), matrix, budget).items()}
        return Scored([found.get((c.corpus, c.document_id)) for c in candidates], as_of)

    def _score_store(self, view: StoreView, ids: list[str], matrix: np.ndarray, budget: ResourceBudget) -> dict[str, float]:
        scored = maxsim_arrow(view.present(view._ids(ids)), [("q", matrix)], budget=budget, encoding=view.manifest.encoding, normalized=self.representation.normalized)
        return dict(scored.select("doc_id", "score").collect())

    def _score_source(self, view: VectorView, ids: list[str], matrix: np.ndarray, budget: ResourceBudget) -> dict[str, float]:
        lengths = dict(view.document_lengths(ids))
        if not set(lengths) <= set(ids):
            raise ValueError("the source gave lengths of documents that were not asked for")
        held = sorted(lengths, key=lambda d: (lengths[d], d))
        out: dict[str, float] = {}
        for s, e in batches(np.array([lengths[d] for d in held]), budget.max_batch_tokens, budget.max_documents_per_batch):
            part = held[s:e]
            packed, n = view.fetch(part, threads=budget.threads)
            packed = np.ascontiguousarray(packed, np.float32)
            if list(n) != [lengths[d] for d in part] or packed.shape != (sum(n), self.representation.dimension):
                raise ValueError("the source fetched other lengths or another dimension than it declared")
            out |= dict(zip(part, maxsim(matrix, packed, np.asarray(n)).tolist(), strict=True))
        return out


class FrameSource:
    """A DataFrame ``(doc_id, token_count, vectors)`` as a source of a corpus's vectors; its ids must be unique.

    For vectors that are kept elsewhere than in a store. ``as_of`` says how
    fresh they are. Only documents that are asked for come to the driver.
    """

    score_semantics = SEMANTICS["float32"]

    def __init__(self, documents: DataFrame, corpus: str, representation: Representation, as_of: datetime) -> None:
        self.documents, self.corpus, self.representation, self.as_of = documents, corpus, representation, check_time(as_of)

    def view(self) -> FrameSource:
        return self

    def _held(self, document_ids: Sequence[str], *columns: str) -> list:
        asked = self.documents.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(document_ids)], "doc_id string")
        return self.documents.join(asked, "doc_id", "left_semi").select("doc_id", *columns).collect()

    def document_lengths(self, document_ids: Sequence[str]) -> dict[str, int]:
        return {r["doc_id"]: r["token_count"] for r in self._held(document_ids, "token_count")}

    def fetch(self, document_ids: Sequence[str], *, threads: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        found = {r["doc_id"]: np.asarray(r["vectors"], np.float32).reshape(r["token_count"], -1) for r in self._held(document_ids, "token_count", "vectors")}
        parts = [found[i] for i in document_ids]
        return np.concatenate(parts), np.array([len(x) for x in parts])
