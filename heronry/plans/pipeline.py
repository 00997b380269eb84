"""Gather, rerank, rank."""

from __future__ import annotations

import math
import time
from typing import Any

from heronry.interfaces import CandidateGenerator, Reranker
from heronry.model import Candidate, Gathered, Query, RankedDocument, ResourceBudget, Scored, SearchResult, SearchTimings, Subset


def check_contract(candidates: tuple[Candidate, ...], gather_limit: int, subset: Subset | None) -> None:
    """Raise ValueError if a gatherer's rows break its contract; there are ``gather_limit`` at most."""
    if len(candidates) > gather_limit:
        raise ValueError(f"the gatherer returned {len(candidates)} candidates; {gather_limit} were asked for")
    seen: set[tuple[str, str]] = set()
    for place, c in enumerate(candidates):
        key = (c.corpus, c.document_id)
        if c.gather_rank != place:
            raise ValueError("gather ranks must be contiguous and zero-based")
        if subset is not None and not subset.allows(*key):
            raise ValueError(f"the gatherer returned {key}, which is outside the subset")
        if key in seen:
            raise ValueError(f"the gatherer returned {key} more than once")
        seen.add(key)


def ranked(candidates: tuple[Candidate, ...], scores: list[float | None], limit: int) -> tuple[RankedDocument, ...]:
    """The best ``limit`` of a search's candidates: total order of scores, then gather rank."""
    if len(scores) != len(candidates):
        raise ValueError(f"{len(scores)} scores were returned for {len(candidates)} candidates")
    for place, s in enumerate(scores):
        if s is not None and math.isnan(s):
            raise ValueError(f"the score of candidate {place} is NaN")
    held = [i for i, s in enumerate(scores) if s is not None]
    held.sort(key=lambda i: (-scores[i], math.copysign(1, scores[i]) < 0 and scores[i] == 0, candidates[i].gather_rank))
    return tuple(RankedDocument(candidates[i].corpus, candidates[i].document_id, scores[i], n) for n, i in enumerate(held[:limit], 1))


class SearchPipeline:
    """A gatherer and, if given, a reranker.

    Only documents that every stage holds are ranked, and a result is as fresh
    as the oldest index it read. What crosses to the driver is a search's
    candidates, ``gather_limit`` at most.
    """

    def __init__(self, gatherer: CandidateGenerator, reranker: Reranker | None = None) -> None:
        self.gatherer, self.reranker = gatherer, reranker
        stages = [gatherer] if reranker is None else [gatherer, reranker]
        self._needs = [dict(s.requires) for s in stages]
        self._semantics = str(stages[-1].score_semantics)

    def search(self, query: Query | str, *, gather_limit: int, limit: int, subset: Subset | None = None, budget: ResourceBudget | None = None) -> SearchResult:
        query = Query(query) if isinstance(query, str) else query
        if not isinstance(query, Query):
            raise TypeError("query must be a Query or a string")
        if subset is not None and not isinstance(subset, Subset):
            raise TypeError(f"subset must be a heronry.Subset, not {type(subset).__name__}")
        for name, value in (("gather_limit", gather_limit), ("limit", limit)):
            if value <= 0:
                raise ValueError(f"{name} must be positive")
        if limit > gather_limit:
            raise ValueError("limit must not be above gather_limit")
        for needs in self._needs:
            for name, representation in needs.items():
                query.require(name, representation)

        t0 = time.perf_counter()
        gathered = self.gatherer.gather(query, gather_limit, subset=subset)
        if not isinstance(gathered, Gathered):
            raise TypeError(f"a gatherer must return Gathered, not {type(gathered).__name__}")
        candidates = gathered.candidates
        t1 = time.perf_counter()
        check_contract(candidates, gather_limit, subset)
        scores: list[float | None] = [c.gather_score for c in candidates]
        as_of = gathered.as_of
        if self.reranker is not None:
            scored = self.reranker.rerank(query, candidates, budget=budget or ResourceBudget())
            if not isinstance(scored, Scored):
                raise TypeError(f"a reranker must return Scored, not {type(scored).__name__}")
            scores, as_of = scored.scores, min(as_of, scored.as_of)
        t2 = time.perf_counter()
        documents = ranked(candidates, scores, limit)
        diagnostics: dict[str, Any] = {
            "candidate_count": len(candidates),
            "dropped": sum(s is None for s in scores),
            "gatherer": type(self.gatherer).__name__,
            "reranker": None if self.reranker is None else type(self.reranker).__name__,
            "score_semantics": self._semantics,
        }
        return SearchResult(documents, candidates, scores, as_of, SearchTimings(t1 - t0, t2 - t1, time.perf_counter() - t0), diagnostics)
