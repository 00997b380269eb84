"""Candidate generators over DataFrames."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame

from heronry.functions.text import Analyzer, term_counts
from heronry.interfaces import CandidateGenerator
from heronry.model import Gathered, Query, Representation, Subset
from heronry.operators.lexical import as_candidates, bm25_scan, match_scores, positive
from heronry.operators.subset import restrict_corpus


class TermMatchGenerator:
    """Counts the words of a document that are among the query's."""

    requires: dict[str, Representation] = {}
    score_semantics = "matching-words"

    def __init__(self, documents: DataFrame, corpus: str, as_of: datetime, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.documents, self.corpus, self.as_of = documents, corpus, as_of
        self.id_col, self.text_col = id_col, text_col

    def gather(self, query: Query, limit: int, *, subset: Subset | None = None) -> Gathered:
        allowed = restrict_corpus(self.documents, subset, self.corpus, self.id_col)
        scored = match_scores(allowed, query.text, self.id_col, self.text_col)
        return Gathered(as_candidates(scored, self.corpus, limit, "term-match"), self.as_of)


class Bm25Generator:
    """BM25 over documents that have no lexical index: one pass for statistics, one for scores."""

    requires: dict[str, Representation] = {}
    score_semantics = "bm25s-lucene"

    def __init__(self, documents: DataFrame, corpus: str, as_of: datetime, analyzer: Analyzer | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.documents, self.corpus, self.as_of, self.analyzer = documents, corpus, as_of, analyzer or Analyzer()
        self.id_col, self.text_col = id_col, text_col

    def gather(self, query: Query, limit: int, *, subset: Subset | None = None) -> Gathered:
        terms = self.analyzer.tokens(query.text)
        if not terms:
            return Gathered([], self.as_of)
        counted = term_counts(self.documents, self.analyzer, self.id_col, self.text_col, terms)
        scored = positive(bm25_scan(counted, terms))
        allowed = restrict_corpus(scored, subset, self.corpus)
        return Gathered(as_candidates(allowed, self.corpus, limit, "bm25"), self.as_of)


class FusedGenerator:
    """Several corpora in one list: each generator's best candidates, ranked together by score, corpus and id.

    As fresh as the oldest of them. Documents of equal id in two corpora are two documents.
    """

    def __init__(self, *generators: CandidateGenerator) -> None:
        if not generators:
            raise ValueError("at least one generator is needed")
        semantics = {g.score_semantics for g in generators}
        if len(semantics) > 1:
            raise ValueError(f"scores of different meaning can't be ranked together: {sorted(semantics)}")
        self.generators, self.score_semantics = generators, semantics.pop()
        self.requires = {name: r for g in generators for name, r in g.requires.items()}

    def gather(self, query: Query, limit: int, *, subset: Subset | None = None) -> Gathered:
        found = [g.gather(query, limit, subset=subset) for g in self.generators]
        best = sorted((c for f in found for c in f.candidates), key=lambda c: (-c.gather_score, c.corpus, c.document_id))[:limit]
        return Gathered([replace(c, gather_rank=i) for i, c in enumerate(best)], min(f.as_of for f in found))
