"""Composable document retrieval on Spark: gather candidates, rescore them, rank what every stage holds."""

from heronry.errors import IncompatibleIndexError, IncompatibleQueryError
from heronry.functions.kernel import maxsim_scores_packed
from heronry.interfaces import CandidateGenerator, MultiVectorSource, Reranker, VectorView
from heronry.model import Candidate, Feature, Gathered, Query, RankedDocument, Representation, ResourceBudget, Scored, SearchResult, SearchTimings, Subset
from heronry.plans.batch import search_many
from heronry.plans.pipeline import SearchPipeline
from heronry.plans.rerank import MaxSimReranker
from heronry.sources.store import StoreView, VectorStore, VectorStoreWriter

__all__ = [
    "Candidate",
    "CandidateGenerator",
    "Feature",
    "Gathered",
    "IncompatibleIndexError",
    "IncompatibleQueryError",
    "MaxSimReranker",
    "MultiVectorSource",
    "Query",
    "RankedDocument",
    "Representation",
    "Reranker",
    "ResourceBudget",
    "Scored",
    "SearchPipeline",
    "SearchResult",
    "SearchTimings",
    "StoreView",
    "Subset",
    "VectorStore",
    "VectorStoreWriter",
    "VectorView",
    "maxsim_scores_packed",
    "search_many",
]
