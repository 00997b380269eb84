"""Many queries in one plan: BM25 candidates for each, rescored by MaxSim and ranked.

A single search reads an index for one query; a batch reads it once for all.
The queries are what is broadcast. Candidates of all queries are at most their
number times ``gather_limit``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import B, K1
from heronry.operators.lexical import added_by_term, bm25_weight, document_frequency, positive
from heronry.operators.maxsim import QUERY_BYTES
from heronry.operators.rank import gather_top, rank

#: Query terms that are broadcast, at most; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def bm25_many(rows: DataFrame, stats: DataFrame, queries: Mapping[str, Sequence[str]], k1: float = K1, b: float = B) -> DataFrame:
    """Rows ``(query_id, doc_id, score)`` from postings ``rows`` and ``stats``, for the terms of each query.

    A term counts as often as its query has it. Queries without terms, and
    documents without any term of a query, give no rows.
    """
    spark = rows.sparkSession
    counted = [(q, t, terms.count(t)) for q, terms in ((q, list(x)) for q, x in queries.items()) for t in dict.fromkeys(terms)]
    asked = spark.createDataFrame(counted, "query_id string, term string, times int")
    small = (lambda df: F.broadcast(df)) if len(counted) <= BROADCAST_TERMS else (lambda df: df)
    hits = rows.join(small(asked.select("term").distinct()), "term", "left_semi")
    weighed = hits.join(small(document_frequency(hits)), "term").crossJoin(F.broadcast(stats))  # stats is one row
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"), k1, b)
    scored = weighed.select("term", "doc_id", weight.alias("w")).join(small(asked), "term")
    return scored.groupBy("query_id", "doc_id").agg(added_by_term(F.col("term"), F.col("w") * F.col("times")).alias("score"))


def maxsim_pairs(tokens: DataFrame, candidates: DataFrame, matrices: Mapping[str, np.ndarray]) -> DataFrame:
    """``candidates(query_id, doc_id, ...)`` with ``score``: null where ``tokens(doc_id, vector)`` lack the document.

    Each candidate is scored with its own query's tokens only. Tokens of other
    documents are dropped before any product.
    """
    spark = candidates.sparkSession
    rows = [(q, i, v.tolist()) for q, m in matrices.items() for i, v in enumerate(np.asarray(m, np.float32))]
    if sum(4 * len(v) for _, _, v in rows) > QUERY_BYTES:
        raise ValueError("the queries are too large to send to every task; search in smaller groups")
    asked = F.broadcast(spark.createDataFrame(rows, "query_id string, q_pos int, q array<float>"))
    held = tokens.select("doc_id", "vector").join(candidates.select("query_id", "doc_id"), "doc_id").join(asked, "query_id")
    product = F.aggregate(F.zip_with("vector", "q", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    best = held.groupBy("query_id", "doc_id", "q_pos").agg(F.max(product).alias("best"))
    scores = best.groupBy("query_id", "doc_id").agg(F.sum("best").alias("score"))
    return candidates.join(scores, ["query_id", "doc_id"], "left")


def search_many(rows: DataFrame, stats: DataFrame, queries: Mapping[str, Sequence[str]], gather_limit: int, limit: int, tokens: DataFrame | None = None, matrices: Mapping[str, np.ndarray] | None = None) -> DataFrame:
    """Rows ``(query_id, doc_id, score, gather_rank, rank)``: the ``limit`` best documents of each query.

    Without ``tokens`` documents keep their BM25 scores; with them they are
    rescored, and those without vectors are dropped. Queries without a matrix
    then have no results.
    """
    if gather_limit <= 0 or limit <= 0 or limit > gather_limit:
        raise ValueError("limits must be positive, and limit not above gather_limit")
    scored = positive(bm25_many(rows, stats, queries)).withColumnRenamed("score", "gather_score")
    gathered = gather_top(scored, gather_limit, tie=("doc_id",), per=("query_id",))
    if tokens is None:
        final = gathered.withColumn("score", F.col("gather_score"))
    else:
        final = maxsim_pairs(tokens, gathered, matrices or {})
    return rank(final, limit, per=("query_id",)).select("query_id", "doc_id", "score", "gather_rank", "rank")
