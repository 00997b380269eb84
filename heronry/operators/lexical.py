"""BM25 and term-match gathering over postings."""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import B, K1, words
from heronry.operators.rank import gather_top


def postings(counted: DataFrame) -> DataFrame:
    """Rows ``(term, doc_id, tf, dl)`` from ``term_counts``."""
    return counted.select("doc_id", "dl", F.explode("terms").alias("term", "tf")).select("term", "doc_id", "tf", "dl")


def corpus_stats(counted: DataFrame) -> DataFrame:
    """One row ``(n, avgdl)``: documents, and their mean number of terms."""
    return counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """Rows ``(term, df)``."""
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """A term's part of a document's score, in the form that is never negative."""
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf / (k1 * (1 - b + b * dl / avgdl) + tf)


def added_by_term(term: Column, weight: Column) -> Column:
    """The sum of a group's weights, added up in the order of their terms.

    Sums of doubles depend on their order, which a shuffle leaves open: documents
    with equal counts would differ in the last bit, and ties not go to the smaller id.
    """
    parts = F.sort_array(F.collect_list(F.struct(term.alias("term"), weight.alias("w"))))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["w"])


def _wanted(terms: Sequence[str]) -> dict[str, int]:
    """How often the query has each of its terms."""
    return dict(Counter(terms))


def bm25_scan(counted: DataFrame, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """``counted`` with ``score``, documents with a term of the query only; nothing but one row of statistics is shuffled.

    For documents without an index: a first pass aggregates the number of
    documents, their mean length and the frequency of every query term, a
    second scores. ``counted`` is ``term_counts`` of these terms over all
    documents; columns kept there pass through.
    """
    wanted = _wanted(terms)
    if not wanted:
        return counted.withColumn("score", F.lit(0.0)).where(F.lit(False))
    tf = [F.element_at("terms", F.lit(t)) for t in wanted]
    one = counted.agg(F.count("*").alias("__n"), F.avg("dl").alias("__avgdl"), *(F.count(x).alias(f"__df{i}") for i, x in enumerate(tf)))
    held = counted.where(F.size("terms") > 0).crossJoin(F.broadcast(one))
    parts = [F.coalesce(bm25_weight(x, F.col("dl"), F.col(f"__df{i}"), F.col("__n"), F.col("__avgdl"), k1, b), F.lit(0.0)) * n for i, (x, n) in enumerate(zip(tf, wanted.values(), strict=True))]
    return held.withColumn("score", functools.reduce(operator.add, parts)).select(*counted.columns, "score")


def bm25_scores(rows: DataFrame, stats: DataFrame, terms: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """Rows ``(doc_id, score)`` of documents with a term of the query, from postings.

    A term that the query repeats counts as often. Frequencies and the mean
    length are those of ``rows`` and ``stats``, whatever subset applies later.
    """
    wanted = _wanted(terms)
    if not wanted:
        return rows.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    # a query's terms are few: they become a literal filter that reaches the scan
    hits = rows.where(F.col("term").isin(*wanted))
    times = F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("term"))
    one = F.broadcast(stats)  # a single row
    found = hits.join(F.broadcast(document_frequency(hits)), "term").crossJoin(one)
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"), k1, b)
    return found.groupBy("doc_id").agg(added_by_term(F.col("term"), weight * times).alias("score"))


def positive(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rows whose score is above zero and not NaN, which Spark holds to be the greatest."""
    return scored.where((F.col(score) > 0) & ~F.isnan(score))


def match_scores(docs: DataFrame, text: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, score)``: words of a document that are among the query's, where there are any."""
    wanted = sorted(set(text.split()))
    if not wanted:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    hits = F.size(F.filter(words(F.col(text_col)), lambda w: w.isin(*wanted))).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), hits.alias("score")).where(F.col("score") > 0)


def as_candidates(scored: DataFrame, corpus: str, limit: int, provenance: str) -> DataFrame:
    """The best ``limit`` documents as candidates of ``corpus``; ties by id."""
    top = gather_top(scored.select(F.lit(corpus).alias("corpus"), F.col("doc_id").cast("string").alias("doc_id"), F.col("score").cast("float").alias("gather_score"), F.col("score").alias("__score")), limit, "__score")
    return top.select("corpus", "doc_id", "gather_score", "gather_rank", F.lit(provenance).alias("provenance"))
