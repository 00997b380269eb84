"""Subsets as filters and joins, and the contract of candidates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.model import Subset

#: Ids of a restriction up to which it is written into the plan as a literal list.
LITERAL_IDS = 1000


def _ids(df: DataFrame, ids: frozenset[str], column: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"`{column}` string")


def restrict(df: DataFrame, subset: Subset | None, corpus: str = "corpus", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``df`` that ``subset`` allows; no subset allows all.

    A corpus that the subset doesn't name is left out. Short id lists become
    filters, which reach the scan; longer ones semi or anti joins.
    """
    if subset is None:
        return df
    kept = []
    for name in subset.corpora():
        kind, ids = subset.restriction(name)
        rows = df.where(F.col(corpus) == name)
        if len(ids) <= LITERAL_IDS:
            listed = F.col(doc_id).isin(*sorted(ids)) if ids else F.lit(False)
            kept.append(rows.where(listed if kind == "only" else ~listed))
        else:
            kept.append(rows.join(_ids(df, ids, doc_id), doc_id, "left_semi" if kind == "only" else "left_anti").select(df.columns))
    return functools.reduce(DataFrame.unionByName, kept) if kept else df.where(F.lit(False))


def restrict_corpus(df: DataFrame, subset: Subset | None, corpus: str, doc_id: str = "doc_id") -> DataFrame:
    """As ``restrict`` for rows that all belong to ``corpus``."""
    marked = df.withColumn("__corpus", F.lit(corpus))
    return restrict(marked, subset, "__corpus", doc_id).drop("__corpus")


def check_candidates(candidates: DataFrame, gather_limit: int, subset: Subset | None = None) -> int:
    """The number of candidates, or a ValueError if they break the gatherer's contract.

    One aggregation finds whether there are too many, ranks are dense from 0,
    keys are unique and all lie in the subset. NaN scores are left to ranking.
    """
    allowed = restrict(candidates, subset).agg(F.count("*").alias("inside"))
    seen = candidates.agg(
        F.count("*").alias("n"),
        F.min("gather_rank").alias("low"),
        F.max("gather_rank").alias("high"),
        F.count_distinct("gather_rank").alias("ranks"),
        F.count_distinct(F.struct("corpus", "doc_id")).alias("keys"),
        F.count_if(F.col("corpus").isNull() | F.col("doc_id").isNull()).alias("nameless"),
    )
    row = seen.crossJoin(allowed).first() if subset is not None else seen.withColumn("inside", F.col("n")).first()
    if row["n"] > gather_limit:
        raise ValueError(f"the gatherer returned {row['n']} candidates; {gather_limit} were asked for")
    if row["nameless"]:
        raise ValueError("candidates must have a corpus and a document id")
    if row["n"] and (row["ranks"] != row["n"] or row["low"] != 0 or row["high"] != row["n"] - 1):
        raise ValueError("gather ranks must be contiguous and zero-based")
    if row["inside"] != row["n"]:
        raise ValueError("the gatherer returned documents outside the subset")
    if row["keys"] != row["n"]:
        raise ValueError("the gatherer returned a document more than once")
    return row["n"]
