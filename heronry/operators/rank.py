"""Ranking: drop what has no score, order, number, truncate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.vectors import total_order


def check_scores(scored: DataFrame, score: str = "score") -> None:
    """Raise ValueError if a score is NaN; infinities pass."""
    bad = scored.agg(F.count_if(F.isnan(score))).first()[0]
    if bad:
        raise ValueError(f"{bad} scores are NaN")


def rank(scored: DataFrame, limit: int, score: str = "score", tie: str = "gather_rank", per: Sequence[str] = ()) -> DataFrame:
    """The ``limit`` best rows, for each value of ``per``, with ``rank`` from 1.

    Rows without a score are dropped. Scores descend, 0.0 standing above -0.0;
    ties go to the smaller ``tie``. Spark keeps ``limit`` rows a task.
    """
    order = [*total_order(F.col(score)), F.col(tie).asc()]
    held = scored.where(F.col(score).isNotNull())
    if per:
        numbered = held.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)).cast("long"))
        return numbered.where(F.col("rank") <= limit)
    best = held.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def gather_top(scored: DataFrame, limit: int, score: str = "gather_score", tie: Sequence[str] = ("corpus", "doc_id"), per: Sequence[str] = ()) -> DataFrame:
    """The ``limit`` best rows with dense ``gather_rank`` from 0; ties go by ``tie``."""
    order = [F.col(score).desc(), *(F.col(t).asc() for t in tie)]
    if per:
        numbered = scored.withColumn("gather_rank", (F.row_number().over(Window.partitionBy(*per).orderBy(*order)) - 1).cast("long"))
        return numbered.where(F.col("gather_rank") < limit)
    best = scored.orderBy(*order).limit(limit)
    return best.withColumn("gather_rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
