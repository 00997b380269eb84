"""From documents to tokens: rules, classifier, near-duplicates, mix, BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import bpe, mixing, quality_classifier, quality_rules, simhash_dedup
from heronry.llm.scratch import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accept_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs come from the labels."""
    return quality_rules.keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def accept_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps."""
    return quality_classifier.keep_good(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group."""
    return simhash_dedup.simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix draws a document."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document, with the digests of ids and of the bytes they decode to."""
    return bpe.token_digests(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", accept_by_rules),
    ("quality_classifier", accept_by_classifier),
    ("simhash_dedup", one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Hashes, fitted models and tiktoken are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written as Parquet and read by the next.

    A row for each draw of the mix, with the document's columns and its tokens.
    Null, empty and very long texts, ties, repeated rows and clashing names are
    treated as each stage's operator says; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
