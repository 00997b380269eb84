"""Which row of which segment stands for a document, and table-level upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_rows(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows ``(doc_id, segment_id, row)``: of each document the row in its last segment.

    A partial aggregate of two numbers by document; vectors are not moved.
    """
    best = rows.groupBy(id_col).agg(F.max(F.struct("segment_id", "row")).alias("__m"))
    return best.select(id_col, "__m.segment_id", "__m.row")


def present_rows(rows: DataFrame, tombstones: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """``newest_rows`` without those that ``tombstones(segment_id, row)`` lists.

    The newest row decides first: a tombstone never brings an older row back.
    """
    newest = newest_rows(rows, id_col)
    return newest if tombstones is None else newest.join(tombstones, ["segment_id", "row"], "left_anti").select(id_col, "segment_id", "row")


def upsert(existing: DataFrame, additions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` without the keys of ``additions``, then ``additions``."""
    return existing.join(additions.select(*keys), list(keys), "left_anti").select(existing.columns).unionByName(additions)


def delete(existing: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` without the keys of ``gone``."""
    return existing.join(gone.select(*keys), list(keys), "left_anti").select(existing.columns)


def running_offsets(rows: DataFrame, value: Column, order: Sequence[str], per: Sequence[str], name: str = "offset") -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, in ``order`` within each ``per``: where a row's part begins in a packed array."""
    before = Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def repeated(rows: DataFrame, key: Sequence[Column], least: Column) -> DataFrame:
    """``(*key, n, first)`` of keys that several rows share, ``first`` being the smallest ``least`` among them."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(least).alias("first")).where("n > 1")


def freshness(writes: DataFrame, member: Sequence[Column], source: Column, time: Column) -> DataFrame:
    """``(source, as_of)``: a source is as fresh as its member whose latest write is the oldest."""
    latest = writes.groupBy(source.alias("source"), *member).agg(F.max(time).alias("as_of"))
    return latest.groupBy("source").agg(F.min("as_of").alias("as_of"))
