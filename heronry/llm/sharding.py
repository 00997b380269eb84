"""Contiguous shards of equal bytes from global prefix sums.

Documents are put in one total order (by a hash of the text, then by id, so
that equal texts are neighbours), range-partitioned, and summed by partition.
The totals of the partitions give each its offset, a running sum inside the
partition gives each document its global byte position, and the shard is the
interval of equal length that the document's middle lies in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.scratch import cut, small_or_not

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row ``(doc_id, size, text_crc32, shard, slot)`` per row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``, a null text
    having none (and the checksum of an empty one). The bytes of two shards
    differ by no more than the largest document, so a shard may be empty when
    there are few documents. ``slot`` counts from 0 in each shard without gaps,
    in the total order. Null ids come first among equal texts, repeated rows
    take slots of their own, and an empty table gives no rows. Texts of any
    length count whole; other columns are not read, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("nth_row"),
        ),
        "sizes",
    )
    # the row's number, fixed by the written table, only tells equal rows apart, so that ranges can split any number of them
    order = ["h", "doc_id", "size", "text_crc32", "nth_row"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    # one row a partition: the totals of those before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = cut(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        ),
        "offsets",
    )
    run = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(run))
        .withColumn("nth", F.count("*").over(run))
        .join(small_or_not(offsets), "part")
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("rank", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"least({n_shards - 1}, int(cast(twice_middle as decimal(20,0)) * {n_shards} div cast(2 * all_bytes as decimal(20,0))))"))
        .select("doc_id", "size", "text_crc32", "shard", "rank")
    )
    placed = cut(placed, "placed")
    first = cut(placed.groupBy("shard").agg(F.min("rank").alias("first")), "shards")
    return placed.join(small_or_not(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, rows_per_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs``, whose ids must be unique and not null, as Parquet folders ``shard=N`` in slot order within each file."""
    placed = assign_shards(docs, n_shards, id_col, text_col).select(F.col("doc_id").alias("__id"), "shard", "slot")
    joined = docs.join(placed, F.col(id_col) == F.col("__id")).drop("__id").withColumn("__file", F.floor(F.col("slot") / rows_per_file))
    dealt = joined.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file")
    dealt.write.partitionBy("shard").parquet(path)
