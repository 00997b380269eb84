"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.scratch import cut


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step (Kiveris et al., 2014) over rows ``u > v``."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(root.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(id, component)`` for every id of ``edges(a long, b long)`` that has a neighbour.

    ``component`` is the smallest id that can be reached; that id itself is not
    listed. Self-loops, repeated edges and edges with a null end add nothing;
    no edges give no rows. Only two numbers a round come to the driver. A node
    with very many neighbours is handled by partial aggregation and by joins
    whose large partitions Spark can split.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while state[0]:
        e = cut(_star(e), "stars")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
