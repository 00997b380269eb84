"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are first merged to one with a weight. The others are assigned
to spherical k-means cells whose centroids are fitted on a bounded sample;
each cell of a label is dealt, by rings around its centroid where it is large,
into tiles of bounded size. Two tiles of a label are multiplied unless the
triangle inequality, from the angle between their centroids and the angles to
them, shows that none of their vectors can be near each other: cells save
work, never links. A product gives link counts and a spanning forest, not
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from heronry.llm.components import connected_components
from heronry.llm.scratch import cut, small_or_not
from heronry.llm.simhash_dedup import forest

#: Distinct vectors that centroids are fitted on, at most.
FIT_ROWS = 20_000
#: Distinct vectors for each cell, and cells at most.
CELL_ROWS, MAX_CELLS = 16_384, 2048
#: Bytes of a tile's vectors in double precision, about; a task holds two tiles.
TILE_BYTES = 3 << 20
#: Cells without a centroid: vectors of another length than most, and labels that fit in one tile.
OTHER_LENGTH, WHOLE_LABEL = -1, -2
#: Rings for each linking angle, and what is added to angles for rounding, which near zero is about 1e-8.
RINGS, SLACK = 4, 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` unit centroids for the unit rows of ``x``, from evenly spaced seeds."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        moved = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
        if np.abs(moved - c).max() < 1e-9:
            break
        c = moved
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # norms neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centroids: np.ndarray):
    """Rows as they come, ``dim`` and ``embedding`` among them, with their cell and the angle to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell, angle = np.full(len(dims), OTHER_LENGTH, np.int32), np.full(len(dims), math.pi)
            if len(own := np.flatnonzero(dims == centroids.shape[1])):
                s = _matrix(b.column("embedding").take(pa.array(own))) @ centroids.T
                cell[own] = s.argmax(axis=1)
                angle[own] = np.arccos(np.clip(s.max(axis=1), -1, 1))
            yield pa.record_batch([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return run


def _near_cells(centroids: np.ndarray, reach: np.ndarray, link: float, rows: int = 256) -> pa.Table:
    """Pairs of cells, and their centroids' angles, that may hold vectors within ``link`` of each other, block by block."""
    alone = np.array([OTHER_LENGTH, WHOLE_LABEL])
    out = [(alone, alone, np.zeros(2))]
    for r0 in range(0, len(centroids), rows):
        between = np.arccos(np.clip(centroids[r0 : r0 + rows] @ centroids.T, -1, 1))
        own = np.arange(len(between))
        between[own, own + r0] = 0.0
        i, j = np.nonzero(between - reach[r0 : r0 + rows, None] - reach[None, :] <= link + SLACK)
        out.append((i + r0, j, between[i, j]))
    a, b, apart = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"cell": pa.array(a, pa.int32()), "cell_b": pa.array(b, pa.int32()), "apart": apart})


def _products(threshold: float, rows: int = 256):
    def unit(side: np.ndarray, gid: np.ndarray, rep: np.ndarray, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Link counts by gid and forest edges between reps of one tile with itself or of two tiles."""
        na = int((side == 0).sum())
        one = na == len(side)
        count = np.zeros(len(side), np.int64)

        def links() -> Iterator[tuple[int, np.ndarray]]:
            right, first = (x, 0) if one else (x[na:], na)
            for r0 in range(0, na, rows):
                near = x[r0 : min(na, r0 + rows)] @ right.T >= threshold
                if one:
                    at = np.arange(len(near))
                    near[at, at + r0] = False
                else:
                    count[na:] += w[r0 : r0 + len(near)] @ near
                count[r0 : r0 + len(near)] += near @ w[first:]
                for r in np.flatnonzero(near.any(axis=1)):
                    yield r0 + int(r), np.flatnonzero(near[r]) + first

        label = forest(len(side), links())
        moved = np.flatnonzero(label != np.arange(len(side)))
        some = np.flatnonzero(count)
        return [gid[some], count[some], rep[moved], rep[label[moved]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit and side; one unit, of bounded size, is held at a time."""
        held: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            side, gid, rep, w = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
            gid, n, a, b = unit(side, gid, rep, w, _matrix(t.column(5).chunk(0)))
            return pa.record_batch(
                [
                    pa.concat_arrays([pa.array(gid), pa.nulls(len(a), pa.int64())]),
                    pa.concat_arrays([pa.array(n), pa.nulls(len(a), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(gid), pa.int64()), pa.array(a)]),
                    pa.concat_arrays([pa.nulls(len(gid), pa.int64()), pa.array(b)]),
                ],
                names=["gid", "links", "a", "b"],
            )

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            u = t.column(0).to_numpy()
            ends = [*(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist()]
            for s, e in zip([0, *ends], ends, strict=False):
                yield done(t.slice(s, e - s))
            held = t.slice(ends[-1] if ends else 0)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def embedding_groups(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    fit_rows: int = FIT_ROWS,
    cell_rows: int = CELL_ROWS,
    tile_rows: int | None = None,
) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    Two vectors link if their labels are equal and not null, their lengths are
    equal, and their cosine in double precision is ``threshold`` or more.
    Vectors that are null, empty or zero, that hold null or non-finite
    components, and rows with null id link with nothing (no links, own id as
    component, kept). Repeated rows link with each other; rows of equal id are
    one node. An empty table gives no rows; other columns are not read, whatever
    their names.

    Equal vectors of a label are found by a 128-bit hash. After that merge,
    which moves each distinct vector once, vectors are moved once for every
    unit of work that they are in: one, where a label fits in a tile.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    good = F.coalesce(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    key = ["k1", "k2"]
    base = base.withColumn("good", good).withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.xxhash64(F.lit(7), "embedding", "label"))
    merged = cut(
        base.where("good")
        .groupBy(*key)
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("gid", F.monotonically_increasing_id()),
        "vectors",
    )
    n = merged.count()
    dims = merged.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = dims["dim"] if dims else 1
    tile_rows = tile_rows or max(256, TILE_BYTES // (8 * dim))
    k = min(MAX_CELLS, max(1, math.ceil(n / cell_rows)))
    sample = merged.where(F.col("dim") == dim).orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(fit_rows).select("embedding").toArrow()
    centroids = spherical_kmeans(_matrix(sample.column(0).combine_chunks()), k) if sample.num_rows else np.ones((1, dim))

    # the tile of a vector is decided by the sizes of its cell and ring, so that no tile is much above tile_rows
    link = math.acos(max(-1.0, min(1.0, threshold)))
    fields = merged.select("gid", "label", "dim", "rep", "w", "embedding")
    schema = StructType([*fields.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    ring = F.floor(F.col("angle") / max(link / RINGS, 1e-3)).cast("long")
    cells = cut(fields.mapInArrow(_assign(centroids), schema).withColumn("ring", ring), "cells")
    whole = F.sum("n").over(Window.partitionBy("label", "dim", "cell"))
    sizes = cells.groupBy("label", "dim", "cell", "ring").agg(F.count("*").alias("n")).withColumn("whole", whole)
    sizes = sizes.withColumn("fits", F.sum("n").over(Window.partitionBy("label", "dim")) <= tile_rows)
    sizes = sizes.select("label", "dim", "cell", "ring", "fits", (F.col("whole") > tile_rows).alias("large"), F.ceil(F.col("n") / F.lit(tile_rows)).cast("long").alias("n_tiles"))
    place = ["label", "dim", "cell", "tile"]
    tile = F.when(F.col("large"), F.shiftleft(F.col("ring"), 32) + F.pmod(F.xxhash64("gid"), F.col("n_tiles"))).otherwise(F.lit(0).cast("long"))
    dealt = cells.join(small_or_not(cut(sizes, "sizes")), ["label", "dim", "cell", "ring"]).withColumn("tile", tile)
    dealt = dealt.withColumn("cell", F.when(F.col("fits"), WHOLE_LABEL).otherwise(F.col("cell"))).drop("fits")
    tiles = cut(dealt.groupBy(*place).agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")), "tile-list")
    # pairs of cells that may hold near vectors; there are MAX_CELLS squared at most
    reach = np.full(len(centroids), -10.0)
    for r in tiles.where("cell >= 0").groupBy("cell").agg(F.max("hi").alias("hi")).collect():
        reach[r["cell"]] = r["hi"]
    near = _near_cells(centroids, reach, link)
    left, right = (tiles.select("label", "dim", *(F.col(c).alias(c + s) for c in ("cell", "tile", "lo", "hi"))) for s in ("", "_b"))
    least = F.greatest(F.col("apart") - F.col("hi") - F.col("hi_b"), F.col("lo") - F.col("apart") - F.col("hi_b"), F.col("lo_b") - F.col("apart") - F.col("hi"))
    pairs = (
        left.join(F.broadcast(spark.createDataFrame(near)), "cell")
        .join(right, ["label", "dim", "cell_b"])
        .where("struct(cell, tile) <= struct(cell_b, tile_b)")
        .where(least <= link + SLACK)
        .select("label", "dim", "cell", "tile", "cell_b", "tile_b")
        .withColumn("unit", F.monotonically_increasing_id())
    )
    pairs = cut(pairs, "tile-pairs")
    sides = pairs.select(*place, "unit", F.lit(0).alias("side")).union(
        pairs.where("cell <> cell_b or tile <> tile_b").select("label", "dim", "cell_b", "tile_b", "unit", F.lit(1).alias("side"))
    )
    rows = dealt.join(small_or_not(cut(sides, "sides")), place)
    found = cut(
        rows.select("unit", "side", "gid", "rep", "w", "embedding")
        .repartition("unit")
        .sortWithinPartitions("unit", "side")
        .mapInArrow(_products(threshold), "gid long, links long, a long, b long"),
        "links",
    )

    owned = cut(base.where("good").select("vec_id", *key).join(merged.select(*key, "gid", "rep", "w"), key).select("vec_id", "gid", "rep", "w"), "rows")
    shared = owned.groupBy("vec_id").agg(F.min("gid").alias("x"), F.max("gid").alias("y")).where("x <> y").select("vec_id")
    edges = found.where("a is not null").select("a", "b").union(owned.join(shared, "vec_id").select("vec_id", "rep"))
    components = connected_components(edges)
    counts = found.where("gid is not null").groupBy("gid").agg(F.sum("links").alias("links"))
    linked = (
        owned.join(counts, "gid", "left")
        .join(components, owned.rep == components.id, "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = base.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
