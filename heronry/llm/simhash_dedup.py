"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Two within ``radius``
differing bits agree on at least one of ``radius + 1`` segments, so every
distinct fingerprint is filed under each of its segments and compared only in
the buckets it shares. In a bucket the fingerprints are stored as vertical bit
planes: one machine word holds the same bit of 64 fingerprints, carry-save
counters built of bitwise operations add up 64 distances at once, and words in
which every distance is beyond the radius are abandoned. Buckets that stay
large are split again by segments of their remaining bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.components import connected_components
from heronry.llm.scratch import cut, small_or_not, text_batches

#: Rows of a bucket that are compared in one piece; larger ones are split by further bits.
BUCKET_ROWS = 8192
#: Rows that a bucket should have on average.
TARGET_ROWS = 256
SEED = 42
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes | None, words_per_shingle: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 if it is null or has no word.

    ASCII letters are lower-cased, words are runs of bytes other than ASCII
    white space, shingles count as often as they occur, and a text of fewer
    words is one shingle.
    """
    words = data.lower().split() if data else []
    if not words:
        return 0
    text, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(words_per_shingle, n)
    starts = np.concatenate(([0], ends[: n - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Rows ``(doc_id, fp)`` for every row of ``docs``; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py(), words_per_shingle) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _masks(positions: list[int], pieces: int) -> list[int]:
    """``positions`` in contiguous groups, as bit masks."""
    return [sum(1 << int(p) for p in part) for part in np.array_split(positions, pieces)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks(n: int, radius: int) -> list[int]:
    """Bit masks such that fingerprints within ``radius`` agree under one of them.

    While one segment of ``radius + 1`` has bits enough for buckets of about
    TARGET_ROWS, its leading bits are the key. For more fingerprints the
    masks join several of more segments; the links found are the same.
    """
    need = max(0, math.ceil(math.log2(max(1, n) / TARGET_ROWS)))
    for pieces in range(radius + 1, radius + 5):
        parts = np.array_split(range(64), pieces)
        same = pieces - radius
        if need <= same * (64 // pieces) or pieces == radius + 4:
            chosen = []
            for group in itertools.combinations(parts, same):
                bits = [int(p) for part in group for p in part[-math.ceil(need / same) :]] if need else []
                chosen.append(sum(1 << p for p in bits))
            return chosen if need else [0]
    raise AssertionError


def linked_rows(fps: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``fps`` (distinct, uint64) the later rows within ``radius`` bits, if any."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    masks = np.where(bits, _ONES, np.uint64(0))
    spare = np.zeros(words * 64, np.uint8)
    spare[n:] = 1
    spare = np.packbits(spare, bitorder="little").view("<u8")
    depth = max(1, radius.bit_length())
    for r0 in range(0, n, rows):
        part, w0 = masks[r0 : r0 + rows], r0 // 64
        shape = (len(part), words - w0)
        over = np.broadcast_to(spare[w0:], shape).copy()
        sums = [np.zeros(shape, np.uint64) for _ in range(depth)]
        at_row = at_word = None
        for b in range(64):
            if at_row is None:
                carry = planes[b, w0:][None, :] ^ part[:, b][:, None]
            else:
                carry = planes[b, at_word] ^ part[at_row, b]
            for s in sums:
                up = s & carry
                s ^= carry
                carry = up
            over |= carry
            if b in (15, 23, 31, 47, 63):
                alive = np.nonzero(over != _ONES)
                if at_row is None:
                    at_row, at_word = alive[0], alive[1] + w0
                else:
                    at_row, at_word = at_row[alive[0]], at_word[alive[0]]
                over, sums = over[alive], [s[alive] for s in sums]
                if not len(over):
                    break
        if not len(over):
            continue
        which, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left, right = at_row[which] + r0, at_word[which] * 64 + lane
        good = (right > left) & (right < n)
        left, right = left[good], right[good]
        good = np.bitwise_count(fps[left] ^ fps[right]) <= radius
        left, right = left[good], right[good]
        if not len(left):
            continue
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        starts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        for s, e in zip(starts, [*starts[1:], len(left)], strict=True):
            yield int(left[s]), right[s:e]


def forest(n: int, links: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with."""
    label = np.arange(n)
    for row, others in links:
        seen = np.append(label[others], label[row])
        low = seen.min()
        if (seen != low).any():
            label[np.isin(label, seen)] = low
    return label


def _compare(radius: int):
    def bucket(rep: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = forest(len(fp), linked_rows(fp.view(np.uint64), radius))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return rep[moved], rep[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket, of bounded size, is held at a time."""
        kept = [np.empty(0, np.int64)] * 4

        def flush(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            path, key, rep, fp = cols
            cuts = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *cuts.tolist(), len(path)] if last else [0, *cuts.tolist()]
            out = [bucket(rep[s:e], fp[s:e]) for s, e in zip(edges, edges[1:], strict=False) if e - s > 1]
            a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2
            return [c[edges[-1] :] for c in cols], pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            kept = [np.concatenate((k, c.to_numpy(zero_copy_only=False))) for k, c in zip(kept, batch.columns, strict=True)]
            kept, out = flush(kept, False)
            yield out
        yield flush(kept, True)[1]

    return run


def fingerprint_links(reps: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A spanning forest ``(a, b)`` over ``reps(rep long, fp long)``, one row per distinct fingerprint.

    Two reps are connected in it just if a chain of fingerprints leads from one
    to the other with steps of ``radius`` bits at most. Buckets above
    ``bucket_rows`` are filed again under each of ``radius + 1`` segments of
    the bits that their key leaves free, until they fit; as fingerprints are
    distinct, that ends when few bits are free.
    """
    masks = first_masks(reps.count(), radius)

    def filed(df: DataFrame, groups: list[list[int]]) -> DataFrame:
        """``df(path, rep, fp)`` under all masks of its path's group."""
        flat = list(itertools.chain.from_iterable(groups))
        first = list(itertools.accumulate(map(len, groups), initial=0))
        at = F.explode(F.sequence(F.element_at(F.array(*map(F.lit, first)), F.col("path") + 1), F.element_at(F.array(*map(F.lit, first)), F.col("path") + 2) - 1))
        rows = df.select(at.alias("path"), "rep", "fp")
        mask = F.element_at(F.array(*(F.lit(_signed(m)).cast("long") for m in flat)), F.col("path") + 1)
        return rows.select("path", F.col("fp").bitwiseAND(mask).alias("key"), "rep", "fp")

    rows = filed(reps.select(F.lit(0).alias("path"), "rep", "fp"), [masks])
    done = []
    while True:
        splits = [sum(1 for p in range(64) if not m >> p & 1) > bucket_rows.bit_length() - 1 for m in masks]
        large = rows.groupBy("path", "key").count().where(F.col("count") > bucket_rows).select("path", "key")
        if not any(splits):
            break
        large = cut(large, "large-buckets")
        n_large = large.count()
        if not n_large:
            break
        hint = small_or_not(large)
        level = F.lit(len(done))
        done.append(rows.join(hint, ["path", "key"], "left_anti").withColumn("level", level))
        groups = []
        for m in masks:
            free = [p for p in range(64) if not m >> p & 1]
            groups.append([m | x for x in _masks(free, radius + 1)])
        rows = filed(rows.join(hint, ["path", "key"], "left_semi").drop("key"), groups)
        masks = [m for g in groups for m in g]
    rows = rows.withColumn("level", F.lit(len(done)))
    for other in done:
        rows = rows.unionByName(other)
    dealt = rows.select((F.col("path").cast("long") * 16 + F.col("level")).alias("path"), "key", "rep", "fp").repartition("path", "key")
    return dealt.sortWithinPartitions("path", "key").mapInArrow(_compare(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits and ``component_id`` the
    smallest doc_id that links lead to, the document's own included. Null and
    empty texts have fingerprint zero and link like any other. Rows with equal
    doc_id are one node each way; rows with null doc_id get the component of
    their fingerprint (null if it has no other). An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    same_id = fps.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y and doc_id is not null").select("doc_id")
    links = fingerprint_links(reps.where("rep is not null"), radius, bucket_rows)
    shared = fps.join(same_id, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.union(shared))
    named = reps.join(found, reps.rep == found.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of smallest id.

    Rows are judged by their id: rows that share an id stay or go together, and
    rows with a null id, which can't be named, stay. Of documents without a word,
    null and empty texts alike, one stays; texts of any length are read whole.
    Columns pass unchanged, whatever their names; an empty table stays one.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    gone = cut(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "duplicates")
    gone = small_or_not(gone)
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
