"""Mixing sources to target weights, in DataFrame functions only.

Targets share a budget of words by weight and stop at a cap, the excess being
shared again (water filling). Each source is read in permuted passes; a pass
is dealt into blocks by a hash, blocks are taken whole in permuted order up to
the source's quota, and the last is taken in part. The sources' exact block
quotas are split among output shards along a binary tree: at each node the
counts that go left are one multivariate hypergeometric draw, whose total is
the left half's share. A shard then takes the next blocks of each source's
permutation, as many as its quota says, so shards are disjoint; in a shard
documents are shuffled by a hash.
"""

from __future__ import annotations

import functools
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.scratch import cut, small_or_not

WEIGHTS = (5.0, 2.0, 1.0)
#: Budget in words for each word there is, and passes over a source at most.
BUDGET, PASSES = 1.5, 2
#: Rows of a block, about, and blocks of a source and pass at most.
BLOCK_ROWS, MAX_BLOCKS = 1024, 16_384
SEED = 20_240_607


class Plan(NamedTuple):
    """What decides the mix; three small tables in the shared folder."""

    targets: DataFrame  #: source, source_size, target, n_blocks
    blocks: DataFrame  #: source, pass, block, whole, shard: the blocks that are taken
    parts: DataFrame  #: source, pass, key, size, words, extra: documents of the blocks that are not whole; ``extra`` of equal ones give a word more


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _block(n_blocks: Column, p: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(SEED), F.lit(p)), n_blocks).cast("int")


def _key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart in the mix: a hash of the id, or of the text where there is none."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(F.lit(SEED), text))


def _same(*names: str) -> Column:
    return functools.reduce(operator.and_, (F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """One row per source of ``sizes(doc_id, source, size)``: its words, target and number of blocks.

    Sources take ``weights`` in turn by code point order, null last. The
    targets are the water level times the weight, at most ``passes`` times the
    source's size: in order of cap by weight, the level is that of the first
    source which stays below its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", (passes * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", F.asc_nulls_last("source"))
    capped = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    leveled = weighed.withColumn("level", (budget * F.sum("source_size").over(everything) - capped) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select(
        "source",
        "source_size",
        "target",
        F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK_ROWS))).cast("int").alias("n_blocks"),
    )


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric_sql(total: str, marked: str, drawn: str, u: str) -> str:
    """How many of ``drawn`` out of ``total`` items are among the ``marked`` ones, at the quantile ``u`` in [0, 1).

    Inverts the distribution from its mode, upwards and then downwards. Terms
    farther than 24 standard deviations, which no double would keep, are left out.
    """
    sides = (
        ("if(b.high > b.mode, sequence(b.mode + 1, least(b.high, b.mode + b.span)), cast(array() as array<bigint>))", "(b.k - x + 1) * (b.n - x + 1) / (x * (b.other + x))"),
        ("if(b.low < b.mode, sequence(b.mode - 1, greatest(b.low, b.mode - b.span), -1L), cast(array() as array<bigint>))", "(x + 1) * (b.other + x + 1) / ((b.k - x) * (b.n - x))"),
    )

    def walk(numbers: str, ratio: str, start: str, pick: str) -> str:
        state = f"named_struct('w', s.w * r, 'total', s.total + s.w * r, 'pick', {pick})"
        return f"aggregate({numbers}, {start}, (s, x) -> {_let('r', ratio, state)})"

    def both(start: str, pick: str) -> str:
        first = walk(*sides[0], start, pick)
        return _let("f", first, walk(*sides[1], "named_struct('w', 1D, 'total', f.total, 'pick', f.pick)", pick))

    mass = both("named_struct('w', 1D, 'total', 1D, 'pick', cast(null as bigint))", "s.pick")
    found = both("named_struct('w', 1D, 'total', 1D, 'pick', if(goal < 1, b.mode, cast(null as bigint)))", "coalesce(s.pick, if(goal < s.total + s.w * r, x, cast(null as bigint)))")
    body = _let("goal", f"b.u * {mass}.total", f"coalesce({found}.pick, b.mode)")
    widest = "named_struct('k', a.k, 'n', a.n, 'u', a.u, 'other', a.t - a.k - a.n, 'low', greatest(0L, a.k + a.n - a.t), 'high', least(a.k, a.n), 'span', cast(ceil(12 * sqrt(a.k)) as bigint) + 60, 'mode', greatest(greatest(0L, a.k + a.n - a.t), least(least(a.k, a.n), cast(floor((a.n + 1) * (a.k + 1) / (a.t + 2)) as bigint))))"
    return _let("a", f"named_struct('t', {total}, 'k', {marked}, 'n', {drawn}, 'u', {u})", _let("b", widest, body))


def split_quotas(quotas: DataFrame, n_shards: int) -> DataFrame:
    """``quotas(source, quota)`` as rows ``(source, ends)``: how many of a source's blocks the shards up to each take.

    One row holds a node: its range of shards and a count for every source. To
    its left half goes a multivariate hypergeometric draw of the half's share of
    all its blocks, rounded: source by source, each given those before.
    """
    listed = quotas.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("null"), F.col("quota").cast("long").alias("quota")))).alias("sources"))
    nodes = listed.select("sources", F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), F.transform("sources", lambda x: x["quota"]).alias("counts"))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda t, x: t + x)

    for _ in range(max(0, (n_shards - 1).bit_length())):
        nodes = nodes.withColumn("mid", F.expr("(lo + hi) div 2").cast("int")).withColumn("all", total(F.col("counts")))
        u = f"pmod(xxhash64(sources[i].s, sources[i].`null`, {SEED + 1}, lo, hi), 4503599627370496L) / 4503599627370496D"
        x = hypergeometric_sql("acc.rest", "counts[i]", "acc.draw", u)
        drawn = _let("x", x, "named_struct('rest', acc.rest - counts[i], 'draw', acc.draw - x, 'left', concat(acc.left, array(x)))")
        first = "named_struct('rest', `all`, 'draw', cast(round(`all` * (mid - lo) / (hi - lo)) as bigint), 'left', cast(array() as array<bigint>))"
        nodes = nodes.withColumn("left", F.expr(f"aggregate(transform(sources, (s, i) -> i), {first}, (acc, i) -> {drawn}).left"))
        right = F.zip_with("counts", "left", lambda x, y: x - y)
        alone = F.col("hi") - F.col("lo") <= 1
        same = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("counts").alias("counts")))
        halves = F.array(F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("counts")), F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), right.alias("counts")))
        nodes = nodes.select("sources", F.explode(F.when(alone, same).otherwise(halves)).alias("n")).select("sources", "n.*")
    own = nodes.select("lo", F.posexplode("counts").alias("i", "n"), "sources").select(F.get("sources", F.col("i")).alias("s"), F.col("lo").alias("shard"), "n")
    counts = own.groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "n"))), lambda x: x["n"]).alias("counts"))
    ends = F.aggregate("counts", F.array().cast("array<bigint>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    return counts.select(F.when(~F.col("s.null"), F.col("s.s")).alias("source"), ends.alias("ends"))


def split_tree(blocks: DataFrame, n_shards: int) -> DataFrame:
    """``blocks(source, pass, block, ...)`` with ``shard`` in [0, n_shards): disjoint runs of each source's permuted blocks, by ``split_quotas``."""
    ends = cut(split_quotas(blocks.groupBy("source").agg(F.count("*").alias("quota")), n_shards), "quotas")
    # a source has PASSES times MAX_BLOCKS blocks at most
    seat = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("source", "pass", "block", F.lit(SEED + 2)), "pass", "block")) - 1
    seated = blocks.withColumn("seat", seat)
    joined = seated.alias("l").join(small_or_not(ends, 100_000).alias("r"), _same("source")).select("l.*", "r.ends")
    return joined.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("seat"))).cast("int")).drop("ends", "seat")


def plan_mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, n_shards: int = 16) -> Plan:
    """The plan for ``sizes(key, source, size)``.

    Rows of equal values share the words that are left for them equally. What
    doesn't divide goes to some of them, a word each, if it is more than one of
    them holds; else it is left, and the source is so many words short.
    """
    targets = cut(source_targets(sizes, weights, budget, passes), "targets")
    few = small_or_not(targets, 100_000)
    on = sizes.alias("l").join(few.alias("r"), _same("source")).select("l.*", "r.target", "r.source_size", "r.n_blocks")
    pass_of = F.explode(F.array(*(F.struct(F.lit(p).alias("pass"), _block(F.col("n_blocks"), p).alias("block")) for p in range(passes))))
    dealt = on.select("key", "source", "size", "target", "source_size", pass_of.alias("b")).select("key", "source", "size", "target", "source_size", "b.*")
    quota = F.least(F.col("source_size"), F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.col("pass") * F.col("source_size")))
    summed = dealt.groupBy("source", "pass", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    order = F.xxhash64("source", "pass", "block", F.lit(SEED + 2))
    run = Window.partitionBy("source", "pass").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        summed.withColumn("quota", quota)
        .withColumn("room", F.col("quota") - F.coalesce(F.sum("words").over(run), F.lit(0)))
        .where("room > 0 and words > 0")
        .withColumn("whole", F.col("words") <= F.col("room"))
    )
    blocks = cut(split_tree(taken.select("source", "pass", "block", "whole", "room"), n_shards), "blocks")
    # one block of each source and pass at most is taken in part: its documents in permuted order
    last = dealt.alias("l").join(small_or_not(cut(blocks.where("not whole"), "last-blocks"), 100_000).alias("r"), _same("source", "pass", "block")).select("l.key", "l.source", "l.size", "l.pass", "r.room")
    items = last.groupBy("source", "pass", "key", "size", "room").agg(F.count("*").alias("m"))
    within = Window.partitionBy("source", "pass").orderBy(F.xxhash64("key", F.lit(SEED + 3), "pass"), "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.coalesce(F.sum(F.col("size") * F.col("m")).over(within), F.lit(0))
    words = F.least(F.col("size"), F.expr("left div m"))
    parts = items.withColumn("left", left).where("left > 0 and size > 0").withColumn("words", words).withColumn("extra", F.when((F.col("words") < F.col("size")) & (F.expr("left % m") > F.col("size")), F.expr("left % m")).otherwise(0).cast("long"))
    parts = parts.where("words > 0 or extra > 0").select("source", "pass", "key", "size", "words", "extra")
    return Plan(targets, blocks, cut(parts, "parts"))


def _numbered(rows: DataFrame, ties: DataFrame) -> DataFrame:
    """``rows`` with ``__nth``: their number, from 0, among the rows of equal source, key and size that ``ties`` names, else null.

    The rows of a tie are range-partitioned, a task numbers its part, and the
    totals of the parts before are added, so a tie may hold any share of all rows.
    """
    same = ["source", "key", "size"]
    few = small_or_not(ties)
    others = rows.alias("l").join(few.alias("r"), _same(*same), "left_anti").withColumn("__nth", F.lit(None).cast("long"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = rows.alias("l").join(few.alias("r"), _same(*same), "left_semi").withColumn("__u", F.monotonically_increasing_id())
    dealt = cut(tied.repartitionByRange(parts, *same, "__u").withColumn("__part", F.spark_partition_id()), "ties")
    before = Window.partitionBy(*same).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*same, "__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy(*same, "__part").orderBy("__u")) - 1
    placed = dealt.withColumn("__nth", nth.cast("long")).alias("l").join(small_or_not(cut(totals, "tie-totals")).alias("r"), _same(*same, "__part")).select("l.*", "r.__before")
    return others.unionByName(placed.withColumn("__nth", F.col("__nth") + F.col("__before")).select(others.columns))


def draw(rows: DataFrame, plan: Plan, passes: int = PASSES) -> DataFrame:
    """``rows``, which have ``key``, ``source`` and ``size``, with their source's figures and their draws.

    Adds ``source_size``, ``target``, ``taken`` (words over all passes) and
    ``draws``, an array of ``(pass, words, shard, order)`` for the passes that
    take the document; ``order`` is its place in the shard's shuffle. Rows are
    not shuffled while the plan's tables are small, but for equal rows that
    share a number of words which doesn't divide.
    """
    ties = cut(plan.parts.where("extra > 0").select("source", "key", "size").distinct(), "tied")
    rows = rows.withColumn("__nth", F.lit(None).cast("long")) if ties.isEmpty() else _numbered(rows, ties)
    out = rows.alias("l").join(small_or_not(plan.targets, 100_000).alias("r"), _same("source"), "left").select("l.*", "r.source_size", "r.target", F.col("r.n_blocks").alias("__n"))
    for p in range(passes):
        blocks = plan.blocks.where(F.col("pass") == p).select("source", "block", F.col("whole").alias(f"__whole{p}"), F.col("shard").alias(f"__shard{p}"))
        more = F.when(F.col("__nth") < F.col("r.extra"), 1).otherwise(0)
        parts = plan.parts.where(F.col("pass") == p).select("source", "key", "size", "words", "extra")
        out = out.withColumn("block", _block(F.col("__n"), p))
        out = out.alias("l").join(small_or_not(blocks, 200_000).alias("r"), _same("source", "block"), "left").select("l.*", f"__whole{p}", f"__shard{p}").drop("block")
        out = out.alias("l").join(small_or_not(parts).alias("r"), _same("source", "key", "size"), "left").select("l.*", (F.col("r.words") + more).alias(f"__words{p}"))
    words = [F.when(F.col(f"__whole{p}"), F.col("size")).otherwise(F.coalesce(F.col(f"__words{p}"), F.lit(0))).cast("long") for p in range(passes)]
    words = [F.coalesce(w, F.lit(0)) for w in words]
    order = [F.xxhash64("key", F.lit(SEED + 4), F.lit(p)) for p in range(passes)]
    draws = F.array(*(F.struct(F.lit(p).alias("pass"), w.alias("words"), F.col(f"__shard{p}").alias("shard"), o.alias("order")) for p, (w, o) in enumerate(zip(words, order, strict=True))))
    return (
        out.withColumn("taken", functools.reduce(operator.add, words))
        .withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
        .drop("__n", "__nth", *(f"__{k}{p}" for p in range(passes) for k in ("whole", "shard", "words")))
    )


def mix_words(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_shards: int = 16, **budget) -> DataFrame:
    """One row ``(doc_id, size, source_size, target, taken, shards, orders)`` per row of ``docs``.

    ``taken`` counts the words that the mix takes of the document, repeats
    included: at most ``passes`` times its size; the words taken of a source
    come to its target, rounded, or with repeated rows to within one of these
    documents of it, as a remainder of no more than that isn't dealt out. Of
    equal rows, some may give a word more than others. ``shards`` and ``orders`` tell for each draw the shard and the place
    in its shuffle. A null text has no words and is never taken; null is a
    source, the last; documents without an id are told apart by their text.
    Texts of any length are counted whole. Equal input gives equal output,
    whatever its order or partitions. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    text = F.col(text_col).cast("string")
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), _key(F.col(id_col), text).alias("key")), "words")
    plan = plan_mix(sizes, n_shards=n_shards, **budget)
    return draw(sizes, plan, budget.get("passes", PASSES)).select(
        "doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"), F.transform("draws", lambda d: d["order"]).alias("orders")
    )


def _drawn(docs: DataFrame, id_col: str, source_col: str, text_col: str, n_shards: int, **budget) -> DataFrame:
    """Rows ``(__row, draw)`` for the draws that give a document; ``__row`` holds its columns."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        _key(F.col(id_col), text).alias("key"),
    )
    plan = plan_mix(cut(rows.drop("__row"), "words"), n_shards=n_shards, **budget)
    drawn = draw(rows, plan, budget.get("passes", PASSES))
    times = F.filter("draws", lambda d: 2 * d["words"] >= F.col("size"))
    return drawn.select("__row", F.explode(times).alias("draw"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_shards: int = 16, **budget) -> DataFrame:
    """The mixed documents themselves: a row of ``docs`` for each draw, its columns unchanged.

    Each task's rows come shard by shard, shuffled inside a shard, without an
    exchange; ``write_mix`` brings the parts of a shard together. A draw of a
    part of a document, of which a source and pass have one, or as many as it
    has equal rows there, gives the whole one if it is half of it or more, and
    none otherwise: whole documents can't meet a target to the word. Documents
    without words, null texts among them, are not drawn. Repeated rows and null
    ids are drawn like others, long texts whole; an empty table gives no rows.
    """
    drawn = _drawn(docs, id_col, source_col, text_col, n_shards, **budget)
    return drawn.sortWithinPartitions("draw.shard", "draw.order").select("__row.*")


def write_mix(docs: DataFrame, path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_shards: int = 16, files: int = 1, **budget) -> None:
    """Write ``mix_documents`` as Parquet folders ``shard=N`` of ``files`` files each, shuffled.

    A hash of the document and the pass picks the file within the shard and the
    place within the file. ``docs`` must have no columns named
    ``shard``, ``__order`` or ``__file``; an empty table writes no shards.
    """
    draws = _drawn(docs, id_col, source_col, text_col, n_shards, **budget)
    placed = draws.select("__row.*", F.col("draw.shard").alias("shard"), F.col("draw.order").alias("__order")).withColumn("__file", F.pmod("__order", F.lit(files)))
    dealt = placed.repartition(max(1, n_shards * files), "shard", "__file").sortWithinPartitions("shard", "__order")
    dealt.drop("__order", "__file").write.partitionBy("shard").parquet(path)
