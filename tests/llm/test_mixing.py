"""Targets against a direct water filling, and what the mix takes."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from heronry.llm.mixing import hypergeometric_sql, mix_documents, mix_words, source_targets, split_quotas, split_tree, write_mix

WEIGHTS = (5.0, 2.0, 1.0)


def filled(sizes, budget=1.5, cap=2.0):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, target, free = budget * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_water_filling(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 5, 100, 10_000]) + r.randrange(50) for s in ["b", "a", "", "é", "\U00010000", "￿", None][: 3 + seed]}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def documents(seed, n=3000):
    r = random.Random(seed)
    return [(i, r.choices(["hot", "b", "c", None], [6, 2, 1, 1])[0], "w " * r.choice([0, 1, 3, 20, r.randrange(200)])) for i in range(n)]


def test_taken_words_meet_targets(spark):
    data = documents(3)
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("target", F.lit("t")).withColumn("block", F.lit(0)).repartition(7)
    got = mix_words(df).collect()
    again = mix_words(df.repartition(2).select("text", "doc_id", "source")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, s, t in data:
        sizes[s] += len(t.split())
    target = filled(sizes)
    by_id = {i: (s, len(t.split())) for i, s, t in data}
    assert len(got) == len(data)
    for r in got:
        s, n = by_id[r.doc_id]
        assert (r["size"], r.source_size) == (n, sizes[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * n and len(r.shards) <= 2
        taken[s] += r.taken
    assert {s: taken[s] for s in sizes} == {s: pytest.approx(target[s], abs=1) for s in sizes}


def test_passes_differ_and_shards_are_even(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * 10) for i in range(20_000)], "doc_id long, source string, text string")
    got = mix_words(df, n_shards=4).collect()
    shards = Counter(s for r in got for s in r.shards)
    assert set(shards) == {0, 1, 2, 3}
    assert max(shards.values()) - min(shards.values()) <= 2 * 1024


def test_tree_splits_exactly(spark):
    blocks = spark.range(101).selectExpr("'s' AS source", "cast(id % 2 as int) AS pass", "cast(id as int) AS block")
    n = Counter(r.shard for r in split_tree(blocks, 5).collect())
    assert sum(n.values()) == 101 and set(n) == set(range(5)) and max(n.values()) - min(n.values()) <= 2


def test_repeats_nulls_and_nothing(spark):
    rows = [(1, "a", "x y z")] * 4 + [(None, None, "p q"), (2, "a", None), (3, "b", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_words(df).collect()
    assert len(got) == 7
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert len({r.taken for r in got if r.doc_id == 1}) == 1
    assert mix_words(df.where("false")).collect() == []


def test_documents_pass_unchanged(spark):
    df = spark.createDataFrame(documents(5, 500), "doc_id long, source string, text string").withColumn("__row", F.lit(1)).withColumn("draws", F.lit("d"))
    out = mix_documents(df)
    assert out.columns == df.columns
    known = set(map(tuple, df.collect()))
    times = Counter(map(tuple, out.collect()))
    assert set(times) <= known and max(times.values()) <= 2
    assert mix_documents(df.where("false")).collect() == []


def test_written_shards_hold_the_mix_in_a_shuffled_order(spark, tmp_path):
    """Rows are those of mix_documents; in a file, ids are not in their order, nor are sources apart."""
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * 10) for i in range(20_000)], "doc_id long, source string, text string")
    write_mix(df, str(tmp_path / "mix"), n_shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert Counter(r.doc_id for r in back.collect()) == Counter(r.doc_id for r in mix_documents(df, n_shards=4).collect())
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    for path in (tmp_path / "mix").rglob("*.parquet"):
        rows = spark.read.parquet(str(path)).collect()
        ids = [r.doc_id for r in rows]
        assert ids != sorted(ids)
        assert {r["source"] for r in rows[: len(rows) // 4]} == {"a", "b"}
    write_mix(df.where("false"), str(tmp_path / "none"))


@pytest.mark.parametrize(("id", "text", "n"), [(None, "w", 1000), (7, "a b c", 1000), (None, "w x", 333), (3, "one", 7)])
def test_equal_rows_meet_the_target_to_the_word(spark, id, text, n):
    """Rows without an id, and rows that are all the same."""
    df = spark.createDataFrame([(id, "s", text)] * n, "doc_id long, source string, text string").repartition(3)
    size = len(text.split())
    got = mix_words(df).collect()
    assert abs(sum(r.taken for r in got) - 1.5 * n * size) <= 1
    assert max(r.taken for r in got) <= 2 * size


def test_documents_without_an_id_are_told_apart(spark):
    rows = [(None, "hot" if i % 3 else None, f"w{i} " * (1 + i % 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix_words(df, n_shards=4).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    of = {v: k for k, v in sizes.items()}
    for r in got:
        taken[of[r.source_size]] += r.taken
    assert {s: taken[s] for s in sizes} == {s: pytest.approx(x, abs=1) for s, x in filled(sizes).items()}
    assert {s for r in got for s in r.shards} == set(range(4))


@pytest.mark.parametrize(("total", "marked", "drawn"), [(10, 4, 5), (50, 1, 25), (200, 150, 120), (7, 7, 3), (9, 0, 4), (5, 3, 0), (6, 2, 6)])
def test_hypergeometric_quantiles(spark, total, marked, drawn):
    """The share of quantiles that give a count is the count's chance."""
    chance = {x: math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn) for x in range(max(0, drawn - total + marked), min(marked, drawn) + 1)}
    n = 4000
    df = spark.range(n).select(F.expr(hypergeometric_sql(f"{total}L", f"{marked}L", f"{drawn}L", f"(id + 0.5D) / {n}")).alias("x"))
    got = Counter(r.x for r in df.collect())
    assert set(got) <= set(chance)
    assert all(abs(got[x] / n - p) <= 1.5 / n for x, p in chance.items())


@pytest.mark.parametrize("n_shards", [1, 2, 5, 16])
def test_quotas_are_split_exactly(spark, n_shards):
    """All blocks of every source are dealt, shards are even, and a source's share differs among shards as a draw's does."""
    quotas = {"a": 700, "b": 90, None: 33, "": 1, "empty": 0}
    df = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    ends = {r.source: r.ends for r in split_quotas(df, n_shards).collect()}
    assert {s: e[-1] for s, e in ends.items()} == quotas and all(len(e) == n_shards for e in ends.values())
    counts = {s: [y - x for x, y in zip([0, *e], e)] for s, e in ends.items()}
    assert all(n >= 0 for c in counts.values() for n in c)
    shards = [sum(c[k] for c in counts.values()) for k in range(n_shards)]
    assert max(shards) - min(shards) <= 2
    for c in counts.values():
        mean = sum(c) / n_shards
        assert all(abs(n - mean) <= 6 * math.sqrt(mean) + 1 for n in c)
    if n_shards == 16:
        assert len(set(counts["a"])) > 1


def test_shards_take_what_their_quotas_say(spark):
    blocks = spark.range(300).selectExpr("if(id < 200, 'a', null) AS source", "cast(id % 2 as int) AS pass", "cast(id div 2 as int) AS block")
    ends = {r.source: r.ends for r in split_quotas(blocks.groupBy("source").agg(F.count("*").alias("quota")), 5).collect()}
    got = Counter((r.source, r.shard) for r in split_tree(blocks, 5).collect())
    assert got == Counter({(s, k): y - x for s, e in ends.items() for k, (x, y) in enumerate(zip([0, *e], e)) if y > x})


def test_rows_of_the_mix_are_shuffled(spark):
    """Within a task's rows, shard by shard in the order of the hash, long texts and repeated rows included."""
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * 10) for i in range(3000)] + [(1, "a", "w " * 10), (9999, "a", "long " * 200_000)], "doc_id long, source string, text string").coalesce(1)
    places = {r.doc_id: list(zip(r.shards, r.orders)) for r in mix_words(df, n_shards=3).collect()}
    drawn = [r.doc_id for r in mix_documents(df, n_shards=3).select("doc_id").collect()]
    at = [min(places[i]) if len(places[i]) == 1 else None for i in drawn]
    known = [x for x in at if x is not None]
    assert known == sorted(known) and drawn != sorted(drawn)
