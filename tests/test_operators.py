"""Ranking, subsets, presence, postings and vector expressions on tables of a few rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heronry import Subset
from heronry.functions.text import BATCH_ROWS, BATCH_TERMS, Analyzer, term_counts, words
from heronry.functions.vectors import all_finite, dot, int8_codes, int8_decode, int8_scale, l2_norm, normalize
from heronry.operators import subset as subsets
from heronry.operators.lexical import as_candidates, bm25_scan, bm25_scores, corpus_stats, match_scores, positive, postings
from heronry.operators.presence import delete, present_rows, upsert
from heronry.operators.rank import check_scores, gather_top, rank
from heronry.plans.batch import bm25_many

NAN, INF = float("nan"), float("inf")


def scored(spark, scores):
    return spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "gather_rank long, score double")


def test_rank_drops_orders_numbers_and_truncates(spark):
    df = scored(spark, [1.0, None, 3.0, 1.0, -INF, INF])
    got = [(r["rank"], r.gather_rank) for r in rank(df, 4).orderBy("rank").collect()]
    assert got == [(1, 5), (2, 2), (3, 0), (4, 3)]
    assert rank(df.where("false"), 4).collect() == []


def test_zero_stands_above_negative_zero(spark):
    got = [r.gather_rank for r in rank(scored(spark, [-0.0, 0.0, -0.0, 0.0]), 4).orderBy("rank").collect()]
    assert got == [1, 3, 0, 2]


def test_rank_for_each_query(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, 1.0)], "q string, gather_rank long, score double")
    got = {(r.q, r["rank"]): r.gather_rank for r in rank(df, 2, per=("q",)).collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, ("b", 1): 0}


def test_nan_scores_are_an_error_and_infinities_are_not(spark):
    check_scores(scored(spark, [INF, -INF, None]))
    with pytest.raises(ValueError, match="1 scores are NaN"):
        check_scores(scored(spark, [1.0, NAN]))


def test_top_k_plans_without_a_shuffle_of_all_rows(spark):
    df = spark.range(1000).selectExpr("id AS gather_rank", "cast(id % 7 as double) AS score")
    plan = rank(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_gather_ranks_are_dense_and_ties_go_by_key(spark):
    df = spark.createDataFrame([("c", "b", 1.0), ("c", "a", 1.0), ("d", "a", 2.0)], "corpus string, doc_id string, gather_score double")
    assert [(r.corpus, r.doc_id, r.gather_rank) for r in gather_top(df, 9).orderBy("gather_rank").collect()] == [("d", "a", 0), ("c", "a", 1), ("c", "b", 2)]
    per = gather_top(df, 1, per=("corpus",)).collect()
    assert {(r.corpus, r.doc_id, r.gather_rank) for r in per} == {("c", "a", 0), ("d", "a", 0)}


@pytest.mark.parametrize("literal", [1000, 0])
def test_restrict_equals_allows(spark, literal, monkeypatch):
    """As filters, and as joins."""
    monkeypatch.setattr(subsets, "LITERAL_IDS", literal)
    keys = [(c, str(i)) for c in "abcd" for i in range(6)]
    df = spark.createDataFrame(keys, "corpus string, doc_id string")
    for s in (Subset(), Subset().including("a", ["1", "2"]).excluding("b", ["3", "9"]), Subset().including("a", []).excluding("c", [])):
        got = sorted(map(tuple, subsets.restrict(df, s).collect()))
        assert got == [k for k in keys if s.allows(*k)]
    assert subsets.restrict(df, None).count() == len(keys)
    one = df.where("corpus = 'a'").select("doc_id")
    assert sorted(r[0] for r in subsets.restrict_corpus(one, Subset().excluding("a", ["0"]), "a").collect()) == list("12345")


def test_candidate_contract(spark):
    schema = "corpus string, doc_id string, gather_score float, gather_rank long, provenance string"

    def check(rows, limit=3, subset=None):
        return subsets.check_candidates(spark.createDataFrame(rows, schema), limit, subset)

    good = [("c", "a", 1.0, 0, "p"), ("c", "b", NAN, 1, "p")]
    assert check(good) == 2 and check([]) == 0 and check(good, subset=Subset().excluding("c", [])) == 2
    for rows, limit, subset, text in (
        (good, 1, None, "were asked for"),
        ([("c", "a", 1.0, 1, "p")], 3, None, "zero-based"),
        ([("c", "a", 1.0, 0, "p"), ("c", "b", 1.0, 0, "p")], 3, None, "contiguous"),
        (good, 3, Subset().including("c", ["a"]), "outside the subset"),
        ([("c", "a", 1.0, 0, "p"), ("c", "a", 1.0, 1, "p")], 3, None, "more than once"),
        ([("c", None, 1.0, 0, "p")], 3, None, "document id"),
    ):
        with pytest.raises(ValueError, match=text):
            check(rows, limit, subset)


def test_tombstones_never_bring_older_rows_back(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("b", 1, 1)], "doc_id string, segment_id long, row long")
    gone = spark.createDataFrame([(1, 1)], "segment_id long, row long")
    assert sorted(r.doc_id for r in present_rows(rows, gone).collect()) == ["a", "c"]
    assert sorted((r.doc_id, r.segment_id) for r in present_rows(rows, None).collect()) == [("a", 0), ("b", 1), ("c", 1)]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (4, "D")], "k long, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]
    gone = spark.createDataFrame([(1,), (None,), (9,)], "k long")
    assert sorted(map(tuple, delete(old, gone, ["k"]).collect())) == [(2, "b"), (3, "c")]


@pytest.mark.parametrize(("text", "terms"), [("Café au LAIT", ["cafe", "au", "lait"]), ("straße ﬁn", ["strasse", "fin"]), ("a_b c-d 3.5", ["a_b", "c", "d", "3", "5"]), ("", []), (None, []), ("日本 語", ["日本", "語"]), ("İx", ["ix"])])
def test_analyzer(text, terms):
    assert Analyzer().tokens(text) == terms


def test_unknown_stemmers_and_tokenizers_are_refused(tmp_path):
    with pytest.raises((ValueError, ModuleNotFoundError)):
        Analyzer("no such language")
    path = tmp_path / "a.json"
    Analyzer().write(path)
    assert Analyzer.read(path) == Analyzer()
    path.write_text('{"tokenizer": "other"}')
    with pytest.raises(ValueError, match="other"):
        Analyzer.read(path)


def test_words_have_no_empty_strings(spark):
    df = spark.createDataFrame([("  a  b c ",), ("",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["a", "b", "c"], []]


def test_match_scores(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, match_scores(df, " a  b ").collect())) == [(1, 3)]
    assert match_scores(df, "  ").collect() == []


def test_bm25_equals_a_loop(spark):
    r = random.Random(1)
    texts = {f"d{i}": " ".join(r.choice("abcdefgh") for _ in range(r.randrange(30))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    query = ["a", "c", "a", "zz"]
    counted = term_counts(df, Analyzer(), only=query)
    got = dict(positive(bm25_scores(postings(counted), corpus_stats(counted), query)).collect())
    scanned = dict(positive(bm25_scan(counted, query)).select("doc_id", "score").collect())
    bags = {d: t.split() for d, t in texts.items()}
    mean, n = sum(map(len, bags.values())) / len(bags), len(bags)
    for d, bag in bags.items():
        score = 0.0
        for t in query:
            df_, tf = sum(t in b for b in bags.values()), bag.count(t)
            if tf:
                score += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf / (1.5 * (1 - 0.75 + 0.75 * len(bag) / mean) + tf)
        assert got.get(d, 0.0) == pytest.approx(score) == scanned.get(d, 0.0)
    assert bm25_scores(postings(counted), corpus_stats(counted), []).collect() == [] == bm25_scan(counted, []).collect()


def test_term_counts_send_parts_of_bounded_size(spark, monkeypatch):
    """Whatever batches a worker is given: its memory must not grow with a task's documents."""
    session = spark.newSession()
    df = session.createDataFrame([(0, "a", "x")], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = term_counts(df, Analyzer(), keep=("lang",))
    assert int(session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == BATCH_ROWS
    texts = [" ".join(f"w{(7 * i + j) % 5000} w{i}" for j in range(150)) for i in range(2000)] + ["", None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array([str(i) for i in range(len(texts))])], names=["doc_id", "text", "lang"])
    parts = list(run(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 1 and max(len(p.column("terms").keys) for p in parts) < BATCH_TERMS + 300
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["doc_id"], r["dl"], dict(r["terms"]), r["lang"]) for r in rows] == [(i, len((t or "").split()), Counter((t or "").split()), str(i)) for i, t in enumerate(texts)]


def test_equal_counts_have_equal_scores_in_any_order_of_postings(spark):
    """Sums in the order of arrival differ in the last bit, and then ties don't go to the smaller id."""
    terms = list("abcdef")
    tf, df = dict(zip(terms, (1, 2, 3, 1, 5, 7))), dict(zip(terms, (30, 17, 9, 5, 3, 2)))
    r, rows = random.Random(3), []
    for doc in range(64):
        rows += [(t, doc, tf[t], 40) for t in r.sample(terms, 6)]
    rows += [(t, 1000 + i, 1, 9) for t in terms for i in range(df[t])]
    stats = spark.createDataFrame([(200, 37.3)], "n long, avgdl double")
    held = spark.createDataFrame(rows, "term string, doc_id long, tf int, dl long").coalesce(1)
    one = {score for doc, score in bm25_scores(held, stats, terms).collect() if doc < 64}
    many = {x.score for x in bm25_many(held, stats, {"q": terms}).collect() if x.doc_id < 64}
    assert len(one) == 1 and one == many


def test_scores_that_are_not_positive_are_no_candidates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", NAN), ("d", -1.0), ("e", 2.0)], "doc_id string, score double")
    got = as_candidates(positive(df), "k", 5, "p").orderBy("gather_rank").collect()
    assert [(r.corpus, r.doc_id, r.gather_rank, r.provenance) for r in got] == [("k", "e", 0, "p"), ("k", "a", 1, "p")]


def test_vector_expressions(spark):
    g = np.random.default_rng(7)
    vectors = [g.normal(size=9).astype(np.float32) for _ in range(50)] + [np.zeros(9, np.float32), np.array([2.5, -2.5, 0.5, -0.5, 1.5, 127, -127, 3.5, 0], np.float32)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "i int, v array<float>").withColumn("s", int8_scale(F.col("v")))
    rows = df.select("i", "s", l2_norm(F.col("v")).alias("n"), dot(F.col("v"), F.col("v")).alias("d"), normalize(F.col("v")).alias("u"), int8_codes(F.col("v"), F.col("s")).alias("c")).collect()
    for r in rows:
        v = vectors[r.i].astype(np.float64)
        assert r.n == pytest.approx(np.linalg.norm(v)) and r.d == pytest.approx(v @ v)
        assert np.allclose(r.u, v / max(np.linalg.norm(v), 1e-12), atol=1e-6)
        scale = max(np.float32(np.abs(vectors[r.i]).max() / np.float32(127)), np.float32(1e-12))
        assert np.float32(r.s) == scale
        q = (vectors[r.i] / scale).astype(np.float32)
        assert r.c == [int(np.clip(np.copysign(np.floor(np.abs(np.float64(x)) + 0.5), x), -127, 127)) for x in q]
    assert rows[-1].c == [3, -3, 1, -1, 2, 127, -127, 4, 0]
    back = df.select("v", int8_decode(int8_codes(F.col("v"), F.col("s")), F.col("s"), True).alias("b")).limit(50).collect()
    for r in back:
        assert np.abs(np.array(r.b) - np.array(r.v) / np.linalg.norm(r.v)).max() < 1e-2


def test_finite(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([NAN],), ([INF],), ([-INF],), ([None],), ([],)], "v array<float>")
    assert [r[0] for r in df.select(all_finite(F.col("v"))).collect()] == [True, False, False, False, False, True]
