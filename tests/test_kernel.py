"""MaxSim over packed vectors and as DataFrame operators, against a loop."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry import ResourceBudget, maxsim_scores_packed
from heronry.functions.kernel import batches, check_query
from heronry.operators.maxsim import maxsim_arrow, maxsim_relational


def packed(seed, n, dim=8, unit=True):
    g = np.random.default_rng(seed)
    lengths = g.integers(1, 9, n)
    x = g.normal(size=(int(lengths.sum()), dim)).astype(np.float32)
    return (x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x), lengths


def slow(query, documents, lengths):
    ends = np.cumsum(lengths)
    return np.array([(query.astype(np.float64) @ documents[e - n : e].T.astype(np.float64)).max(axis=1).sum() for e, n in zip(ends, lengths, strict=True)])


@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 60), st.one_of(st.none(), st.integers(1, 7)))
@settings(deadline=None)
def test_batches_cover_all_and_keep_bounds(lengths, tokens, documents):
    found = list(batches(np.array(lengths, int), tokens, documents))
    assert [i for s, e in found for i in range(s, e)] == list(range(len(lengths)))
    for s, e in found:
        assert e - s == 1 or sum(lengths[s:e]) <= tokens
        assert documents is None or e - s <= documents


@pytest.mark.parametrize("bound", [None, 1, 7, 10_000])
def test_scores_equal_a_loop(bound):
    documents, lengths = packed(0, 40)
    query = packed(1, 3)[0]
    assert np.abs(maxsim_scores_packed(query, documents, lengths, max_batch_tokens=bound) - slow(query, documents, lengths)).max() < 2e-5


def test_no_documents():
    assert len(maxsim_scores_packed(np.ones((1, 3)), np.zeros((0, 3)), [])) == 0


@pytest.mark.parametrize(
    ("query", "documents", "lengths", "options"),
    [
        (np.ones((0, 2)), np.ones((1, 2)), [1], {}), (np.ones(2), np.ones((1, 2)), [1], {}), (np.full((1, 2), np.nan), np.ones((1, 2)), [1], {}), (np.ones((1, 3)), np.ones((1, 2)), [1], {}),
        (np.ones((1, 2)), np.ones((2, 2)), [1], {}), (np.ones((1, 2)), np.ones((2, 2)), [2, 0], {}), (np.ones((1, 2)), np.ones((1, 2)), [1], {"threads": 0}), (np.ones((1, 2)), np.ones((1, 2)), [1], {"max_batch_tokens": 0}),
        (np.ones((1, 2)), np.ones((1, 2)), [1.0], {}),
    ],
)
def test_bad_arguments(query, documents, lengths, options):
    with pytest.raises(ValueError):
        maxsim_scores_packed(query, documents, lengths, **options)


def test_query_matrices_are_checked():
    assert check_query([[1, 2]], 2).dtype == np.float32
    with pytest.raises(ValueError, match="dimension"):
        check_query([[1, 2]], 3)


def frames(spark, n=30, dim=8):
    documents, lengths = packed(3, n, dim)
    ends = np.cumsum(lengths)
    flat = [(f"d{i}", int(k), documents[e - k : e].reshape(-1).tolist()) for i, (e, k) in enumerate(zip(ends, lengths, strict=True))]
    tokens = [(d, j, v[j * dim : (j + 1) * dim]) for d, k, v in flat for j in range(k)]
    return documents, lengths, spark.createDataFrame(flat, "doc_id string, token_count int, vectors array<float>"), spark.createDataFrame(tokens, "doc_id string, pos int, vector array<float>")


@pytest.mark.parametrize("budget", [ResourceBudget(), ResourceBudget(max_batch_tokens=3), ResourceBudget(max_documents_per_batch=1, threads=2)])
def test_both_plans_agree_with_a_loop(spark, budget):
    documents, lengths, flat, tokens = frames(spark)
    asked = {"a": packed(5, 2)[0], "b": packed(6, 3)[0]}
    rows = [(q, i, v.tolist()) for q, m in asked.items() for i, v in enumerate(m)]
    relational = maxsim_relational(tokens, spark.createDataFrame(rows, "query_id string, pos int, vector array<float>"))
    by_arrow = maxsim_arrow(flat, list(asked.items()), budget=budget)
    for got, allowed in ((relational, 1e-9), (by_arrow, 2e-5)):
        found = {(r.query_id, r.doc_id): r.score for r in got.collect()}
        assert len(found) == 60
        for q, m in asked.items():
            for i, s in enumerate(slow(m, documents, lengths)):
                assert abs(found[q, f"d{i}"] - s) < allowed


def test_no_queries_and_no_documents(spark):
    flat = frames(spark)[2]
    assert maxsim_arrow(flat, []).count() == 0
    assert maxsim_arrow(flat.where("false"), [("q", np.ones((1, 8)))]).count() == 0
    with pytest.raises(ValueError, match="dimension"):
        maxsim_arrow(flat, [("a", np.ones((1, 8))), ("b", np.ones((1, 9)))])
