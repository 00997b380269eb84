"""The search pipeline with stages in memory, and with stores and lexical indexes."""

import os
import uuid
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from heronry import Candidate, Feature, Gathered, IncompatibleIndexError, IncompatibleQueryError, MaxSimReranker, Query, Representation, ResourceBudget, Scored, SearchPipeline, Subset, VectorStore, VectorStoreWriter, search_many
from heronry.functions.text import BATCH_ROWS, Analyzer
from heronry.plans import catalogue
from heronry.plans.gather import Bm25Generator, TermMatchGenerator
from heronry.plans.lexical_index import LexicalCandidateGenerator, publish

R = Representation("enc", "1", 4, True)
NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


class Fixed:
    """Gathers given keys, with scores falling from the first."""

    requires: dict = {}
    score_semantics = "fixed"

    def __init__(self, *keys, scores=None, as_of=NOW, ranks=None):
        self.keys, self.scores, self.as_of, self.ranks, self.asked = keys, scores, as_of, ranks, []

    def gather(self, query, limit, *, subset=None):
        self.asked.append((query.text, limit, subset))
        scores = self.scores or [float(len(self.keys) - i) for i in range(len(self.keys))]
        rows = [(*k.split("/"), s, i) for i, (k, s) in enumerate(zip(self.keys, scores, strict=True))]
        return Gathered([Candidate(c, d, s, i if self.ranks is None else self.ranks[i], "fixed") for c, d, s, i in rows], self.as_of)


class Given:
    requires: dict = {}
    score_semantics = "given"

    def __init__(self, scores, as_of=NOW):
        self.scores, self.as_of, self.calls = scores, as_of, 0

    def rerank(self, query, candidates, *, budget):
        self.calls += 1
        return Scored(self.scores, self.as_of)


def ids(result):
    return [f"{d.corpus}/{d.document_id}" for d in result.documents]


def search(gatherer, reranker=None, **more):
    return SearchPipeline(gatherer, reranker).search("q", **({"gather_limit": 5, "limit": 5} | more))


def test_gathered_documents_are_ordered_by_score_again():
    got = search(Fixed("c/a", "c/b", "c/c", scores=[1.0, 3.0, 3.0]))
    assert ids(got) == ["c/b", "c/c", "c/a"] and [d.rank for d in got.documents] == [1, 2, 3]
    assert got.scores == [1.0, 3.0, 3.0] and [c.document_id for c in got.candidates] == ["a", "b", "c"]


def test_reranked_drops_what_a_stage_lacks_and_takes_the_oldest_time():
    old = NOW - timedelta(days=1)
    got = search(Fixed("c/a", "c/b", "c/c", "d/a"), Given([1.0, None, 5.0, 1.0], old), limit=2)
    assert ids(got) == ["c/c", "c/a"] and got.as_of == old and got.scores[1] is None
    assert got.diagnostics == {"candidate_count": 4, "dropped": 1, "gatherer": "Fixed", "reranker": "Given", "score_semantics": "given"}
    assert got.timings.total_seconds >= got.timings.gather_seconds >= 0


def test_ties_zeros_and_infinities():
    got = search(Fixed("c/a", "c/b", "c/c", "c/d", "c/e"), Given([-0.0, 0.0, float("inf"), -float("inf"), 0.0]))
    assert ids(got) == ["c/c", "c/b", "c/e", "c/a", "c/d"]


def test_no_candidates_still_ask_the_reranker():
    old, reranker = NOW - timedelta(days=1), Given([], NOW - timedelta(days=1))
    got = search(Fixed(), reranker)
    assert got.documents == () and reranker.calls == 1 and got.as_of == old


@pytest.mark.parametrize(("more", "text"), [({"gather_limit": 0}, "gather_limit"), ({"limit": 0}, "limit must be positive"), ({"gather_limit": 1, "limit": 2}, "above")])
def test_limits(more, text):
    gatherer = Fixed("c/a")
    with pytest.raises(ValueError, match=text):
        search(gatherer, **more)
    assert not gatherer.asked


@pytest.mark.parametrize(
    ("gatherer", "more", "text"),
    [
        (Fixed("c/a", "c/b"), {"gather_limit": 1, "limit": 1}, "asked for"), (Fixed("c/a", "c/a"), {}, "more than once"), (Fixed("c/a", ranks=[1]), {}, "zero-based"),
        (Fixed("c/a", "d/a"), {"subset": Subset().including("c", ["a"])}, "outside the subset"), (Fixed("c/a", scores=[float("nan")]), {}, "NaN"),
    ],
)
def test_broken_gatherers(gatherer, more, text):
    with pytest.raises(ValueError, match=text):
        search(gatherer, **more)


@pytest.mark.parametrize(("scores", "text"), [([1.0], "1 scores"), ([1.0, float("nan")], "candidate 1")])
def test_broken_rerankers(scores, text):
    with pytest.raises(ValueError, match=text):
        search(Fixed("c/a", "c/b"), Given(scores))


def test_wrong_types():
    class Bad(Fixed):
        def gather(self, query, limit, *, subset=None):
            return []

    with pytest.raises(TypeError, match="Gathered"):
        search(Bad())
    with pytest.raises(TypeError, match="subset"):
        search(Fixed(), subset=["a"])
    with pytest.raises(TypeError, match="query"):
        SearchPipeline(Fixed()).search(3, gather_limit=1, limit=1)


def test_the_subset_reaches_the_gatherer():
    gatherer, s = Fixed("c/a"), Subset().excluding("c", [])
    search(gatherer, subset=s)
    assert gatherer.asked == [("q", 5, s)]


def test_missing_features_are_found_before_gathering():
    class Needs(Fixed):
        requires = {"x": R}

    gatherer = Needs("c/a")
    for q in (Query("q"), Query("q", x=Feature(Representation("other", "1", 4, True), 1))):
        with pytest.raises(IncompatibleQueryError):
            SearchPipeline(gatherer).search(q, gather_limit=1, limit=1)
    assert not gatherer.asked
    SearchPipeline(gatherer).search(Query("q", x=Feature(R, provider=lambda: 1 / 0)), gather_limit=1, limit=1)


def unit(n, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 4)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def store(spark, path, corpus, names, x, lengths, **more):
    w = VectorStoreWriter.create(path, corpus, R, spark=spark, **more)
    w.append(names, x, lengths)
    w.commit()
    return w, VectorStore(path, spark)


@pytest.mark.parametrize(("encoding", "allowed"), [("float32", 1e-5), ("int8", 2e-2)])
@pytest.mark.parametrize("budget", [None, ResourceBudget(max_batch_tokens=2, max_documents_per_batch=1)])
def test_two_stores_rescore_one_list(spark, tmp_path, encoding, allowed, budget):
    x, q = unit(9), unit(2, 5)
    w, left = store(spark, tmp_path / "l", "l", ["a", "b"], x[:4], [1, 3], encoding=encoding)
    _, right = store(spark, tmp_path / "r", "r", ["a", "c"], x[4:9], [2, 3], encoding=encoding)
    reranker = MaxSimReranker([left, right])
    got = SearchPipeline(Fixed("l/a", "r/a", "l/b", "r/gone", "r/c"), reranker).search(Query("q", multi_vector=Feature(R, q)), gather_limit=5, limit=5, budget=budget)
    expected = {k: (q @ v.T).max(axis=1).sum() for k, v in {"l/a": x[:1], "l/b": x[1:4], "r/a": x[4:6], "r/c": x[6:9]}.items()}
    assert {f"{d.corpus}/{d.document_id}": pytest.approx(expected[f"{d.corpus}/{d.document_id}"], abs=allowed) for d in got.documents} == {f"{d.corpus}/{d.document_id}": d.score for d in got.documents}
    assert len(got.documents) == 4 and got.diagnostics["dropped"] == 1
    if encoding == "float32":
        assert ids(got) == sorted(expected, key=expected.get, reverse=True)
    assert got.diagnostics["score_semantics"] == left.score_semantics
    w.delete(["a"])
    w.commit()
    again = SearchPipeline(Fixed("l/a"), reranker).search(Query("q", multi_vector=Feature(R, q)), gather_limit=5, limit=5)
    assert again.documents == () and again.diagnostics["dropped"] == 1


class Memory:
    """A source of vectors that isn't a store."""

    corpus, representation, score_semantics, as_of = "m", R, "float32-exact-full-maxsim", NOW - timedelta(days=3)

    def __init__(self, documents, lie=0):
        self.documents, self.lie = documents, lie

    def view(self):
        return self

    def document_lengths(self, document_ids):
        return {d: len(self.documents[d]) + self.lie for d in document_ids if d in self.documents}

    def fetch(self, document_ids, *, threads=None):
        assert len(document_ids) <= 2
        return np.concatenate([self.documents[d] for d in document_ids]), np.array([len(self.documents[d]) for d in document_ids])


def test_other_sources_are_read_in_bounded_batches(spark, tmp_path):
    documents = {str(i): unit(1 + i % 3, i) for i in range(7)}
    _, other = store(spark, tmp_path / "s", "s", ["a"], unit(1), [1])
    q, reranker = unit(2, 9), MaxSimReranker([Memory(documents), other])
    query = Query("q", multi_vector=Feature(R, q))
    got = SearchPipeline(Fixed(*(f"m/{i}" for i in range(8))), reranker).search(query, gather_limit=9, limit=9, budget=ResourceBudget(max_documents_per_batch=2))
    assert {d.document_id: d.score for d in got.documents} == {k: pytest.approx((q @ v.T).max(axis=1).sum(), abs=1e-5) for k, v in documents.items()}
    assert got.as_of == Memory.as_of  # every source counts
    with pytest.raises(ValueError, match="declared"):
        MaxSimReranker([Memory(documents, lie=1)]).rerank(query, got.candidates[:1], budget=ResourceBudget())


def test_sources_must_agree(spark, tmp_path):
    _, a = store(spark, tmp_path / "a", "a", ["a"], unit(1), [1])
    _, i = store(spark, tmp_path / "i", "i", ["a"], unit(1), [1], encoding="int8")
    for sources in ([a, a], [a, i]):
        with pytest.raises(IncompatibleIndexError):
            MaxSimReranker(sources)
    with pytest.raises(ValueError):
        MaxSimReranker([])
    query = Query("q", multi_vector=Feature(R, unit(1)))
    with pytest.raises(IncompatibleIndexError, match="zz"):
        SearchPipeline(Fixed("zz/a"), MaxSimReranker([a])).search(query, gather_limit=1, limit=1)
    with pytest.raises(IncompatibleQueryError, match="dimension"):
        SearchPipeline(Fixed("a/a"), MaxSimReranker([a])).search(Query("q", multi_vector=Feature(R, np.ones((1, 3)))), gather_limit=1, limit=1)
    # without candidates the query's vectors are not computed
    assert SearchPipeline(Fixed(), MaxSimReranker([a])).search(Query("q", multi_vector=Feature(R, provider=lambda: 1 / 0)), gather_limit=1, limit=1).documents == ()


TEXTS = {"1": "red fox and red hen", "2": "a fox", "3": "blue sky", "4": "Fóx fox fox"}


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")


def test_term_matches(documents):
    got = search(TermMatchGenerator(documents, "c", NOW))
    assert got.documents == ()
    got = SearchPipeline(TermMatchGenerator(documents, "c", NOW)).search("fox red", gather_limit=3, limit=3)
    assert ids(got) == ["c/1", "c/4", "c/2"] and [d.score for d in got.documents] == [3.0, 2.0, 1.0]


def test_lexical_indexes_and_generators_agree(spark, documents, tmp_path):
    publish(documents, str(tmp_path / "bm25"), "c", Analyzer())
    indexed, direct = LexicalCandidateGenerator(tmp_path / "bm25", Analyzer(), spark), Bm25Generator(documents, "c", NOW)
    for subset in (None, Subset().excluding("c", ["4"]), Subset().including("c", ["2", "3"]), Subset().including("other", ["2"]), Subset()):
        a, b = (SearchPipeline(g).search("FOX red", gather_limit=3, limit=3, subset=subset) for g in (indexed, direct))
        assert a.documents == b.documents
    full = SearchPipeline(direct).search("FOX red", gather_limit=3, limit=3)
    assert ids(full) == ["c/1", "c/4", "c/2"]
    part = SearchPipeline(direct).search("FOX red", gather_limit=3, limit=3, subset=Subset().including("c", ["2"]))
    assert part.documents[0].score == full.documents[2].score  # statistics are the corpus's
    for g in (indexed, direct):
        assert SearchPipeline(g).search(" ?! ", gather_limit=3, limit=3).documents == ()


def test_a_new_generation_is_followed(spark, documents, tmp_path):
    path = str(tmp_path / "bm25")
    publish(documents, path, "c", Analyzer())
    g = LexicalCandidateGenerator(path, Analyzer(), spark)
    before = SearchPipeline(g).search("hen", gather_limit=3, limit=3)
    assert g.current() is g.current()
    assert publish(documents.where("doc_id <> '1'"), path, "c", Analyzer()) == 1
    after = SearchPipeline(g).search("hen", gather_limit=3, limit=3)
    assert ids(before) == ["c/1"] and ids(after) == [] and after.as_of > before.as_of


def test_an_empty_index(spark, documents, tmp_path):
    publish(documents.where("false"), str(tmp_path / "bm25"), "c", Analyzer())
    assert SearchPipeline(LexicalCandidateGenerator(tmp_path / "bm25", Analyzer(), spark)).search("fox", gather_limit=3, limit=3).documents == ()


def test_a_batch_equals_its_single_searches(spark, documents, tmp_path):
    publish(documents, str(tmp_path / "bm25"), "c", Analyzer())
    g, x = LexicalCandidateGenerator(tmp_path / "bm25", Analyzer(), spark), unit(4)
    _, vectors = store(spark, tmp_path / "v", "c", ["1", "2", "3"], x, [1, 2, 1])
    texts, matrices = {"q1": "fox red fox", "q2": "sky hen", "q3": "nothing", "q4": ""}, {q: unit(2, i) for i, q in enumerate(("q1", "q2", "q3", "q4"))}
    state, rows = g.current()
    stats = spark.createDataFrame([(state["n"], state["avgdl"])], "n long, avgdl double")
    terms = {q: Analyzer().tokens(t) for q, t in texts.items()}
    tokens = spark.createDataFrame([(d, v.tolist()) for d, m in {"1": x[:1], "2": x[1:3], "3": x[3:]}.items() for v in m], "doc_id string, vector array<float>")
    for reranker, more in ((None, {}), (MaxSimReranker([vectors]), {"tokens": tokens, "matrices": matrices})):
        got = search_many(rows, stats, terms, 3, 2, **more).collect()
        for q, text in texts.items():
            one = SearchPipeline(g, reranker).search(Query(text, multi_vector=Feature(R, matrices[q])), gather_limit=3, limit=2)
            found = sorted((r["rank"], r.doc_id, pytest.approx(r.score, abs=1e-5)) for r in got if r.query_id == q)
            assert [(d.rank, d.document_id, d.score) for d in one.documents] == found
    with pytest.raises(ValueError):
        search_many(rows, stats, terms, 1, 2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("name", ["search_int8", "search_next_generation", "batch_search", "search_diagnostics"])
def test_a_session_s_first_search_builds_its_index_from_bounded_batches(spark, tmp_path, monkeypatch, name):
    """With Spark's own batches of 10,000 rows a worker of the build held all 1,000 texts of the table's task at once."""
    kind, session = type(spark.range(1)), spark.newSession()
    plain, notes = kind.mapInArrow, str(tmp_path)

    def noting(self, run, schema):
        def noted(batches):
            def each():
                for b in batches:
                    if "text" in b.schema.names:
                        open(f"{notes}/{b.num_rows}-{uuid.uuid4().hex}", "w").close()
                    yield b

            return run(each())

        return plain(self, noted, schema)

    monkeypatch.setattr(kind, "mapInArrow", noting)
    monkeypatch.setattr(catalogue, "_built", {})
    assert catalogue.QUERIES[name](session, "/root/testdata/sf0.01").collect()
    rows = [int(f.split("-")[0]) for f in os.listdir(notes)]
    assert max(rows) <= BATCH_ROWS and sum(rows) >= 900
