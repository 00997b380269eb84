"""Weak labels against planted accuracies, and the scorer on held-out labelled documents."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm.quality_classifier import ABSTAIN, BAD, BITS, GOOD, LABELLERS, classify, estimate, keep_good, measures, sketch, train, votes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_accuracies_are_recovered():
    g = np.random.default_rng(0)
    n, k = 20_000, len(LABELLERS)
    truth = g.random(n) < 0.8
    right = np.linspace(0.65, 0.95, k)
    said = np.where(g.random((n, k)) < right, truth[:, None], ~truth[:, None])
    v = np.where(g.random((n, k)) < 0.3, ABSTAIN, np.where(said, GOOD, BAD))
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    found = estimate(patterns, counts)
    assert found.prior == pytest.approx(0.8, abs=0.03)
    got = found.table[:, 1, GOOD] / (1 - found.table[:, 1, ABSTAIN])
    assert np.abs(got - right).max() < 0.05
    assert ((found.posterior(v) >= 0.5) == truth).mean() > 0.97


def test_short_and_empty_texts_have_no_votes():
    for text in (b"", b" ", b"a b c", "é".encode()):
        assert (votes(measures(text)[None]) == ABSTAIN).all()


def test_long_texts_are_measured_whole():
    clean = b"A plain sentence with some words follows here. " * 40_000
    assert measures(clean + b"###&&& " * 40_000)[0] == pytest.approx(6 / (39 + 6))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("rows", [100, 511, 512, 2000])
def test_the_most_frequent_word_is_counted_in_the_whole_text(rows):
    """Whatever the period of a text and its length."""
    at = list(LABELLERS).index("common")
    for first, last in ((b"unit ", b""), (b"", b" unit")):
        text = b" ".join(first + b" ".join(b"w%d" % (7 * i + k) for k in range(7)) + last for i in range(rows))
        assert measures(text)[at] == pytest.approx(1 / 8)
    assert measures(b" ".join(b"junk w%d" % i for i in range(rows)))[at] == pytest.approx(1 / 2)


def test_held_out_labels(spark):
    """Labels are not used in training; 97 of 100 must be right, and hardly a good document may go."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs).join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.97
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.99


def test_nulls_repeats_clashes_and_nothing(spark):
    good = "This is a sentence of plain words that nobody would want to throw away. " * 5
    bad = "buy### now&&& cheap*** pills%%% here### now&&& " * 10
    rows = [(i, good + str(i)) for i in range(30)] + [(i, bad + str(i)) for i in range(30, 40)] + [(None, good), (None, None), (7, good), (50, ""), (1, good + "1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("posterior", F.lit("p")).withColumn("score", F.lit("s")).withColumn("kept", F.lit(0))
    got = classify(docs)
    assert got.columns == ["doc_id", "posterior", "score", "kept"]
    found = got.collect()
    assert len(found) == len(rows)
    assert all(not r.kept for r in found if r.doc_id in range(30, 40) or r.doc_id == 50)
    out = keep_good(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert sum(t.startswith("This") for t in texts) == 33 and not any(t.startswith("buy") for t in texts)
    assert classify(docs.where("false")).collect() == [] and keep_good(docs.where("false")).collect() == []


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i, ("some words in a text " if i % 5 else "a## b&& c** ") * 20 + str(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((r.doc_id, r.kept, round(r.score, 9)) for r in classify(docs.repartition(n)).collect()) for n in (1, 7))
    assert a == b


def slow_estimate(rows, rounds=100):
    """Expectation maximisation document by document, in plain Python."""
    k = len(rows[0])
    p = [(sum(v == GOOD for v in r) + 1) / (sum(v == GOOD for v in r) + 6 * sum(v == BAD for v in r) + 1.5) for r in rows]
    prior, table = 0.8, None
    for _ in range(rounds):
        prior = min(0.99, max(0.05, (sum(p) + 1) / (len(rows) + 2)))
        new = []
        for j in range(k):
            n = [[1.0] * 3 for _ in range(2)]
            for r, x in zip(rows, p, strict=True):
                n[0][r[j]] += 1 - x
                n[1][r[j]] += x
            silent = (n[0][ABSTAIN] + n[1][ABSTAIN]) / sum(map(sum, n))
            bad, good = n[0][BAD] / (n[0][BAD] + n[0][GOOD]), n[1][GOOD] / (n[1][BAD] + n[1][GOOD])
            if bad + good < 1:
                bad = good = 0.5
            new.append([{BAD: (1 - silent) * bad, ABSTAIN: silent, GOOD: (1 - silent) * (1 - bad)}, {BAD: (1 - silent) * (1 - good), ABSTAIN: silent, GOOD: (1 - silent) * good}])
        done = table is not None and max(abs(a[c][v] - b[c][v]) for a, b in zip(new, table, strict=True) for c in (0, 1) for v in range(3)) < 1e-7
        table = new
        p = []
        for r in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(r))
            p.append(1 / (1 + math.exp(-max(-60, min(60, odds)))))
        if done:
            break
    return prior, table, p


def test_estimates_equal_a_loop_over_documents():
    r = random.Random(5)
    rows = [tuple(r.choices([BAD, ABSTAIN, GOOD], [1, 3, 6] if i % 5 else [6, 2, 1])[0] for _ in range(4)) for i in range(400)]
    counts = Counter(rows)
    patterns = sorted(counts)
    found = estimate(np.array(patterns), np.array([counts[x] for x in patterns]))
    prior, table, p = slow_estimate(rows)
    assert found.prior == pytest.approx(prior, abs=1e-6)
    assert np.allclose(found.table, [[[t[c][v] for v in range(3)] for c in (0, 1)] for t in table], atol=1e-6)
    assert found.posterior(np.array(rows)) == pytest.approx(p, abs=1e-5)


def slow_sketch(text):
    """The cells of a text, feature by feature."""
    size, mask = 1 << BITS, (1 << 32) - 1
    cell = lambda kind, x: ((x * 0x9E3779B1 + kind * 0x7F4A7C15) & mask) >> (32 - BITS)
    total = [0.0] * size
    grams = [text[i : i + 3] for i in range(len(text) - 2)]
    for g in grams:
        total[cell(0, (g[0] * 0x10001 + g[1] * 0x101 + g[2]) & mask)] += 1 / len(grams)
    for kind, items in ((1, text.split()), (2, [x for x in text.split(b"\n") if x.strip()])):
        for i, x in enumerate(items):
            before = [j for j in range(i) if items[j] == x]
            gap = min(16, math.ceil(math.log2(i - before[-1]))) if before else 31
            total[cell(kind, gap)] += 1 / len(items)
    return [round(255 * math.sqrt(x / 3)) for x in total]


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "a b a\nb b\n\na b a\n", "é ### x x x\n" * 40, "one two\nthree one\none two " * 9])
def test_sketches_equal_a_loop_over_features(text):
    assert sketch(text.encode()).tolist() == slow_sketch(text.encode())


def test_long_texts_are_sketched_whole():
    long = b"plain words stand here and there. " * 60_000
    assert not np.array_equal(sketch(long), sketch(long + b"#$%" * 400_000))
    assert np.array_equal(sketch(long), sketch(long, long.split()))


def test_training_reaches_the_least_loss():
    """The weights that gradient descent ends at with a plain loop; and scores that tell two kinds of text apart."""
    r = random.Random(2)
    texts = [(" ".join(r.choice(["plain", "words", "are", "here", "now"]) for _ in range(30)) if i % 3 else " ".join("#" * r.randrange(1, 5) for _ in range(30))).encode() for i in range(90)]
    x, y = np.array([sketch(t) for t in texts]), np.array([float(i % 3 > 0) for i in range(90)])
    scorer = train(x, y)
    assert (((scorer.score(x) >= 0.5) == (y > 0.5))).all()
    w, rows = np.zeros((1 << BITS) + 1), np.hstack([x / 255, np.ones((90, 1))])
    loss = lambda w: np.mean(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (rows @ w))) + 0.5e-4 * (w @ w)
    for _ in range(3000):
        w -= 2.0 * ((1 / (1 + np.exp(-rows @ w)) - y) @ rows / 90 + 1e-4 * w)
    assert loss(scorer.weights) <= loss(w) + 0.01


def test_one_document_in_many_and_long_texts(spark):
    """A long text among others, and one text that is a third of all rows."""
    good = "This is a sentence of plain words that nobody would want to throw away. " * 5
    rows = [(i, good if i % 3 else good + f"and number {i}") for i in range(120)] + [(i, "buy### now&&& cheap*** pills%%% " * 20) for i in range(120, 150)] + [(200, good * 20_000), (201, "x### y&&& " * 100_000)]
    got = {r.doc_id: r.kept for r in classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {i: i < 120 or i == 200 for i, _ in rows}
