"""The corpus pipeline, stage by stage, against brute force over what each stage got."""

import hashlib
import os
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_mixing import filled
from test_quality_rules import brute
from test_simhash_dedup import slow_components, slow_fingerprint

import corpus_pipeline
from heronry.llm import bpe, quality_classifier

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ["quality_rules", "quality_classifier", "simhash_dedup", "mixing", "bpe"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Each stage's result, written and read again; first the documents themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = found[name] = spark.read.parquet(path)
    return {k: (v.columns, [r.asDict() for r in v.collect()]) for k, v in found.items()} | {"frames": found}


def test_stages(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    for name in NAMES[:-1]:
        assert kept[name][0] == kept["documents"][0]


def test_rules(kept):
    """The labels here are too few for any cutoff, so the base rules decide."""
    expected = [d for d in kept["documents"][1] if not brute(d["text"])[-1]]
    assert sorted(kept["quality_rules"][1], key=repr) == sorted(expected, key=repr)


def test_classifier(kept):
    verdicts = {r.doc_id: r.kept for r in quality_classifier.classify(kept["frames"]["quality_rules"]).collect()}
    assert sorted(d["doc_id"] for d in kept["quality_classifier"][1]) == sorted(i for i, k in verdicts.items() if k)


def test_near_copies(kept):
    rows = kept["quality_classifier"][1]
    groups = slow_components([d["doc_id"] for d in rows], [slow_fingerprint(d["text"]) for d in rows])
    assert sorted(d["doc_id"] for d in kept["simhash_dedup"][1]) == sorted(set(groups.values()))


def test_mix(kept):
    rows = kept["simhash_dedup"][1]
    sizes, drawn = defaultdict(int), defaultdict(int)
    words = {d["doc_id"]: len((d["text"] or "").split()) for d in rows}
    for d in rows:
        sizes[d["source"]] += words[d["doc_id"]]
    times = Counter(d["doc_id"] for d in kept["mixing"][1])
    assert set(times) <= set(words) and max(times.values()) <= 2
    for d in rows:
        drawn[d["source"]] += times[d["doc_id"]] * words[d["doc_id"]]
    longest = max(words.values())
    for s, target in filled(sizes).items():
        assert abs(drawn[s] - target) <= longest


def test_tokens(kept):
    made, _ = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    texts = {d["doc_id"]: d["text"] for d in kept["mixing"][1]}
    assert len(kept["bpe"][1]) == len(kept["mixing"][1])
    for r in kept["bpe"][1]:
        ids = made.encode_ordinary(texts[r["doc_id"]])
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(r["ids_sha256"] for r in kept["bpe"][1])


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeats, clashing columns and an empty table."""
    good = " ".join(f"plain{i % 83} words" for i in range(200))
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (None, good, None, None), (None, None, None, None), (2, "", "en", "b"), (3, "x " * 500_000, "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("k")).withColumn("fp", F.lit(0)).withColumn("block", F.lit("b"))
    spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns
            out.collect()
