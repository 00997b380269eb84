"""Ids and bytes against the library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from heronry.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
PIECES = ["word", "l'été", " ", "  ", "\n", "\r\n", "\t", "!?", "9", "_", "　", "日本", "\x1c", "'s", "\x85", "á", "👍🏽", "<|endoftext|>"]


def whole(text):
    return bpe.encoding(PATH, public_tokenizers.PATTERN)[0].encode_ordinary(text)


@pytest.mark.parametrize("seed", range(30))
def test_pieces_give_the_ids_of_the_whole_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(PIECES) * r.choice([1, 1, 3]) for _ in range(3000))
    at = r.randrange(len(text))
    text = text[:at] + r.choice([" ", "\n", "　 "]) * r.choice([0, 9000]) + text[at:]
    ids = bpe.encode(text, PATH, chars=r.choice([8, 100, 5000]))
    assert ids == whole(text)
    assert bpe.decode(ids, PATH) == text.encode()


def test_white_space_that_the_pattern_engine_cannot_take():
    text = "a" + " " * 2_000_000 + "b" + "\n" * 1_500_000
    assert bpe.decode(bpe.encode(text, PATH), PATH) == text.encode()


def test_a_word_without_boundaries():
    text = "abé" * 100_000
    assert bpe.decode(bpe.encode(text, PATH), PATH) == text.encode()


def test_ids_need_not_be_valid_utf8():
    ids = bpe.encode("日", PATH)
    cut = bpe.decode(ids[:1], PATH)
    assert cut and "日".encode().startswith(cut)


def test_digests(spark):
    rows = [(1, "Hello world, hello"), (2, None), (3, ""), (None, "x"), (1, "Hello world, hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("i")).withColumn("n_tokens", F.lit(0))
    got = bpe.token_digests(df)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def expected(i, text):
        ids = whole(text or "")
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert bpe.token_digests(df.where("false")).collect() == []


def test_tokenize_and_detokenize(spark):
    df = spark.createDataFrame([("a", "é x"), ("b", None)], "doc_id string, text string")
    tokens = bpe.tokenize(df, path=PATH)
    assert {r.doc_id: list(r.ids) for r in tokens.collect()} == {"a": whole("é x"), "b": []}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.detokenize(tokens).collect()} == {"a": "é x".encode(), "b": b""}
