"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Expectation
maximisation over the counts of all vote patterns estimates how often each
labeller is right about each class, which gives every pattern a posterior. A
linear scorer on hashed features only is trained on the posteriors of a bounded
sample and scores every whole text. Its features are a text's byte trigrams,
and how far back each word and each line occurred last, counted in the cells
of a hash and kept as small numbers: a sketch of fixed size, so that texts go
through Python once, for votes and sketch.
"""

from __future__ import annotations

import itertools
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.scratch import cut, text_batches

#: Documents that the scorer is trained on, at most: half of them from either class.
FIT_DOCS = 4096
#: Hashed features, as a power of two.
BITS = 10
#: Kinds of features, which share the cells; the counts of a kind are shares of its own total.
TRIGRAM, WORD_GAP, LINE_GAP = 0, 1, 2
_PIECE = 1 << 20

_KIND = np.zeros(256, np.uint8)
for _byte in range(256):
    _c = chr(_byte)
    _KIND[_byte] = (
        1 if _c in "#*$%&|<>" else 2 if "A" <= _c <= "Z" else 3 if "a" <= _c <= "z" else 4 if _c in " \t\n\v\f\r" else 5 if _c == "!" else 6 if _c in ".?" else 7 if "0" <= _c <= "9" else 0
    )

#: Labeller: a document is good up to the first value of its measure, bad from the second.
LABELLERS: dict[str, tuple[float, float]] = {
    "symbols": (0.005, 0.03),  # of all but white space
    "symbol_words": (0.02, 0.2),  # words that end with a symbol
    "no_letters": (0.05, 0.1),  # of all but white space
    "doubled": (0.02, 0.2),  # marks that follow the same mark, by word
    "capitals": (0.15, 0.5),  # of ASCII letters
    "echoes": (0.02, 0.15),  # words equal to the one before
    "common": (0.2, 0.4),  # words that are the most frequent one
    "repeated": (0.5, 0.7),  # words that occurred before among each 256 words
    "compressible": (0.64, 0.8),  # share that a fast compressor saves
    "lines": (0.0, 0.3),  # lines that repeat one
}
BAD, ABSTAIN, GOOD = 0, 1, 2


def measures(data: bytes, words: list[bytes] | None = None) -> np.ndarray:
    """The measure of each labeller on a UTF-8 text; NaN where it abstains, as all do on fewer than 20 words."""
    out = np.full(len(LABELLERS), np.nan)
    words = data.split() if words is None else words
    n = len(words)
    if n < 20:
        return out
    counts, compressed, ends, doubled = np.zeros(8, np.int64), 0, 0, 0
    packer = zlib.compressobj(1)
    for at in range(0, len(data), _PIECE):
        piece = np.frombuffer(data, np.uint8, min(_PIECE, len(data) - at), at)
        kind = _KIND[piece]
        counts += np.bincount(kind, minlength=8)
        mark = (kind[:-1] == 1) | (kind[:-1] == 5)
        ends += int((mark & (kind[1:] == 4)).sum())
        doubled += int((mark & (piece[:-1] == piece[1:])).sum())
        compressed += len(packer.compress(piece))
    compressed += len(packer.flush())
    other, symbols, upper, lower, space = counts[:5].tolist()
    solid = max(1, len(data) - space)
    chunks = [words[i : i + 256] for i in range(0, n, 256)]
    out[:8] = (
        symbols / solid,
        ends / n,
        1 - (upper + lower + other) / solid,
        doubled / n,
        upper / max(1, upper + lower),
        sum(map(operator.eq, words, itertools.islice(words, 1, None))) / n,
        max(Counter(words).values()) / n,
        1 - sum(len(set(c)) for c in chunks) / n,
    )
    if len(data) >= 400:
        out[8] = 1 - compressed / len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    if len(lines) >= 4:
        out[9] = 1 - len(set(lines)) / len(lines)
    return out


_UP_TO, _FROM = (np.array([x[i] for x in LABELLERS.values()]) for i in (0, 1))


def votes(found: np.ndarray) -> np.ndarray:
    """Votes from rows of measures."""
    with np.errstate(invalid="ignore"):
        return np.where(found <= _UP_TO, GOOD, np.where(found >= _FROM, BAD, ABSTAIN))


class Accuracies(NamedTuple):
    """What expectation maximisation found."""

    prior: float  #: share of good documents
    table: np.ndarray  #: [labeller, class, vote]: chance of a vote, class 1 being good

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of each row of votes to be a good document's."""
        odds = np.full(len(patterns), np.log(self.prior) - np.log1p(-self.prior))
        for k in range(self.table.shape[0]):
            odds += np.log(self.table[k, 1, patterns[:, k]]) - np.log(self.table[k, 0, patterns[:, k]])
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Accuracies:
    """Dawid-Skene estimates from distinct rows of votes and how often each occurs.

    Starts from the votes themselves, a bad one weighing six good ones. A labeller's abstentions are held to say
    nothing about the class, and its votes not to be worse than chance.
    """
    counts = counts.astype(float)
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    p = (good + 1.0) / (good + 6.0 * bad + 1.5)
    prior, table = 0.8, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        before = table.copy()
        weight = np.stack([counts * (1 - p), counts * p])
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.05, 0.99))
        for k in range(patterns.shape[1]):
            n = np.stack([np.bincount(patterns[:, k], w, 3) for w in weight]) + 1.0
            silent = n[:, ABSTAIN].sum() / n.sum()
            right = np.array([n[0, BAD] / (n[0, BAD] + n[0, GOOD]), n[1, GOOD] / (n[1, BAD] + n[1, GOOD])])
            if right.sum() < 1:  # worse than chance
                right[:] = 0.5
            table[k] = (1 - silent) * np.array([[right[0], 0, 1 - right[0]], [1 - right[1], 0, right[1]]])
            table[k, :, ABSTAIN] = silent
        p = Accuracies(prior, table).posterior(patterns)
        if np.abs(table - before).max() < 1e-7:
            break
    return Accuracies(prior, table)


def _cells(kind: int, value: np.ndarray) -> np.ndarray:
    """The cells of features of a kind, by multiplicative hashing."""
    return (value.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(kind) * np.uint32(0x7F4A7C15)) >> np.uint32(32 - BITS)


def _gaps(items: list[bytes]) -> np.ndarray:
    """For each item the binary logarithm of how far back its equal stands, rounded up to 16; 31 for the first of its kind."""
    last: dict[bytes, int] = {}
    out = np.empty(len(items), np.int64)
    for i, x in enumerate(items):
        out[i] = i - last.get(x, -(1 << 40))
        last[x] = i
    return np.where(out > 1 << 39, 31, np.minimum(16, np.ceil(np.log2(np.maximum(out, 1))).astype(np.int64)))


def sketch(data: bytes, words: list[bytes] | None = None) -> np.ndarray:
    """The hashed features of a whole text: of each cell the square root of its share, by 255 steps. Zeros for an empty text."""
    size = 1 << BITS
    total = np.zeros(size)
    trigrams, n = np.zeros(size, np.int64), 0
    for at in range(0, max(0, len(data) - 2), _PIECE):
        b = np.frombuffer(data[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        trigrams += np.bincount(_cells(TRIGRAM, b[:-2] * np.uint32(0x10001) + b[1:-1] * np.uint32(0x101) + b[2:]), minlength=size)
        n += len(b) - 2
    if n:
        total += trigrams / n
    for kind, items in ((WORD_GAP, data.split() if words is None else words), (LINE_GAP, [x for x in data.split(b"\n") if x.strip()])):
        if items:
            total += np.bincount(_cells(kind, _gaps(items)), minlength=size) / len(items)
    return np.rint(255 * np.sqrt(total / 3)).astype(np.uint8)


class Scorer(NamedTuple):
    """Weights of the hashed features, then a bias."""

    weights: np.ndarray

    def score(self, sketches: np.ndarray) -> np.ndarray:
        """The chance of each row of sketches to be a good text's; 0 for an empty one."""
        z = sketches.astype(np.float64) @ (self.weights[:-1] / 255) + self.weights[-1]
        return np.where(sketches.any(axis=1), 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)


def train(sketches: np.ndarray, target: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> Scorer:
    """Logistic regression on sketches by Adam on the whole batch."""
    w = np.zeros((1 << BITS) + 1)
    if not len(target):
        return Scorer(w)
    x = np.hstack([sketches.astype(np.float64) / 255, np.ones((len(target), 1))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w, -60, 60))) - target) / len(target)
        g = error @ x + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Scorer(w)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def vote_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, pattern int, sketch binary)``: the votes on each document as digits to base three, and its hashed features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 3 ** np.arange(len(LABELLERS))
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                texts = [x.as_py() or b"" for x in part.column(1)]
                split = [t.split() for t in texts]
                found = [int(votes(measures(t, w)) @ power) for t, w in zip(texts, split, strict=True)]
                kept = [sketch(t, w).tobytes() for t, w in zip(texts, split, strict=True)]
                yield pa.record_batch([part.column(0), pa.array(found, pa.int32()), pa.array(kept, pa.binary())], names=["doc_id", "pattern", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, pattern int, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, 1 << BITS)


def fit(voted: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[Accuracies, Scorer]:
    """Accuracies from the votes on all documents, and the scorer trained on ``fit_docs`` of them at most.

    The sample takes documents in order of a hash of their id and sketch, as
    many from patterns held to be good as from the others.
    """
    spark = voted.sparkSession
    counted = voted.groupBy("pattern").count().orderBy("pattern").collect()  # 3 ** len(LABELLERS) rows at most
    ids = np.array([r["pattern"] for r in counted], int)
    digits = ids[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    found = estimate(digits, np.array([r["count"] for r in counted]))
    posterior = found.posterior(digits)
    known = spark.createDataFrame([(int(i), float(p)) for i, p in zip(ids, posterior, strict=True)], "pattern int, posterior double")
    scored = voted.join(F.broadcast(known), "pattern").where("doc_id is not null").withColumn("h", F.xxhash64("sketch"))
    order = [F.xxhash64("doc_id", F.lit(11)), "doc_id", "h", "pattern"]
    # the sketches of the sample are read in a second pass over the small columns' winners
    parts = [scored.where(side).select("doc_id", "h", "posterior", "pattern").orderBy(*order).limit(fit_docs // 2) for side in ("posterior < 0.5", "posterior >= 0.5")]
    chosen = parts[0].unionAll(parts[1]).distinct()
    rows = scored.drop("posterior").join(F.broadcast(chosen), ["doc_id", "h", "pattern"]).groupBy("doc_id", "h", "pattern").agg(F.first("posterior").alias("posterior"), F.first("sketch").alias("sketch"))
    table = rows.orderBy("doc_id", "h").toArrow().combine_chunks()
    if not table.num_rows:
        return found, train(np.zeros((0, 1 << BITS)), np.zeros(0))
    return found, train(_sketches(table.column("sketch")), table.column("posterior").to_numpy())


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, threshold: float = 0.5) -> DataFrame:
    """One row ``(doc_id, posterior, score, kept)`` per row of ``docs``.

    ``posterior`` is the weak labels' chance of a good document, ``score`` the
    trained scorer's, and a document is kept if its score is ``threshold`` or
    more. Labellers abstain on texts of fewer than 20 words, ``compressible``
    below 400 bytes and ``lines`` below four lines, where their measures say
    little; such texts are scored like others. Texts of any length are read
    whole. Null and empty texts score 0 and are not kept. Repeated rows and
    null ids give rows of their own, an empty table none; other columns are not
    read, whatever their names.
    """
    voted = cut(vote_table(docs, id_col, text_col), "votes")
    found, scorer = fit(voted, fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digits = b.column(1).to_numpy()[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
            yield pa.record_batch([b.column(0), pa.array(found.posterior(digits)), pa.array(scorer.score(_sketches(b.column(2))))], names=["doc_id", "posterior", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = voted.mapInArrow(run, f"doc_id {kind}, posterior double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that ``classify`` rejects, judged row by row; columns pass unchanged.

    Rows are sketched again where they pass, as joining verdicts back would
    move all texts. Null, empty and very long texts, repeated rows, null ids
    and clashing names are treated as in ``classify``; an empty table stays one.
    """
    _, scorer = fit(cut(vote_table(docs, id_col, text_col), "votes"), options.get("fit_docs", FIT_DOCS))
    threshold = options.get("threshold", 0.5)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sketches = [sketch(x.as_py() or b"") for x in column]
            yield pa.array(scorer.score(np.array(sketches, np.uint8).reshape(-1, 1 << BITS)) >= threshold, pa.bool_())

    good = F.arrow_udf(run, "boolean")
    return docs.where(good(F.col(text_col).cast("string").cast("binary")))
