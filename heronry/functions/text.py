"""Text analysis for the lexical stages."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHOD, TOKENIZER, K1, B = "lucene", "unicode-fold", 1.5, 0.75
_WORD = re.compile(r"\w+")

#: Rows and bytes of an Arrow batch of texts, where the session has Spark's own defaults for them.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", str(BATCH_BYTES))}
#: Counted terms after which a worker sends what it has, whatever the batches it is given.
BATCH_TERMS = 100_000


@lru_cache(maxsize=1)
def _marks() -> re.Pattern[str]:
    """Runs of combining marks, as ranges of code points."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    starts = [c for c in found if not unicodedata.combining(chr(c - 1))]
    ends = [c for c in found if not unicodedata.combining(chr(c + 1))]
    return re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(starts, ends, strict=True)) + "]+")


@lru_cache(maxsize=8)
def _stem(algorithm: str):
    import Stemmer

    if algorithm not in Stemmer.algorithms():
        raise ValueError(f"no Snowball algorithm is called {algorithm!r}; there are {sorted(Stemmer.algorithms())}")
    return Stemmer.Stemmer(algorithm).stemWords


@dataclass(frozen=True)
class Analyzer:
    """Text to terms, for documents and queries alike: case-folded, without accents, runs of word characters.

    ``stemmer`` names a Snowball algorithm and needs the optional stemming package.
    """

    stemmer: str | None = None

    def __post_init__(self) -> None:
        if self.stemmer is not None:
            _stem(self.stemmer)

    def tokens(self, text: str | None) -> list[str]:
        """Terms in text order; none for null."""
        if not text:
            return []
        if text.isascii():
            terms = _WORD.findall(text.lower())
        else:
            terms = _WORD.findall(_marks().sub("", unicodedata.normalize("NFKD", text.casefold())))
        return _stem(self.stemmer)(terms) if self.stemmer is not None else terms

    def to_json(self) -> str:
        return json.dumps({"method": METHOD, "tokenizer": TOKENIZER, "stemmer": self.stemmer, "k1": K1, "b": B}, indent=1)

    def write(self, path: Path) -> None:
        Path(path).write_text(self.to_json(), encoding="utf-8")

    @classmethod
    def read(cls, path: Path) -> Analyzer:
        return cls.from_json(Path(path).read_text(encoding="utf-8"))

    @classmethod
    def from_json(cls, text: str) -> Analyzer:
        kept = json.loads(text)
        if kept.get("tokenizer") != TOKENIZER:
            raise ValueError(f"the index has tokenizer {kept.get('tokenizer')!r}; only {TOKENIZER!r} is known")
        return cls(kept.get("stemmer"))


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are set to sizes that suit whole texts.

    Batches are held at once by executor and Python worker, in buffers that
    double as they grow, for every task. The session keeps the setting, as plans
    read it when they run; values that a user chose stay.
    """
    conf = df.sparkSession.conf
    for name, (default, ours) in _BATCHES.items():
        if conf.get(name).lower() in (default, f"{default}b"):
            conf.set(name, ours)
    return df


def term_counts(docs: DataFrame, analyzer: Analyzer, id_col: str = "doc_id", text_col: str = "text", only: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(doc_id, dl, terms map<string,int>, *keep)`` for every document.

    ``dl`` counts all terms; ``terms`` holds how often each occurs, or with
    ``only`` those of these terms, so that a search needn't move the others.
    The columns ``keep`` pass through. A worker holds a batch of texts and the
    terms of a part of it, ``BATCH_TERMS`` and those of one document at most.
    """
    wanted = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, lengths, ends, found, times = 0, [], [0], [], []
            for i, cell in enumerate(b.column(1), 1):
                terms = analyzer.tokens(cell.as_py())
                lengths.append(len(terms))
                counted = Counter(terms if wanted is None else filter(wanted.__contains__, terms))
                found += counted
                times += counted.values()
                ends.append(len(found))
                if len(found) >= BATCH_TERMS or i == b.num_rows:
                    maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.string()), pa.array(times, pa.int32()))
                    part = b.slice(first, i - first)
                    columns = [part.column(0), pa.array(lengths, pa.int64()), maps, *part.columns[2:]]
                    yield pa.record_batch(columns, names=["doc_id", "dl", "terms", *keep])
                    first, lengths, ends, found, times = i, [], [0], [], []

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    schema = ", ".join([f"doc_id {kinds[0]}", "dl long", "terms map<string,int>", *(f"`{c}` {k}" for c, k in zip(keep, kinds[1:], strict=True))])
    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep).mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Runs of characters other than white space; the empty strings that ``split`` leaves at the edges are dropped."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
