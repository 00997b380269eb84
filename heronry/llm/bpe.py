"""Byte-level BPE with a local rank file and the tiktoken library.

Ranks are read from a file whose path is a parameter; nothing is trained or
fetched. Long texts are encoded in pieces that end where the splitting pattern
always ends a match: between a letter or digit and following white space. Very
long runs of white space, which would exhaust the pattern engine's stack, are
one match each by the pattern's own rule and go to the merges directly. Ids are
therefore those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.scratch import text_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters after which a long text is split at the next safe boundary.
PIECE_CHARS = 1 << 16
#: A boundary that no match of the splitting pattern spans: after a letter or digit none goes on over white space.
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \t\r\n])")
#: Runs of white space, as the pattern engine defines it, that are not given to it.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{8192,}")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[str]]:
    """The encoding of a rank file, and the decimal form of every id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return made, [str(i) for i in range(max(ranks.values()) + 1)]


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in consecutive pieces of ``chars`` or more characters that end at safe boundaries."""
    start = 0
    while len(text) - start > chars:
        found = _SAFE.search(text, start + chars)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _encode_spaced(made: tiktoken.Encoding, text: str, chars: int) -> list[int]:
    """The ids of ``text``, whose long runs of white space are merged without the pattern.

    The pattern takes a run as one match, but for its last character if text
    follows; before a run it always ends a match.
    """
    ids: list[int] = []
    start = 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        for piece in pieces(text[start : run.start()], chars):
            ids.extend(made.encode_ordinary(piece))
        ids.extend(made._core_bpe.encode_single_piece(text[run.start() : stop].encode()))
        start = stop
    for piece in pieces(text[start:], chars):
        ids.extend(made.encode_ordinary(piece))
    return ids


def encode(text: str, path: str, pattern: str = public_tokenizers.PATTERN, chars: int = PIECE_CHARS) -> list[int]:
    """The ids of a whole text, without special tokens; texts are split only for the pattern that the boundaries are made for."""
    made, _ = encoding(path, pattern)
    if len(text) <= min(chars, 8192) or pattern != public_tokenizers.PATTERN:
        return made.encode_ordinary(text)
    return _encode_spaced(made, text, chars)


def decode(ids: list[int], path: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """The raw bytes that ``ids`` stand for; they need not be valid UTF-8."""
    return encoding(path, pattern)[0].decode_bytes(ids)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows ``(doc_id, ids array<int>, decoded binary)`` for every row of ``docs``.

    A null text is an empty one: no ids, no bytes. Repeated rows and null ids
    give rows of their own; other columns are not read. Without ``path`` each
    worker takes the installed rank file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path or public_tokenizers.path(RANKS)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [encode(t or "", at, pattern) for t in part.column(1).to_pylist()]
                decoded = [decode(x, at, pattern) for x in ids]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary"
    )


def detokenize(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows ``(doc_id, decoded binary)`` for the ids in ``tokens``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path or public_tokenizers.path(RANKS)
        for b in batches:
            decoded = [decode(x or [], at, pattern) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return text_batches(tokens).select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, f"doc_id {tokens.schema[id_col].dataType.simpleString()}, decoded binary"
    )


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row of ``docs``.

    As ``tokenize``, but the ids and bytes of a document are hashed where they
    are made, so that the bytes, and without ``with_ids`` the ids, don't leave
    the worker. The hashes are of the decimal ids joined by commas and of the
    decoded bytes, in lower-case hex.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = path or public_tokenizers.path(RANKS)
        made, decimal = encoding(at, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, n, left, right, kept = b.slice(i, 512), [], [], [], []
                for cell in part.column(1):
                    ids = encode(cell.as_py() or "", at, pattern)
                    n.append(len(ids))
                    left.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                    right.append(hashlib.sha256(made.decode_bytes(ids)).hexdigest())
                    if with_ids:
                        kept.append(ids)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
