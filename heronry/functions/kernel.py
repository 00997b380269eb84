"""MaxSim over packed token vectors, in NumPy, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BATCH_TOKENS = 32 * 1024


def batches(lengths: np.ndarray, max_tokens: int, max_documents: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents with ``max_tokens`` tokens at most; a longer document is alone."""
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (total + n > max_tokens or (max_documents and i - start >= max_documents)):
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def maxsim(query: np.ndarray, documents: np.ndarray, lengths: np.ndarray, max_tokens: int = BATCH_TOKENS) -> np.ndarray:
    """For each document the sum over query tokens of the best product with one of its tokens."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty(len(lengths), np.float32)
    for s, e in batches(lengths, max_tokens):
        products = documents[offsets[s] : offsets[e]] @ query.T
        out[s:e] = np.maximum.reduceat(products, offsets[s:e] - offsets[s], axis=0).sum(axis=1, dtype=np.float32)
    return out


def check_packed(documents: np.ndarray, lengths: np.ndarray, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed documents as a float32 matrix and int64 lengths, or a ValueError."""
    documents, lengths = np.ascontiguousarray(documents, np.float32), np.asarray(lengths)
    if documents.ndim != 2 or not documents.shape[1]:
        raise ValueError("packed documents must be a [tokens, dimension] matrix")
    if dimension is not None and documents.shape[1] != dimension:
        raise ValueError(f"packed documents have dimension {documents.shape[1]}, not {dimension}")
    if lengths.ndim != 1 or (len(lengths) and not np.issubdtype(lengths.dtype, np.integer)):
        raise ValueError("document lengths must be a vector of integers")
    if (lengths <= 0).any():
        raise ValueError("document lengths must be positive")
    if int(lengths.sum()) != len(documents):
        raise ValueError(f"document lengths sum to {int(lengths.sum())}, but there are {len(documents)} tokens")
    return documents, lengths.astype(np.int64)


def check_query(query: object, dimension: int | None = None) -> np.ndarray:
    """A query's token matrix as finite float32, or a ValueError."""
    matrix = np.ascontiguousarray(query, np.float32)
    if matrix.ndim != 2 or not matrix.shape[0] or not matrix.shape[1]:
        raise ValueError("query vectors must be a [tokens, dimension] matrix with both above zero")
    if dimension is not None and matrix.shape[1] != dimension:
        raise ValueError(f"query vectors have dimension {matrix.shape[1]}, not {dimension}")
    if not np.isfinite(matrix).all():
        raise ValueError("query vectors must be finite")
    return matrix


def maxsim_scores_packed(query: np.ndarray, documents: np.ndarray, document_lengths: np.ndarray | Sequence[int], *, max_batch_tokens: int | None = None, threads: int | None = None) -> np.ndarray:
    """Float32 MaxSim scores of packed documents; the result doesn't depend on the batch bound.

    ``threads`` is checked only: tasks are what runs in parallel under Spark.
    """
    for name, value in (("max_batch_tokens", max_batch_tokens), ("threads", threads)):
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")
    matrix = check_query(query)
    packed, lengths = check_packed(documents, document_lengths, matrix.shape[1])
    return maxsim(matrix, packed, lengths, max_batch_tokens or BATCH_TOKENS)
