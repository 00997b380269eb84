"""MaxSim scores of stored documents for one or many queries.

Two plans with one contract. The relational one explodes tokens and
aggregates in double precision: inspectable, and equal to SQL. The Arrow one
multiplies matrices in batches inside tasks: documents are not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.kernel import batches
from heronry.functions.vectors import dot
from heronry.model import ResourceBudget

#: Query tokens that are sent to every task, at most, by size in bytes.
QUERY_BYTES = 256 << 20
#: Query tokens that a relational plan broadcasts, at most.
QUERY_TOKENS = 100_000


def maxsim_relational(tokens: DataFrame, queries: DataFrame, doc: Sequence[str] = ("doc_id",), score: str = "score") -> DataFrame:
    """Rows ``(query_id, *doc, score)`` from ``tokens(*doc, vector)`` and ``queries(query_id, pos, vector)``.

    The queries are broadcast once their number is checked; each pair of a query token and a
    document has its best product kept, and these are summed by document.
    """
    asked = queries.select("query_id", F.col("pos").alias("__pos"), F.col("vector").alias("__q"))
    if asked.limit(QUERY_TOKENS + 1).count() > QUERY_TOKENS:
        raise ValueError("the queries are too many to send to every task; search in smaller groups")
    pairs = tokens.select(*doc, "vector").crossJoin(F.broadcast(asked))
    best = pairs.groupBy("query_id", "__pos", *doc).agg(F.max(dot(F.col("vector"), F.col("__q"))).alias("best"))
    return best.groupBy("query_id", *doc).agg(F.sum("best").alias(score))


def maxsim_arrow(documents: DataFrame, queries: Sequence[tuple[object, np.ndarray]], doc: Sequence[str] = ("doc_id",), budget: ResourceBudget | None = None, encoding: str = "float32", normalized: bool = True, query_type: str = "string") -> DataFrame:
    """Rows ``(query_id, *doc, score float)`` for all ``documents`` and queries.

    ``documents`` has the columns ``doc``, ``token_count`` and ``vectors``, a
    flat array, or for int8 ``codes`` and ``scales``. Documents are scored
    in batches of the budget's size, shortest first within an Arrow batch; int8
    tokens are decoded only there.
    """
    budget = budget or ResourceBudget()
    matrices = [(q, np.ascontiguousarray(m, np.float32)) for q, m in queries]
    if sum(m.nbytes for _, m in matrices) > QUERY_BYTES:
        raise ValueError("the queries are too large to send to every task; search in smaller groups")
    own = [documents.schema[c].dataType.simpleString() for c in doc]
    values = ["codes", "scales"] if encoding == "int8" else ["vectors"]
    dims = {m.shape[1] for _, m in matrices}
    if len(dims) > 1:
        raise ValueError("all queries must have one dimension")
    dim = dims.pop() if dims else 1
    stacked = np.concatenate([m for _, m in matrices]) if matrices else np.zeros((0, dim), np.float32)
    ends = np.cumsum([0, *(len(m) for _, m in matrices)])
    max_tokens, max_documents = budget.max_batch_tokens, budget.max_documents_per_batch

    def decode(part: pa.RecordBatch) -> np.ndarray:
        if encoding == "int8":
            codes = part.column("codes").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            out = codes * part.column("scales").flatten().to_numpy(zero_copy_only=False).astype(np.float32)[:, None]
            if normalized:
                out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-12))
            return out
        return part.column("vectors").flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            lengths = b.column("token_count").to_numpy(zero_copy_only=False)
            order = np.argsort(lengths, kind="stable")
            for s, e in batches(lengths[order], max_tokens, max_documents):
                part = b.take(pa.array(order[s:e]))
                n = lengths[order[s:e]]
                products = decode(part) @ stacked.T
                best = np.maximum.reduceat(products, np.cumsum(np.concatenate(([0], n[:-1]))), axis=0)
                for i, (q, _) in enumerate(matrices):
                    score = best[:, ends[i] : ends[i + 1]].sum(axis=1, dtype=np.float32)
                    yield pa.record_batch([pa.array([q] * len(n)), *(part.column(c) for c in doc), pa.array(score)], names=["query_id", *doc, "score"])

    rows = documents.select(*doc, "token_count", *values)
    if budget.threads:
        rows = rows.coalesce(budget.threads)
    schema = ", ".join([f"query_id {query_type}", *(f"`{c}` {t}" for c, t in zip(doc, own, strict=True)), "score float"])
    return rows.mapInArrow(run, schema)
