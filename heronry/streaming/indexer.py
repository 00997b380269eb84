"""A streaming query that keeps a vector store current.

Each micro-batch is one commit: rows with vectors replace documents, rows
without delete them. Where a batch has several rows of a document, the one
that is last by ``order_col`` decides; without that column they are an error,
as a batch has no order of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from heronry.operators.presence import repeated
from heronry.sources.store import VectorStoreWriter


def apply_changes(writer: VectorStoreWriter, changes: DataFrame, order_col: str | None = None) -> None:
    """Commit ``changes(doc_id, token_count, vectors)``; null vectors delete. An empty batch only renews the time."""
    order = F.col(order_col) if order_col else F.lit(0)
    if not order_col and (again := repeated(changes, [F.col("doc_id")], F.lit(0)).first()):
        raise ValueError(f"document {again[0]!r} is changed {again[1]} times in a batch; name the column that orders changes")
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct("token_count", "vectors"), order).alias("x")).select("doc_id", "x.*").persist()
    try:
        writer.delete_frame(last.where("vectors is null").select("doc_id"))
        writer.append_frame(last.where("vectors is not null"))
        writer.commit()
    finally:
        last.unpersist()


def follow(changes: DataFrame, writer: VectorStoreWriter, checkpoint: str, order_col: str | None = None, **trigger) -> StreamingQuery:
    """Start applying a streaming DataFrame; a batch that is run again gives the same documents."""
    stream = changes.writeStream.foreachBatch(lambda batch, _: apply_changes(writer, batch, order_col)).option("checkpointLocation", checkpoint)
    return stream.trigger(**trigger).start() if trigger else stream.start()
