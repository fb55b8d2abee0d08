"""Micro-batches: every record is a whole document, so the batch pipeline runs on each batch, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.structure import parse_structure


def stream_nodes(documents: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Parses a streaming ``(doc_id, content)`` table; nodes go to ``out/batch=N`` as Parquet.

    A batch that is run again after a failure overwrites its own folder, so results come once.
    """

    def batch(df: DataFrame, number: int) -> None:
        parse_structure(df).nodes.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
