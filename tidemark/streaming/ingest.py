"""Structured Streaming into a store: each micro-batch is one atomic commit, and a replayed one does nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, name: str, order: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that commits every micro-batch of ``stream`` (t, the store's columns and those of ``order``).

    The store remembers the last batch number of each stream ``name`` in the same commit as the rows, so a batch that is run
    again after a failure is skipped whole.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.write_frame(batch, order, (name, number))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
