"""Continuous ingestion: each micro-batch of a stream of documents is one commit of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corvex.index import SearchIndex


def ingest(stream: DataFrame, index: SearchIndex, checkpoint: str, *, removed: str | None = None, **trigger) -> StreamingQuery:
    """Starts a query that upserts the stream's documents, and removes those whose ``removed`` column is true.

    A batch that is run again after a failure upserts the same keys again, so the result is as if it ran once.
    """

    def commit(batch: DataFrame, _: int) -> None:
        if removed is None:
            index.add_table(batch)
            return
        batch.persist()
        index.remove_table(batch.filter(removed), index.config.key)
        index.add_table(batch.filter(f"not coalesce({removed}, false)"))
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
