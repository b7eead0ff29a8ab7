"""Incremental indexing of a stream: only ids that the manifest has not."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvine.operators import manifest


def index_stream(docs: DataFrame, manifest_path: str, checkpoint: str, key: str = "doc_id"):
    """Starts a query that appends new (key, content_hash) to the manifest; one writer at a time."""
    return docs.writeStream.foreachBatch(lambda batch, _: manifest.append(batch, manifest_path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
