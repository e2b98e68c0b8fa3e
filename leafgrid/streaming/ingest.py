"""Streams into stores that never hold a key twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from leafgrid.sources.store import append_new


def ingest(stream: DataFrame, path: str, checkpoint: str, *keys: str, by: str | None = None) -> DataStreamWriter:
    """Writes each micro-batch's new keys to the store at ``path``; ``start()`` it.

    A batch that is run again after a failure adds nothing, for its keys are there by then.
    """
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch.dropDuplicates(list(keys)), path, *keys, by=by)).option("checkpointLocation", checkpoint)
