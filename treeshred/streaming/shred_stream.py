"""A stream of documents, shredded batch by batch: the windows over lexemes lie within a document, which arrives whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.shred import nodes


def shred_stream(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes the nodes of a stream of (doc_id, source) to a Parquet table in ``path``, a folder a batch, so that a batch
    done again replaces what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        nodes(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
