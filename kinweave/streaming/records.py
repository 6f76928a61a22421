"""Linking records as they arrive. Batches of a stream meet a static index of references; this goes beyond batch use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import records, retrieval


def link_stream(arriving: DataFrame, references: DataFrame, output: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Writes each micro-batch's candidate pairs to output/batch=N; a batch that is repeated after a failure replaces its own."""

    def link(batch: DataFrame, number: int) -> None:
        prepared = records.prepare(batch)
        pairs = retrieval.union_modes(retrieval.scores(prepared, references), k)
        pairs.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return arriving.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).start()
