"""Templates over streams: each micro-batch is expanded and its triples are appended as N-Triples or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..api import Mapping


def expand_stream(documents: list[str] | str, template: str, stream: DataFrame, path: str, checkpoint: str, **options) -> DataStreamWriter:
    """A writer (start it) that appends the triples of the stream's rows to the Parquet table ``path``. A batch that
    is run again overwrites what it had written."""

    def run(batch: DataFrame, number: int) -> None:
        mapping = Mapping(documents, spark=batch.sparkSession)
        mapping.expand(template, batch, validate=False, **options)
        mapping.triples().write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
