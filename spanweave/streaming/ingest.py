"""Documents that arrive as files, chunked as they come.  An extension: the operators need no state, so neither does the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.chunkers import chunk
from ..schema import Config


def stream_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, configs: list[Config], schema: str = "doc_id long, content string") -> StreamingQuery:
    """Parquet files that appear in ``source`` become chunk files in ``target``, a folder for each batch, so a repeated batch replaces itself."""
    arriving = spark.readStream.schema(schema).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        chunk(batch, configs).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
