"""A fitted stage applied to a stream: a stream-static join or plain projections."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_entries(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Entries that arrive as Parquet files in a folder (or match a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_to_stream(stream: DataFrame, fitted: Transformer, path: str, checkpoint: str) -> StreamingQuery:
    """Transform what is available now and append it to a Parquet table.

    The table and the offsets in ``checkpoint`` belong together: a restarted
    query goes on where the last one stopped and writes nothing twice.
    """
    return (
        fitted.transform(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
