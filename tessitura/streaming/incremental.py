"""Incremental assembly of training sequences: new shards in a folder become new rows once.

The checkpoint takes the place of a list of finished shards; the transformation is the batch one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_folder(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Processes all files that are not yet done, in batches, and stops."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
