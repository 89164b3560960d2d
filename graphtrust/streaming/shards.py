"""Shard folders as streams: files that come later are taken by later runs, and a run that breaks off is gone on with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_shards(spark: SparkSession, folder: str, schema: T.StructType | str, files: int = 64, pattern: str = "part_*.parquet") -> DataFrame:
    """The folder's Parquet shards as a stream, at most `files` in a micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def process_shards(spark: SparkSession, folder: str, schema: T.StructType | str, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 64, follow: str | None = None) -> StreamingQuery:
    """Append fn of every shard that no earlier run took to the Parquet folder `out`, each row exactly once.

    The checkpoint (a folder in shared storage) holds which shards are done. All shards there now are processed and the
    query ends; with follow, such as "1 minute", it goes on looking for new ones. fn must work row by row or with a watermark.
    """
    writer = fn(read_shards(spark, folder, schema, files)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=follow) if follow else writer.trigger(availableNow=True)).start(out)
