"""Resumable work over files as they come: a file stream with an upsert per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import upsert


def absorb(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, keys: list[str], order: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Reads the new Parquet files of folder once and upserts them, changed, into the table at target (versions v=0, v=1, ...)."""

    def batch(new: DataFrame, number: int) -> None:
        new, path = change(new), f"{target}/v={number}"
        old = spark.read.schema(new.schema).parquet(f"{target}/v={number - 1}") if number else new.limit(0)
        upsert(old, new, keys, order).write.mode("overwrite").parquet(path)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
