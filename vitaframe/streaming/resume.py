"""Resumable runs: what is done is left out, new results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(tasks: DataFrame, done: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Finished rows and those that `work` makes of the pending tasks."""
    return done.unionByName(work(pending(tasks, done, keys)), allowMissingColumns=True)


def stream_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Works through the files that came since the last run and stops; the checkpoint makes each count once."""
    frame = spark.readStream.schema(schema).parquet(source)
    return work(frame).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
