"""Results kept by key: what a run has finished is never worked on again, however it ended."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitaframe.streaming.resume import pending


class KeyedStore:
    """A folder of result parts. A part counts once its writer has committed it, so a killed write leaves nothing behind that is read."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def parts(self) -> list[str]:
        """The committed parts, in any file system that Spark has."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "part-*/_SUCCESS")) if files.exists(folder) else None
        return sorted(str(x.getPath().getParent()) for x in found or ())

    def done(self) -> DataFrame:
        """All finished rows."""
        parts = self.parts()
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def pending(self, tasks: DataFrame) -> DataFrame:
        """The tasks without a result, each key once."""
        return pending(tasks.dropDuplicates(self.keys), self.done(), self.keys)

    def add(self, results: DataFrame) -> None:
        """Writes the results as one more part, in whole or not at all."""
        results.write.parquet(f"{self.path}/part-{uuid.uuid4().hex}")


def run_in_steps(tasks: DataFrame, store: KeyedStore, work: Callable[[DataFrame], DataFrame], step_rows: int = 10_000, cut_by: list[str] | None = None, unfinished: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The results of all tasks. What the store lacks is worked on in steps of about step_rows, each kept as soon as it is done.

    After a kill only the step that ran is repeated. Steps are cut by a hash of the keys, so they are the same size at any order of the rows.
    Steps share no key, so each meets only its own part of what was done before the run, not what the steps before it have added.
    cut_by: keys that are enough to cut by. unfinished: of a part of the rows in tasks and the finished rows, the tasks without a result, each key once.
    """
    before, cut_by = store.done(), cut_by or store.keys
    unfinished = unfinished or (lambda part, done: pending(part.dropDuplicates(store.keys), done, store.keys))
    alike = all(tasks.schema[k].dataType == before.schema[k].dataType for k in cut_by)  # else equal keys may have other hashes
    steps = -(-unfinished(tasks, before).count() // step_rows)
    for k in range(steps):
        own = F.pmod(F.xxhash64(*cut_by), F.lit(steps)) == k
        store.add(work(unfinished(tasks.where(own), before.where(own) if alike else before)))
    return store.done()


def stream_into(source: DataFrame, store: KeyedStore, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Works through what a stream has now, micro-batch by micro-batch, and keeps each batch's results by key.

    A batch that is run again, because its run was killed before or after its results were kept, works on the keys
    that have none, so no key has two results. How much a kill can cost is set by the size of the source's batches.
    """

    def each(batch: DataFrame, number: int) -> None:
        todo = store.pending(batch)
        if not todo.isEmpty():
            store.add(work(todo))

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
