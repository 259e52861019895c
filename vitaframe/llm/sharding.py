"""Karmarkar-Karp sharding: equal bytes per shard, with groups of equal texts kept whole.

Groups are summed by text digest (partial sums before the shuffle). Those above a small fraction of a
shard stay single items; the many others are summed into a fixed number of bundles by their digest. The
driver differences these at most ``BUNDLES + 40 * FINE`` items: the two partial partitions with the
largest spread are combined in opposite order until one is left.

Defined results: null text has size 16 and the checksum of no bytes, as an empty one; equal texts share
a shard (null counts as empty), whatever their ids; repeated rows each get a slot; an empty table gives
no rows; extra columns take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import prepare

SHARDS = 40
BUNDLES = 4096
#: Groups of at least total / (shards * FINE) bytes are items of their own, so there are no more than shards * FINE.
FINE = 256
OVERHEAD = 16


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, by the largest differencing method."""
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        sums = np.zeros(shards, "i8")
        sums[0] = size
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(shards - 1)]))  # sums fall from first to last
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sums, members = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        sums = sums + other[::-1]
        for mine, theirs in zip(members, reversed(others), strict=True):
            mine.extend(theirs)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        tick += 1
        heapq.heappush(heap, (-int(sums[0]), tick, sums, [members[k] for k in order]))
    out = [0] * len(sizes)
    for shard, members in enumerate(heap[0][3] if heap else []):
        for i in members:
            out[i] = shard
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("copy_of"))
    rows = rows.select("*", F.pmod(F.xxhash64("copy_of"), F.lit(BUNDLES)).cast("int").alias("bundle")).checkpoint()
    groups = rows.groupBy("copy_of", "bundle").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (shards * FINE))
    big = groups.where(F.col("bytes") >= least).checkpoint()
    small = groups.where(F.col("bytes") < least).groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
    items = [(None, r.bundle, r.bytes) for r in small.toLocalIterator()] + [(r.copy_of, None, r.bytes) for r in big.toLocalIterator()]
    items.sort(key=lambda x: (-x[2], x[0] or "", x[1] or 0))
    shard_of = difference([x[2] for x in items], shards)
    bundles = [0] * BUNDLES
    for (copy_of, bundle, _), shard in zip(items, shard_of, strict=True):
        if copy_of is None:
            bundles[bundle] = shard
    single = [(x[0], s) for x, s in zip(items, shard_of, strict=True) if x[0] is not None]
    single = spark.createDataFrame(single, "copy_of string, own int")  # at most shards * FINE rows
    of_bundle = spark.createDataFrame(list(enumerate(bundles)), "bundle int, shared int")  # BUNDLES rows
    placed = rows.join(F.broadcast(single), "copy_of", "left").join(F.broadcast(of_bundle), "bundle")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    placed = placed.checkpoint()  # rows keep their part and place from here on
    near = placed.withColumn("nth", F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")))
    sums = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("part", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    return near.join(starts, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    placed = assign(docs, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
