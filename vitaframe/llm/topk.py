"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt to cells by median splits of a bounded sample, and cells that turn out large are dealt on by a
hash, so a shard's vectors lie near each other and its box is tight. A shard's tree splits at the median of the
widest dimension and keeps tight boxes. For a query, boxes are visited best first by the largest inner product
that a point of the box could have, until that cannot beat the k-th score so far.

Queries are a table of blocks, one or more for each cell. Each block is first searched in the shard where its
queries lie. Then the shards' outermost boxes are held against the blocks, in ROUNDS rounds: a query goes on to a
shard only if the shard's box could reach its k-th score, and after each round the k-th scores found go on to the
next. The best k of a query then meet. A task holds one tree and one block; queries never pass the driver.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
queries meet vectors of their own dimension only; equal scores rank by smaller vec_id; a query finds
every row with another vec_id; rows with a null vec_id take no part; repeated query rows count once;
scores beyond 64 bits saturate, and then tie; a query without any row in its first shard has no k-th score yet.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import arrow_map, prepare

SCALE = 1024
LEAF = 256
SHARD_ROWS = 16_384
SHARD_BYTES = 32 << 20
QUERY_BLOCK = 4096
LIMIT = 2**63
#: Vectors and bytes of the sample that places the splits; cells that it is split to at most; shards that a cell may be dealt on to.
SAMPLE_ROWS, SAMPLE_BYTES, CELLS, DEALT = 32_768, 16 << 20, 2048, 1 << 20
#: Boxes that are held against a block at once, and rounds in which k-th scores go on.
BOXES, ROUNDS = 1024, 3


def integers(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) with components floor(1024 * x), of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fit = F.col(id_).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(fit).select(F.col(id_).cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x * SCALE)).alias("v"))


def _floor(x):
    """floor() as double; large values are whole already, and floor() of Spark would overflow on them."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


class Tree:
    """KD-tree over the rows of a matrix: boxes of all nodes, rows of leaves contiguous."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        self.low, self.high, self.child, self.rows = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            mine = points[order[a:b]]
            node = len(self.rows)
            self.low.append(mine.min(0))
            self.high.append(mine.max(0))
            self.child.append([-1, -1])
            self.rows.append((a, b))
            if parent >= 0:
                self.child[parent][side] = node
            wide = int(np.argmax(self.high[-1] - self.low[-1]))
            if b - a > leaf and self.high[-1][wide] > self.low[-1][wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, wide], middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.points = ids[order], points[order]

    def _limited(self, scores: np.ndarray) -> np.ndarray:
        """Within 64 bits; only unbounded integers can leave those."""
        return np.array([max(-LIMIT, min(LIMIT - 1, x)) for x in scores], object) if scores.dtype == object else scores

    def search(self, query_id: int, query: np.ndarray, best: list, k: int, least: int | None = None) -> None:
        """best: heap of (score, -vec_id), at most k. least: what a score must reach to be of use."""
        bound = self._limited(np.maximum(query * self.low, query * self.high).sum(1))
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if len(best) == k and -top < best[0][0] or least is not None and -top < least:
                return
            left, right = self.child[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            a, b = self.rows[node]
            scores = self._limited(self.points[a:b] @ query)
            fit = self.ids[a:b] != query_id
            if least is not None:
                fit &= scores >= least
            near = np.flatnonzero(fit if len(best) < k else fit & (scores >= best[0][0]))
            if len(near) > k:
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[:k]]
            for i in near.tolist():
                found = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def _matrix(points: list, largest: float) -> np.ndarray:
    """The cheapest exact form: doubles below 2^53, else 64-bit or unbounded integers."""
    if largest < 2.0**52:
        return np.array(points, "f8")
    exact = [[int(x) for x in row] for row in points]
    return np.array(exact, "i8" if largest < 2.0**62 else object)


def _vectors(table: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    column = table.column("v").combine_chunks()
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return table.column("vec_id").to_pylist(), [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def split_cells(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Median splits of a sample to so many cells: (dimension, value, node for up to the value, node for more); a leaf is (-1, 0, cell, 0)."""
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    todo, made = [(0, np.arange(len(points)))], 1
    while todo and made < cells:
        node, rows = todo.pop(0)
        spread = np.ptp(points[rows], axis=0) if len(rows) > 1 else np.zeros(1)
        wide = int(np.argmax(spread))
        if not spread[wide] > 0:
            continue
        value = np.partition(points[rows, wide], (len(rows) - 1) // 2)[(len(rows) - 1) // 2]
        more = points[rows, wide] > value
        if not more.any():  # over half lie at the highest value: split below it
            value = points[rows, wide][points[rows, wide] < value].max()
            more = points[rows, wide] > value
        nodes[node] = (wide, float(value), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), rows[~more]), (len(nodes) + 1, rows[more])]
        nodes += [(-1, 0.0, nodes[node][2], 0), (-1, 0.0, nodes[node][3], 0)]
        made += 1
    return nodes


def with_cells(vectors: DataFrame, splits: dict[int, list]) -> DataFrame:
    """vec_id, v, dim and the cell of each vector; dimensions that the sample lacks have one cell."""
    held = vectors.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {dim: [np.array(x) for x in zip(*nodes, strict=True)] for dim, nodes in held.value.items()}
        for batch in batches:
            ids, points = _vectors(pa.Table.from_batches([batch]))
            dims, cells = np.array([len(p) for p in points]), np.zeros(len(points), "i8")
            for dim in np.unique(dims).tolist():
                if dim in tables:
                    at = np.flatnonzero(dims == dim)
                    mine, node = np.array([points[k] for k in at]), np.zeros(len(at), "i8")
                    wide, value, less, more = tables[dim]
                    while (inner := np.flatnonzero(wide[node] >= 0)).size:
                        n = node[inner]
                        node[inner] = np.where(mine[inner, wide[n]] > value[n], more[n], less[n])
                    cells[at] = node
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "dim")), pa.array(cells)], ["vec_id", "v", "dim", "cell"])

    return arrow_map(vectors.select("vec_id", "v", "dim"), run, "vec_id long, v array<double>, dim int, cell long")


def dealt_on(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """The vectors with a number for each cell and at most about `rows` of its vectors."""
    parts = vectors.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).alias("parts")).where("parts > 1")  # cells, of which there are CELLS for a dimension
    many = vectors.join(F.broadcast(parts), ["dim", "cell"], "left")
    part = F.pmod(F.xxhash64("vec_id", F.col("v")), F.least(F.coalesce("parts", F.lit(1)), F.lit(DEALT)))
    return many.withColumn(name, F.col("cell") * DEALT + part).drop("parts", "cell")


def forest(vectors: DataFrame, largest: float) -> DataFrame:
    """(shard, dim, tree, box): a KD-tree for each shard and dimension, and the box around all of it. vectors: with a shard."""

    def build(key, table):
        ids, points = _vectors(table)
        tree = Tree(np.array(ids), _matrix(points, largest))
        box = np.concatenate((np.min(points, 0), np.max(points, 0)))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(vars(tree))], pa.binary()), "box": pa.array([box.tobytes()], pa.binary())})

    return vectors.groupBy("shard", "dim").applyInArrow(build, "shard long, dim int, tree binary, box binary").checkpoint()


def query_blocks(queries: DataFrame) -> DataFrame:
    """(block, dim, asked): QUERY_BLOCK queries of a cell or so in a row. queries: with a block."""

    def build(key, table):
        ids, points = _vectors(table.sort_by("vec_id"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "asked": pa.array([pickle.dumps((ids, points, list(range(len(ids)))))], pa.binary())})

    return queries.groupBy("block", "dim").applyInArrow(build, "block long, dim int, asked binary").checkpoint()


def searched(cells: DataFrame, largest: float, k: int) -> DataFrame:
    """Each cell's best rows. cells: block, dim, asked, least (k-th scores known so far, or null), tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                data = batch.column("tree")[n].as_py()
                if data != last:
                    last, tree = data, Tree.__new__(Tree)
                    vars(tree).update(pickle.loads(data))
                ids, points, numbers = pickle.loads(batch.column("asked")[n].as_py())
                least = batch.column("least")[n].as_py()
                asked = _matrix(points, largest)
                rows = []
                for q, nth, point, bound in zip(ids, numbers, asked, least or [None] * len(ids), strict=True):
                    best: list = []
                    tree.search(q, point, best, k, bound)
                    rows += [(q, nth, -v, s) for s, v in best]
                block, dim = batch.column("block")[n].as_py(), batch.column("dim")[n].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([dim] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], ["block", "dim", "query_id", "nth", "vec_id", "score"])

    return arrow_map(cells.select("block", "dim", "asked", "least", "tree"), run, "block long, dim int, query_id long, nth long, vec_id long, score long")


def grouped_boxes(trees: DataFrame) -> DataFrame:
    """(round, dim, boxes): the shards and their boxes, at most BOXES in a row."""

    def build(key, table):
        rows = table.num_rows
        out = [pickle.dumps((table.column("shard").to_pylist()[a : a + BOXES], [np.frombuffer(x, "f8") for x in table.column("box").to_pylist()[a : a + BOXES]])) for a in range(0, rows, BOXES)]
        return pa.table({"round": pa.array([key[0].as_py()] * len(out), pa.int32()), "dim": pa.array([key[1].as_py()] * len(out), pa.int32()), "boxes": pa.array(out, pa.binary())})

    groups = -(-trees.count() // (BOXES * ROUNDS))
    spread = F.pmod(F.xxhash64("shard"), F.lit(max(1, groups)))
    dealt = trees.select("shard", "dim", "box", F.pmod("shard", F.lit(ROUNDS)).cast("int").alias("round"), spread.alias("spread"))
    return dealt.groupBy("round", "dim", "spread").applyInArrow(lambda key, table: build(key[:2], table), "round int, dim int, boxes binary").checkpoint()


def reaching(blocks: DataFrame, boxes: DataFrame, largest: float) -> DataFrame:
    """(shard, block, dim, asked, least): of each block the queries whose k-th score a shard's box could reach. blocks: with kth, scores by query's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block, dim, home = (batch.column(c)[n].as_py() for c in ("block", "dim", "home"))
                ids, points, numbers = pickle.loads(batch.column("asked")[n].as_py())
                known = dict(batch.column("kth")[n].as_py() or ())
                least = [known.get(k, -LIMIT) for k in numbers]
                shards, corners = pickle.loads(batch.column("boxes")[n].as_py())
                low, high = (_matrix([c[a : a + dim] for c in corners], largest) for a in (0, dim))
                asked = _matrix(points, largest)
                bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
                rows = []
                for s, shard in enumerate(shards):
                    if shard != home:
                        go = [k for k, (x, y) in enumerate(zip(bounds[:, s].tolist(), least, strict=True)) if min(x, LIMIT - 1) >= y]
                        if go:
                            rows.append((shard, block, dim, pickle.dumps(([ids[k] for k in go], [points[k] for k in go], [numbers[k] for k in go])), [least[k] for k in go]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["shard", "block", "dim", "asked", "least"])

    return arrow_map(blocks.join(boxes, "dim").select("block", "dim", "home", "asked", "kth", "boxes"), run, "shard long, block long, dim int, asked binary, least array<long>")


def splits_of(vectors: DataFrame, cells: int, dim: int) -> dict[int, list]:
    """The splits of each dimension, from a sample of the vectors."""
    rows = min(SAMPLE_ROWS, max(2, SAMPLE_BYTES // (8 * max(dim, 1))))
    chosen = vectors.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toLocalIterator()
    by_dim: dict[int, list] = {}
    for row in chosen:
        by_dim.setdefault(row.dim, []).append(row.v)
    return {d: split_cells(np.array(v, "f8"), min(cells, CELLS, max(1, len(v) // 8))) for d, v in by_dim.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of integers() frames."""
    spark = vectors.sparkSession
    prepare(spark)
    vectors, queries = (x.withColumn("dim", F.size("v")) for x in (vectors, queries.distinct()))
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most"), F.max("dim").alias("dim")).first()
    largest = (facts.most or 0.0) ** 2 * (facts.dim or 1)
    rows = max(LEAF, min(SHARD_ROWS, SHARD_BYTES // (8 * max(facts.dim or 1, 1))))
    shards = -(-facts.n // rows)
    splits = splits_of(vectors, shards, facts.dim) if shards > 1 else {}
    trees = forest(dealt_on(with_cells(vectors, splits), rows, "shard"), largest)
    blocks = query_blocks(dealt_on(with_cells(queries, splits), QUERY_BLOCK, "block"))
    # The shard where its queries lie gives a block's queries their first k-th scores.
    blocks = blocks.withColumn("home", F.floor(F.col("block") / DEALT) * DEALT)
    order = Window.partitionBy("block", "dim", "nth").orderBy(F.desc("score"), "vec_id")
    found = searched(blocks.withColumn("least", F.lit(None).cast("array<long>")).withColumnRenamed("home", "shard").join(trees, ["shard", "dim"]), largest, k).checkpoint()
    boxes = grouped_boxes(trees) if shards > 1 else None
    for nth in range(ROUNDS) if boxes is not None else ():
        kth = found.groupBy("block", "dim", "nth").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        kth = kth.groupBy("block", "dim").agg(F.map_from_entries(F.collect_list(F.struct("nth", "least"))).alias("kth"))  # a block's queries
        wanted = reaching(blocks.join(kth, ["block", "dim"], "left"), boxes.where(F.col("round") == nth), largest)
        more = found.unionByName(searched(wanted.join(trees, ["shard", "dim"]), largest, k))
        found = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank").checkpoint()
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def report(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    vectors = integers(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
