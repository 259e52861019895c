"""Word splitting, hashing and session helpers shared by the corpus operators.

Words are found on UTF-8 bytes: every byte from 0x80 up belongs to a character outside ASCII, so the
ASCII classes that the operators name can be decided byte by byte.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; digits, letters and bytes of other characters stay; all else becomes a space.
ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Rows in an Arrow batch, so that a batch of long texts fits a Python worker.
BATCH_ROWS = 500
MAX_ID = 2**63 - 1
#: Stands for null among ids that are ordered as strings.
LAST_ID = "\U0010ffff" * 8
HOT_PARTS = 2048


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes (for the session, as plans run later), and sets a checkpoint folder.

    That is the one which the cluster names in spark.checkpoint.dir. Where it names none, a local session
    takes a temporary folder, any other one a folder in the warehouse, which all machines see.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not named and re.match(r"local(\[|$)", spark.sparkContext.master):
            named = tempfile.mkdtemp(prefix="vitaframe-checkpoint-")
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    prepare(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own that no later step reads, in any file system that Spark has."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_kind(frame: DataFrame, name: str = "doc_id") -> str:
    """How ids are ordered: whole numbers as such, all others as strings."""
    return "long" if frame.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def known_id(frame: DataFrame, name: str = "doc_id") -> Column:
    """The id, with null as the largest one."""
    kind = id_kind(frame, name)
    return F.coalesce(F.col(name).cast(kind), F.lit(MAX_ID if kind == "long" else LAST_ID))


def spread_join(many: DataFrame, few: DataFrame, on: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with few, in which each key stands once. counts: the keys and their rows in many, as `times`.

    A key with more than 1 / HOT_PARTS of the rows is split into parts of about that size, and its row in few
    repeated for each part. There are at most HOT_PARTS such keys, so their list is small enough to broadcast.
    """
    total = counts.agg(F.sum("times")).first()[0] or 0
    hot = counts.where(F.col("times") * HOT_PARTS > total).select(*on, F.ceil(F.col("times") * HOT_PARTS / F.lit(max(total, 1))).cast("long").alias("hot_parts")).checkpoint()
    parts = F.coalesce("hot_parts", F.lit(1).cast("long"))
    many = many.join(F.broadcast(hot), on, "left").withColumn("hot_part", F.pmod(F.monotonically_increasing_id(), parts)).drop("hot_parts")
    few = few.join(F.broadcast(hot), on, "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("hot_parts")
    return many.join(few, [*on, "hot_part"], how).drop("hot_part")


#: Packs that one task merges.
MERGED = 64


def merged_in_tree(packs: DataFrame, keys: list[str], parts: int, merge, schema: str) -> DataFrame:
    """Packs of one key merged MERGED at a time, so that no task holds more however many tasks have packed.

    packs: with a column `part` below `parts`; merge: of a group's key (keys, then part) and table, one row with the same columns.
    """
    while parts > 1:
        packs = packs.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")).groupBy(*keys, "part").applyInArrow(merge, schema)
        parts = -(-parts // MERGED)
    return packs


def plain_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """The same after lower-casing A-Z."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return text.translate(ALNUM).split()


def byte_rows(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes for each word, shape (n, 2)."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of words at once: prefix sums of word hash times a power of an odd base, modulo 2^64."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self) -> None:
        self.up = [np.ones(1, "u8"), np.ones(1, "u8")]
        self.down = [np.ones(1, "u8"), np.ones(1, "u8")]

    def _grow(self, n: int) -> None:
        if len(self.up[0]) < n:
            for k, base in enumerate(self.BASES):
                for powers, factor in ((self.up, base), (self.down, pow(base, -1, 2**64))):
                    steps = np.full(n, factor, "u8")
                    steps[0] = 1
                    powers[k] = np.multiply.accumulate(steps)

    def prefix(self, hashes: np.ndarray, k: int) -> np.ndarray:
        n = len(hashes)
        self._grow(n + 1)
        out = np.zeros(n + 1, "u8")
        np.cumsum(hashes[:, k] * self.up[k][:n], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int, k: int) -> np.ndarray:
        """Hash of the words start .. start+length-1; the same wherever they stand."""
        return (prefix[start + length] - prefix[start]) * self.down[k][start]


def arrow_type(kind: str) -> pa.DataType:
    """The Arrow type of a column of ids, by its name in Spark."""
    if found := re.fullmatch(r"decimal\((\d+),(\d+)\)", kind):
        return pa.decimal128(int(found[1]), int(found[2]))
    plain = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "binary": pa.binary()}
    return plain.get(kind, pa.string())


def arrow_map(frame: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over batches that have rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(b for b in batches if b.num_rows)

    return frame.mapInArrow(run, schema)


def quoted(frame: DataFrame) -> str:
    """The frame's schema as DDL."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema)


def free_name(frame: DataFrame, wish: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def replace_text(batch: pa.RecordBatch, texts: list[bytes | None], keep: list[bool]) -> pa.RecordBatch:
    """The batch with other texts (and n_chars, if it has that), without rows that are not kept."""
    columns = []
    for field, column in zip(batch.schema, batch.columns, strict=True):
        if field.name == "text":
            column = pa.array(texts, pa.binary()).cast(field.type)
        elif field.name == "n_chars":
            column = pa.array([None if t is None else len(t.decode("utf-8", "replace")) for t in texts], pa.int64()).cast(field.type)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))
