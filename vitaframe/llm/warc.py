"""WARC archives: records written by Spark's own text writer, read back by boundary-chain verification.

A record ends with CRLF CRLF, which is the line separator the text writer is given, so archives are
written by the JVM to any store Spark knows. Of equal payloads of at least MIN_DUPLICATE bytes only one
is stored; the others become revisit records that name it.

Reading trusts no magic by itself. Tasks read byte ranges, as Spark splits the files where CRLF CRLF and a
magic follow each other, and emit a candidate (offset, successor) for every such place where a record
header parses; the successor is where its declared length ends. Offsets become those in the file by the lengths of the
ranges before. Pointer jumping from offset 0 then marks the candidates that the chain of records reaches.
A header quoted inside a payload is a candidate that nothing reaches. Records within a range are digested
as they are read; those that end in a later one are put together afterwards.

Defined results: null html is an empty payload; of rows that share the largest page_id and the payload
each is a response; a null page_id counts as smaller than any other and never makes another row a
revisit of it unless all ids are null; line breaks in a url are percent-encoded; extra columns take no
part; no rows, no archives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaframe.llm.common import arrow_map, prepare, shared_path, spread_join

MIN_DUPLICATE = 1000
MAGIC, END = b"WARC/1.0", b"\r\n\r\n"
#: What stands before every record but a file's first. No beginning of it is also its end, so that all tasks find the same ones.
SEPARATOR = END + MAGIC
#: Digests of repeated payloads that may be broadcast; with more of them the join shuffles.
BROADCAST_ROWS = 100_000
#: An archive takes so many records at most.
ARCHIVE_RECORDS = 4000
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    prepare(pages.sparkSession)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    large = F.col("payload_bytes") >= MIN_DUPLICATE
    kept = rows.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("times")).where("times > 1").checkpoint()
    on = ["payload_digest", "payload_bytes"]
    if kept.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(kept.drop("times")), on, "left")
    else:
        rows = spread_join(rows, kept.drop("times"), on, kept.drop("winner"), "left")
    revisit = F.col("winner").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("winner")))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to"))


def records(rows: DataFrame) -> DataFrame:
    """One text per record, without the CRLF CRLF that ends it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), text("payload_bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    profile = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: <urn:page:"), text("page_id"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\n"), F.when(is_revisit, profile).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes the pages' records below path, in the files' own partitioning."""
    records(classify(pages)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def reachable(offsets: np.ndarray, successors: np.ndarray, first: int = 0) -> np.ndarray:
    """Which candidates the chain from `first` reaches, by pointer jumping: each round doubles the steps taken."""
    n = len(offsets)
    order = np.argsort(offsets, kind="stable")
    place = np.minimum(np.searchsorted(offsets[order], successors), max(n - 1, 0))
    jump = np.append(np.where(offsets[order][place] == successors, order[place], n), n) if n else np.array([0])  # n: no record there
    marked = np.append(offsets == first, False)
    while True:
        new = marked.copy()
        new[jump[marked]] = True
        new[n] = False
        jump = jump[jump]
        if (new == marked).all() and (jump == n).all():
            return marked[:n]
        marked = new


def fields(head: bytes, block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    field = {m[1].lower(): m[2] for m in _FIELD.finditer(head)}
    body = block.find(END) + len(END)
    kind = field.get(b"warc-type", b"").decode()
    if kind == "revisit":
        declared = _LENGTH.search(block, 0, body)
        size, digest = int(declared[1]) if declared else None, field.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    else:
        size, digest = len(block) - body, hashlib.sha1(memoryview(block)[body:]).hexdigest()
    name_of = lambda key: field.get(key, b"").decode().removeprefix("<urn:page:").removesuffix(">") or None
    return name_of(b"warc-record-id"), size, digest, kind, name_of(b"warc-refers-to")


class Range:
    """The candidates of one byte range, whose segments come in order. Offsets count from its first segment."""

    def __init__(self, first: bool) -> None:
        self.first = first  # of its file: nothing stands before the first segment
        self.past = 0
        self.open: list[tuple[int, bytes, int, int]] = []  # offset, header, start of the block, successor
        self.held: list[tuple[int, bytes]] = []  # segments that open candidates need
        self.rows: list[tuple] = []

    def add(self, segment: bytes) -> None:
        start, whole = self.past, segment + SEPARATOR
        self.past += len(whole)
        if self.open:
            self.held.append((start, whole))
            self._close()
        if self.first and not start:
            offset, head = 0, segment if segment.startswith(MAGIC) else b""
        else:
            offset, head = start - len(MAGIC), MAGIC + segment
        end = head.find(END)
        past = offset + (end if end >= 0 else len(head)) + len(END)  # a block may begin with a magic itself
        head = head[:end] if end >= 0 else head
        length = _LENGTH.search(head + b"\r\n")
        if length:
            successor = past + int(length[1]) + len(END)
            if successor <= self.past:
                self._emit(offset, head, whole[past - start : successor - start], successor)
            else:
                self.open.append((offset, head, past, successor))
                if not self.held:
                    self.held.append((start, whole))

    def _emit(self, offset: int, head: bytes, block: bytes, successor: int) -> None:
        if block.endswith(END):
            self.rows.append((offset, successor, *fields(head, block[: -len(END)])))

    def _close(self) -> None:
        done = [x for x in self.open if x[3] <= self.past]
        for offset, head, start, successor in done:
            self._emit(offset, head, b"".join(x[max(start - a, 0) : successor - a] for a, x in self.held if start < a + len(x) and a < successor), successor)
        if done:
            self.open = [x for x in self.open if x[3] > self.past]
            first = min((x[2] for x in self.open), default=self.past)
            self.held = [x for x in self.held if x[0] + len(x[1]) > first]

    def results(self) -> list[tuple]:
        """Rows of the candidates; those that end in a later range have no fields."""
        return self.rows + [(offset, successor, None, None, None, None, None) for offset, _, _, successor in self.open]


_FIELDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between SEPARATORs, in order within a byte range of a file: (archive, range, value)."""
    lines = spark.read.option("lineSep", SEPARATOR.decode()).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))


def candidates(lines: DataFrame) -> DataFrame:
    """For each byte range its length (offset null), and its candidate records with their successors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, Range(False)
        for batch in batches:
            for name, start, value in zip(batch.column("archive").to_pylist(), batch.column("range").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if key is not None and key != (name, start):
                    yield rows_of(key, now)
                    key = None
                if key is None:
                    key, now = (name, start), Range(start == 0)
                now.add(value)
        if key is not None:
            yield rows_of(key, now)

    def rows_of(key: tuple[str, int], now: Range) -> pa.RecordBatch:
        rows = [(*key, now.past, None, None, *[None] * 5), *((*key, None, *r) for r in now.results())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    types = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()
    names = ["archive", "range", "bytes", "offset", "successor", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return arrow_map(lines, run, f"archive string, range long, bytes long, offset long, successor long, {_FIELDS}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id string, payload_bytes, payload_digest, record_type, refers_to string, archive, offset) of the verified records."""
    prepare(spark)
    found = candidates(segments(spark, path)).checkpoint()
    before = F.sum("bytes").over(Window.partitionBy("archive").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = found.where("bytes is not null").select("archive", "range", "bytes", F.coalesce(before, F.lit(0)).alias("base")).checkpoint()
    placed = found.where("offset is not null").drop("bytes").join(ranges.drop("bytes"), ["archive", "range"])
    placed = placed.withColumns({"offset": F.col("base") + F.col("offset"), "successor": F.col("base") + F.col("successor")}).drop("base", "range").checkpoint()

    def chain(key, table):
        kept = reachable(table.column("offset").to_numpy(), table.column("successor").to_numpy())
        return table.filter(pa.array(kept))

    # Two numbers for each candidate meet by archive; what the records hold does not.
    real = placed.select("archive", "offset", "successor").groupBy("archive").applyInArrow(chain, "archive string, offset long, successor long")
    records_ = placed.join(real, ["archive", "offset", "successor"], "left_semi").checkpoint()
    whole = records_.where("record_type is not null").drop("successor")
    cut = records_.where("record_type is null").select("archive", "offset", "successor")
    if cut.isEmpty():
        return whole
    return whole.unionByName(across_ranges(segments(spark, path), ranges, cut).select(*whole.columns))


def across_ranges(lines: DataFrame, ranges: DataFrame, cut: DataFrame) -> DataFrame:
    """The records that begin in one byte range and end in another: at most one for each end of a range."""
    reach = ranges.join(cut, "archive").where("base < successor and base + bytes > offset").select("archive", "range", "base", "offset", "successor")
    wanted: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for r in reach.toLocalIterator():  # three at most for each range
        wanted.setdefault((r.archive, r.range), []).append((r.base, r.offset, r.successor))
    held = lines.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            rows = []
            for name, start, value in zip(batch.column("archive").to_pylist(), batch.column("range").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if key != (name, start):
                    key, at = (name, start), 0
                for base, first, past in held.value.get(key, ()):
                    if base + at < past and base + at + len(value) + len(SEPARATOR) > first:
                        rows.append((name, first, past, base + at, value + SEPARATOR))
                at += len(value) + len(SEPARATOR)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["archive", "offset", "successor", "place", "value"])

    def join(key, table):
        name, offset, successor = (x.as_py() for x in key)
        parts = sorted(zip(table.column("place").to_pylist(), table.column("value").to_pylist(), strict=True))
        data = b"".join(x[max(offset - a, 0) : successor - a] for a, x in parts)
        head = data.index(END)
        row = (*fields(data[:head], data[head + len(END) : -len(END)]), name, offset)
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"])

    pieces = arrow_map(lines, run, "archive string, offset long, successor long, place long, value binary")
    return pieces.groupBy("archive", "offset", "successor").applyInArrow(join, f"{_FIELDS}, archive string, offset long")


def report(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and returns what reading those gives."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    found = read_archives(spark, path)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
