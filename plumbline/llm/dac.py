"""Token-id files of directly addressable codes.

An id is split into 8-bit chunks.  Level k holds the k-th chunks of all ids
that have one, one byte each; a bitmap over level k says which of them go on
in level k + 1, and a rank directory counts the bitmap's ones before each
block.  The chunk of id i in the next level is at the number of ones before
i's bit, so any id is found in a few steps and nothing else is decoded.

A file is a table of segments (one binary blob and the documents it holds per
row) that Spark writes and commits, so a task that is lost or runs twice
leaves no half-written file.  Segments follow each other in ascending doc_id
order: by ``part``, then by ``local_start``.

Defined results: a null text is empty and yields the end id alone; a null
doc_id sorts first; rows with equal doc_ids stand beside each other in the
order of their texts' hashes; an empty table gives an empty file; columns
other than the two named are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenize import encoder

MAGIC = b"PDAC1"
BLOCK = 64  # bytes of bitmap for each entry of a rank directory
STEP = 1 << 20  # ids between the marks by which a place finds its segment
RUN = 1 << 16  # ids that are decoded at once, to the end of the document

SEGMENTS = "part int, local_start long, n_ids long, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>, blob binary"


def encode(ids: np.ndarray) -> bytes:
    """Blob of unsigned 32-bit ids."""
    levels, rest = [], np.asarray(ids, "<u4")
    while True:
        more = rest > 0xFF
        last = not more.any()
        bits = b"" if last else np.packbits(more, bitorder="little").tobytes()
        levels.append(((rest & 0xFF).astype(np.uint8).tobytes(), bits))
        if last:
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<QB", len(ids), len(levels))]
    for chunks, bits in levels:
        out.append(struct.pack("<QB", len(chunks), bool(bits)))
        out.append(chunks)
        if bits:
            out.append(bits)
            out.append(_directory(np.frombuffer(bits, np.uint8)).tobytes())
    return b"".join(out)


def _directory(bits: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(bits).astype("<u4")
    blocks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK)) if len(ones) else ones
    return np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4")


class Reader:
    """Random access to the ids of a blob."""

    def __init__(self, blob: bytes):
        view = memoryview(blob)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token-id segment")
        self.n, count = struct.unpack_from("<QB", view, len(MAGIC))
        at, self.levels = len(MAGIC) + 9, []
        for _ in range(count):
            size, goes_on = struct.unpack_from("<QB", view, at)
            at += 9
            chunks = np.frombuffer(view, np.uint8, size, at)
            at += size
            bits = directory = None
            if goes_on:
                wide = (size + 7) // 8
                bits = np.frombuffer(view, np.uint8, wide, at)
                at += wide
                entries = (wide + BLOCK - 1) // BLOCK
                directory = np.frombuffer(view, "<u4", entries, at)
                at += 4 * entries
            self.levels.append((chunks, bits, directory))

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, at: int) -> int:
        """Ones before position ``at``."""
        byte, bit = divmod(at, 8)
        block = min(byte // BLOCK, len(directory) - 1)
        ones = int(directory[block]) + int(np.bitwise_count(bits[block * BLOCK : byte]).sum(dtype=np.int64))
        return ones + (int(bits[byte] & ((1 << bit) - 1)).bit_count() if bit else 0)

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * level)
            if bits is None or not bits[at >> 3] >> (at & 7) & 1:
                break
            at = self._rank(bits, directory, at)
        return value

    def slice(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from ``start``; a level's part of them is one run."""
        if start < 0 or length < 0 or start + length > self.n:
            raise IndexError((start, length))
        out, where, end = np.zeros(length, "<u4"), np.arange(length), start + length
        for level, (chunks, bits, directory) in enumerate(self.levels):
            out[where] |= chunks[start:end].astype("<u4") << np.uint32(8 * level)
            if bits is None or start == end:
                break
            low = start >> 3
            more = np.unpackbits(bits[low : (end + 7) >> 3], bitorder="little")[start - 8 * low : end - 8 * low].view(bool)
            where, start = where[more], self._rank(bits, directory, start)
            end = start + len(where)
        return out


def write(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, *, spaces_dropped: bool = False, segment_ids: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Tokenise whole texts and write them to ``path`` in ascending doc_id order.

    One range shuffle of the texts; a segment closes at the first document end
    past ``segment_ids`` ids, so memory follows the longest document only.
    """
    common.ship_package(spark)
    file = common.ship_file(spark, tokenizer)

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, begun = encoder(common.shipped(file), spaces_dropped), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        names, raws, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal begun, names, raws, held
            lengths = [len(x) // 4 for x in raws]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int).tolist()
            row = {"part": part, "local_start": begun, "n_ids": held, "doc_ids": names, "doc_starts": starts, "doc_lengths": lengths, "blob": encode(np.frombuffer(b"".join(raws), "<u4"))}
            begun, names, raws, held = begun + held, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in common.slices(batches, tokens=True):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, raw in zip(ids, codec.encode(texts), strict=True):
                names.append(name)
                raws.append(raw + end)
                held += len(raws[-1]) // 4
                if held >= segment_ids:
                    yield close()
        if names:
            yield close()

    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(common.shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    with common.small_batches(spark):
        ordered.mapInArrow(encode_part, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def _arrow_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", longs), ("doc_starts", longs), ("doc_lengths", longs), ("blob", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a file with ``start``, the ids in all segments before each.

    What meets on the driver is one total per writing task.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    rows, before = [], 0
    for part in sorted(totals):
        rows.append((part, before))
        before += totals[part]
    offsets = spark.createDataFrame(rows, "part int, before long")
    return segments.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def lookup(segments: DataFrame, places: DataFrame) -> DataFrame:
    """place and id of each token at the ``place`` (counted over the whole file) of ``places``; places beyond the end have no row.

    Only segments that hold a place are read, and of a segment only the chunks on the way to its ids.
    """
    common.ship_package(segments.sparkSession)
    held = segments.select("start", "n_ids").withColumn("step", F.explode(F.sequence(F.floor(F.col("start") / STEP), F.floor((F.col("start") + F.col("n_ids") - 1) / STEP))))
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("step", F.floor(F.col("place") / STEP))
    found = asked.join(held, (asked.step == held.step) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_ids")))
    wanted = found.groupBy("start").agg(F.collect_set("place").alias("places"))

    def read_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            for row in batch.to_pylist():
                reader = Reader(row["blob"])
                ids = [reader[place - row["start"]] for place in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array(ids, pa.int64())], ["place", "id"])

    return segments.select("start", "blob").join(wanted, "start").select("start", "places", "blob").mapInArrow(read_some, "place long, id long")


def checksums(reader: Reader, starts: list[int], lengths: list[int]) -> list[int]:
    """crc32 of each document's ids; documents follow each other, and about ``RUN`` ids are decoded at once."""
    out = []
    for _, run in groupby(zip(starts, lengths, strict=True), lambda x: x[0] // RUN):
        held = list(run)
        begin, end = held[0][0], sum(held[-1])
        raw = memoryview(reader.slice(begin, end - begin).tobytes())
        out += [zlib.crc32(raw[4 * (start - begin) : 4 * (start - begin + length)]) for start, length in held]
    return out


def digest(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the blobs."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            for row in batch.to_pylist():
                starts, lengths = row["doc_starts"], row["doc_lengths"]
                out = [row["doc_ids"], [row["start"] + x for x in starts], lengths, checksums(Reader(row["blob"]), starts, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    common.ship_package(segments.sparkSession)
    return segments.select("start", "doc_ids", "doc_starts", "doc_lengths", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
