"""Token files: seekable zstandard shards of token ids (operator 2).

Documents are range-partitioned and sorted by their integer key, encoded, and
written as shard files, in key order over the whole folder.  A shard is:

* data frames: independent zstandard frames of packed little-endian unsigned
  32-bit ids; a frame never holds two documents, and a document longer than
  ``FRAME_BYTES`` has several, so a reader decompresses only what it asks for;
* the document index: a skippable frame (magic 0x184D2A50) with a compressed
  table of keys, frames and ids of every document in the shard;
* the seek table: a skippable frame (magic 0x184D2A5E) with the compressed size,
  decompressed size and checksum (low 32 bits of XXH64) of every data frame,
  ended by the number of frames, the flag byte 0x80 and the magic 0x8F92EAB1.

Spark's own text writer stores each shard as one raw record of one file and its
record separator is the closing magic number, so shards reach any file system
that Spark writes to, under Spark's commit protocol: a lost executor's half
written shards are never seen.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.llm.common import fresh_path, read_documents, stored, text_chunks
from carelake.llm.tokens import TOKEN_CHUNK_BYTES, encode, tokenizer_path

FRAME_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
LEVEL = 3
# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = b"\xb1\xea\x92\x8f"
CHECKSUM_FLAG = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
DOCUMENT = np.dtype([("key", "<i8"), ("has_key", "u1"), ("frames", "<u4"), ("ids", "<u8")])


class Shard:
    """One shard being written."""

    def __init__(self):
        self.body, self.entries, self.documents = bytearray(), [], []
        self.zip = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, key: int | None, ids: bytes) -> None:
        cuts = range(0, max(1, len(ids)), FRAME_BYTES)
        for a in cuts:
            raw = ids[a:a + FRAME_BYTES]
            packed = self.zip.compress(raw)
            self.body += packed
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.documents.append((key or 0, key is not None, len(cuts), len(ids) // 4))

    def content(self) -> bytes:
        """The file without its closing magic number."""
        index = self.zip.compress(np.array(self.documents, DOCUMENT).tobytes())
        table = np.array(self.entries, ENTRY).tobytes()
        return bytes(self.body) + struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack(
            "<II", SKIPPABLE_SEEK_TABLE, len(table) + 9) + table + struct.pack("<IB", len(self.entries), CHECKSUM_FLAG)


def read_shard(content: bytes, wanted=None) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(ids before it in the shard, key, number of ids, packed ids) of the
    documents whose key is in ``wanted`` (all without it); other documents' frames
    are skipped.  Raises ValueError on a broken file or a wrong checksum."""
    if content[-4:] != SEEKABLE_MAGIC:
        raise ValueError("not a seekable zstandard file")
    n, flag = struct.unpack("<IB", content[-9:-4])
    table_at = len(content) - 9 - n * ENTRY.itemsize
    if flag != CHECKSUM_FLAG or struct.unpack("<I", content[table_at - 8:table_at - 4])[0] != SKIPPABLE_SEEK_TABLE:
        raise ValueError("broken seek table")
    entries = np.frombuffer(content, ENTRY, n, table_at)
    at = np.concatenate([[0], np.cumsum(entries["packed"].astype(np.int64))])
    magic, size = struct.unpack("<II", content[at[-1]:at[-1] + 8])
    if magic != SKIPPABLE_INDEX:
        raise ValueError("broken document index")
    unzip = zstandard.ZstdDecompressor()
    documents = np.frombuffer(unzip.decompress(content[at[-1] + 8:at[-1] + 8 + size]), DOCUMENT)
    frame = before = 0
    for key, has_key, frames, ids in documents.tolist():
        if wanted is None or (has_key and key in wanted):
            raw = []
            for f in range(frame, frame + frames):
                raw.append(unzip.decompress(content[at[f]:at[f + 1]]))
                if xxhash.xxh64_intdigest(raw[-1]) & 0xFFFFFFFF != entries["check"][f]:
                    raise ValueError(f"wrong checksum in frame {f}")
            yield before, key if has_key else None, ids, b"".join(raw)
        frame, before = frame + frames, before + ids


def write_token_files(docs: DataFrame, folder: str, path: str, cut: str, end_id: int, key: str = "doc_id",
                      text: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the shards to ``folder``.

    ``key`` is an integer column; rows without one come last.  A null text counts
    as empty (its document is the end id alone).  Every row is written, also
    repeated ones, in any order among equal keys.  Other columns are not read.
    An empty table writes no shard."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, shard = np.array([end_id], "<u4").tobytes(), Shard()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard.content()], pa.binary())], ["shard"])

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in text_chunks(batch.column(1), TOKEN_CHUNK_BYTES):
                for k, ids in zip(keys[at:at + len(texts)], encode(texts, path, cut)):
                    shard.add(k, ids + end)
                    if len(shard.body) >= SHARD_BYTES:
                        yield out()
                        shard = Shard()
                at += len(texts)
        if shard.documents:
            yield out()

    order = F.col("key").asc_nulls_last()
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    shards = rows.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(write, "shard binary")
    (shards.select(F.col("shard").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", SEEKABLE_MAGIC.decode("ISO-8859-1")).text(folder))


def read_token_files(spark: SparkSession, folder: str, wanted: set[int] | None = None) -> DataFrame:
    """part and nth (order of the file), before (ids before the document in its
    file), key, n_tokens and ids of every document, or only of ``wanted`` keys,
    whose frames alone are decompressed."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "nth", "before", "key", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for part, nth, content in zip(*(batch.column(i) for i in range(3))):
                rows, size = [], 0
                for row in read_shard(content.as_py(), wanted):
                    rows.append((part.as_py(), nth.as_py(), *row))
                    size += len(row[-1])
                    if size > FRAME_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"part-(\d+)-", 1).cast("bigint").alias("part"),
        F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).cast("bigint").alias("nth"), "content")
    return files.mapInArrow(read, "part bigint, nth bigint, before bigint, key bigint, n_tokens bigint, ids binary")


def stored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids_crc32 of every
    document, from the files alone."""
    rows = stored(read_token_files(spark, folder).select(
        "part", "nth", "before", "key", "n_tokens", F.crc32("ids").alias("ids_crc32")), "op2-read")
    files = rows.groupBy("part", "nth").agg(F.sum("n_tokens").alias("size"))
    parts = files.groupBy("part").agg(F.sum("size").alias("size"))  # one row a writing task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("parts_before"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "nth", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("files_before"))
    found = rows.join(files, ["part", "nth"]).join(parts, "part")
    return found.select("key", (F.col("parts_before") + F.col("files_before") + F.col("before")).alias("start"),
                        "n_tokens", "ids_crc32")


def token_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op2: writes the token files of all documents and reads them back."""
    folder = fresh_path(spark, "op2-token-files")
    write_token_files(read_documents(spark, sf_dir), folder, tokenizer_path("word_bpe_49k.json"), "drops_space", 2)
    return stored_documents(spark, folder).withColumnRenamed("key", "doc_id")
