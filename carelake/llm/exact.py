"""Exact dedup by two-pass Bloom filtering (operator 4).

Pass 1 hashes every normalised text and sets bits in a pair of Bloom filters,
"seen" and "seen again"; the tasks' filters meet per filter segment and merge
by bit operations.  Pass 2 tests every hash against "seen again": only the rows
whose bits are all set may have an equal text, and only they shuffle into
groups; the rest pass straight through as groups of one.

The filter is sized to the table (``BITS_PER_ROW`` a row) up to
``MAX_FILTER_BITS``, which bounds what is broadcast to 64 MiB.  Beyond that many
rows its false-positive rate rises, so more rows shuffle (narrow rows: id and
hash); the result stays exact at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import spare_name, stored, text_chunks, text_udf, utf8

BITS_PER_ROW = 16
MIN_FILTER_BITS = 1 << 16
MAX_FILTER_BITS = 1 << 29
PROBES = 3
SEGMENT_BITS = 1 << 16


def _digests(texts: pa.Array) -> pa.Array:
    data, at = utf8(texts)
    whole, at = data.tobytes(), at.tolist()
    return pa.array([hashlib.sha256(whole[a:b].lower()).digest() for a, b in zip(at, at[1:])], pa.binary())


def text_digest(text: str) -> Column:
    """SHA-256 of a text column after lower-casing A-Z only; null counts as empty."""
    return text_udf(_digests, "binary")(F.col(text))


def _parts(column: pa.Array):
    """A column of digests as it is, one of texts in chunks."""
    return [column] if pa.types.is_binary(column.type) else text_chunks(column)


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """(rows, PROBES) bit positions, taken from the digest itself."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), "<u4").reshape(-1, 8)[:, :PROBES]
    return (raw & np.uint32(bits - 1)).astype(np.int64)


def repeated_filter(rows: DataFrame, bits: int) -> np.ndarray:
    """Pass 1: packed bits set by at least two of the rows (one column of digests, or of texts).

    A task keeps two bit sets of ``bits`` bits and emits their non-empty
    segments; the segments of one place merge as ``again |= again' | seen & seen'``.
    The merged filter, at most ``MAX_FILTER_BITS`` bits whatever the number of
    rows, comes to the driver to be broadcast.
    """

    def build(batches):
        seen, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        found = (c if pa.types.is_binary(c.type) else _digests(c)
                 for batch in batches for c in _parts(batch.column(0)))
        for digests in found:
            at = _positions(digests, bits)
            for probe in range(PROBES):
                place, count = np.unique(at[:, probe], return_counts=True)
                byte, bit = place >> 3, (128 >> (place & 7)).astype(np.uint8)
                twice = (count > 1) | ((seen[byte] & bit) > 0)
                np.bitwise_or.at(again, byte[twice], bit[twice])
                np.bitwise_or.at(seen, byte, bit)
        seen, again = (x.reshape(-1, SEGMENT_BITS // 8) for x in (seen, again))
        used = np.flatnonzero(seen.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([seen[i].tobytes() for i in used], pa.binary()),
             pa.array([again[i].tobytes() for i in used], pa.binary())], ["segment", "seen", "again"])

    def merge(batches):
        seen: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                again[s] = again[s] | b | (seen[s] & a) if s in seen else b
                seen[s] = seen[s] | a if s in seen else a
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(again), pa.int32()), pa.array([x.tobytes() for x in again.values()], pa.binary())],
            ["segment", "again"])

    pieces = rows.mapInArrow(build, "segment int, seen binary, again binary")
    merged = pieces.repartition("segment").mapInArrow(merge, "segment int, again binary")
    out = np.zeros((bits // SEGMENT_BITS, SEGMENT_BITS // 8), np.uint8)
    for row in merged.toLocalIterator():
        out[row.segment] = np.frombuffer(row.again, np.uint8)
    return out.reshape(-1)


def filter_bits(rows: int) -> int:
    """Power of two for ``rows`` rows, within the fixed bounds."""
    return min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def tested(column: Column, repeated) -> Column:
    """Pass 2: struct of the digest and of whether all its bits were set twice, from
    a column of digests or of texts; ``repeated`` is a broadcast filter."""

    def probe(values: pa.Array) -> pa.Array:
        packed, out = repeated.value, []
        for part in _parts(values):
            digests = part if pa.types.is_binary(part.type) else _digests(part)
            at = _positions(digests, len(packed) * 8)
            maybe = ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            out.append(pa.StructArray.from_arrays([digests, pa.array(maybe, pa.bool_())], ["digest", "maybe"]))
        return pa.concat_arrays(out)

    probe.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(probe, "struct<digest: binary, maybe: boolean>").asNondeterministic()(column)


def group_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, the key that stays for its text, the
    size of its group, whether the row itself stays, and the text's digest.

    The row with the largest key stays; null keys come last (such a row stays
    only if no equal text has a key), and of rows that tie in key and text
    exactly one stays.  Null text equals empty text.  Other columns are not
    read.  An empty table gives an empty table.
    """
    hashed = stored(docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"),
                                text_digest(text).alias("digest")), "op4-digests")
    bits = filter_bits(hashed.count())
    repeated = docs.sparkSession.sparkContext.broadcast(repeated_filter(hashed.select("digest"), bits))
    rows = hashed.select("key", "row", tested(F.col("digest"), repeated).alias("t")).select("key", "row", "t.*")
    alone = rows.where(~F.col("maybe")).select("key", F.col("key").alias("keep_key"),
                                                 F.lit(1).cast("bigint").alias("group_size"),
                                                 F.lit(True).alias("kept"), "digest", "row")
    shuffled = stored(rows.where("maybe").drop("maybe"), "op4-repeats")
    groups = shuffled.groupBy("digest").agg(
        F.max(F.struct(F.col("key"), F.col("row"))).alias("stays"), F.count("*").alias("group_size"))
    joined = shuffled.join(groups, "digest").select(
        "key", F.col("stays.key").alias("keep_key"), "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"), "digest", "row")
    return alone.unionByName(joined)


def duplicate_report(docs: DataFrame) -> DataFrame:
    """Contract of op4: one row per document, dropped ones too."""
    return group_texts(docs).select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size",
                                    "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows whose digest cannot be repeated pass straight through; only possibly
    repeated rows shuffle: they are numbered within their digest by key.
    """
    test, row = (spare_name(docs, n) for n in ("test", "row"))
    bits = filter_bits(docs.count())
    repeated = docs.sparkSession.sparkContext.broadcast(
        repeated_filter(docs.select(F.col(text).cast("string").alias("text")), bits))
    rows = docs.withColumn(test, tested(F.col(text), repeated))
    alone = rows.where(~F.col(test)["maybe"])
    again = stored(rows.where(F.col(test)["maybe"]).withColumn(row, F.monotonically_increasing_id()), "op4-again")
    last = F.max(F.struct(F.col(key).alias("key"), F.col(row).alias("row")))
    stays = again.groupBy(F.col(test)["digest"].alias("digest")).agg(last.alias("last")).select(
        F.col("last.row").alias(row))
    kept = again.join(stays, row, "left_semi")
    return alone.drop(test).unionByName(kept.drop(test, row))
