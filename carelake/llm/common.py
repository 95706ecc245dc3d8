"""Helpers shared by the operators: text columns as numpy arrays, hashes of words
and word windows, scratch tables in the shared folder, distributed components.

Text functions run as Arrow UDFs: one Arrow array of texts in, one array (often
of structs) out, so the other columns of a row never travel to Python.  Inside,
a batch is cut into chunks of half a MB and handled with numpy over the raw
UTF-8 bytes; a single text larger than a chunk forms a chunk of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 19
U64 = np.uint64

# Fixed value: the white space of the pattern [^\x20\x09-\x0D]+.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE_SPACE)] = False
_IS_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_FACTOR = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later steps
    start from files that survive the loss of executors, and non-deterministic
    columns (row numbers) are fixed from here on."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# What a Python worker keeps between batches, such as a tokenizer.  Workers serve one
# operator after the other, so it goes when another function takes over.
kept_in_worker: dict = {}


def release() -> None:
    """Empties ``kept_in_worker`` (called by name, so it reaches the worker's own)."""
    kept_in_worker.clear()


def text_udf(fn: Callable[[pa.Array], pa.Array], ddl: str, keeps: bool = False,
             limit: int = CHUNK_BYTES) -> Callable[..., Column]:
    """Arrow UDF evaluated once per row (Catalyst does not duplicate it), called for
    chunks of about ``limit`` bytes; only a function that ``keeps`` finds
    ``kept_in_worker`` as it left it."""

    def run(texts: pa.Array) -> pa.Array:
        if not keeps:
            release()
        parts = [fn(c) for c in text_chunks(texts, limit)]
        return pa.concat_arrays(parts) if parts else fn(pa.array([], pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl).asNondeterministic()


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes, nulls replaced by empty texts."""
    texts = pc.fill_null(texts, "")
    ends = utf8(texts)[1]
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield texts.slice(at, min(to, n) - at)
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of a chunk of texts: byte spans, code-point lengths and 64-bit hashes.

    ``first[d]:first[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = utf8(texts)
        data, off = self.data, self.offsets
        self.n_texts, n = len(off) - 1, len(data)
        self.is_word = inside = _IS_WORD[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = off[:-1][off[1:] > off[:-1]]
        last = off[1:][off[1:] > off[:-1]] - 1
        begin[full], end[last] = inside[full], inside[last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        padded = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
        self.blocks = np.ndarray((n + 1,), "<u8", padded, 0, (1,))  # the 8 bytes from every place on
        self.hashes = self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal bytes have equal hashes wherever they stand.
        Every block of 8 bytes is scrambled with its number before they are summed,
        so that no pattern of a text cancels out."""
        size = ends - starts
        total = mix((self.blocks[starts] & _MASK[np.minimum(size, 8)]) + _STEP)
        more = np.flatnonzero(size > 8)
        if len(more):
            count = (size[more] - 1) >> 3
            first = np.cumsum(count) - count
            nth = np.arange(int(count.sum())) - np.repeat(first, count) + 1
            at = np.repeat(starts[more], count) + 8 * nth
            left = np.minimum(np.repeat(ends[more], count) - at, 8)
            scrambled = mix((self.blocks[at] & _MASK[left]) ^ mix((nth + 1).astype(U64) * _STEP))
            total[more] += np.add.reduceat(scrambled, first)
        return mix(total + size.astype(U64) * _FACTOR)

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def lengths(self) -> np.ndarray:
        """Code points of each word."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_IS_LEAD[self.data], out=total[1:])
        return total[self.ends] - total[self.starts]

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))


class Spans:
    """Names of spans of consecutive hashes (also across texts).  Level k names all
    2**k consecutive entries by scrambling the names of their halves; a span is
    joined from the levels in its length's binary digits, lowest first."""

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_joined(below[:-half], below[half:]) if len(below) > half else below[:0])
        return self.levels[k]

    def windows(self, n: int) -> np.ndarray:
        """Names of all n consecutive entries."""
        size = max(0, len(self.levels[0]) - n + 1)
        out, done = np.full(size, mix(np.array([n], U64))[0]), 0
        for k in range(n.bit_length() if size else 0):
            if n >> k & 1:
                out = _joined(out, self._level(k)[done:done + size])
                done += 1 << k
        return out

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Names of the spans a..b-1, those of ``windows`` for the same entries."""
        size, at = b - a, a.copy()
        out = mix(size.astype(U64))
        for k in range(int(size.max()).bit_length() if len(size) else 0):
            i = np.flatnonzero(size >> k & 1)
            if len(i):
                out[i] = _joined(out[i], self._level(k)[at[i]])
                at[i] += 1 << k
        return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _FACTOR + right)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Names of all n consecutive entries (also across texts)."""
    return Spans(hashes).windows(n)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps: every step hangs nodes to the
    smallest neighbour they know, through a grouped minimum (partial before the
    shuffle) and an equi-join, so no neighbour list is ever gathered; a hot
    node's rows are split by the skew join.  Each step is written to the shared
    folder, and the steps end when the edges no longer change.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 label)
    was = state(now)
    while was[0]:
        now = stored(star(star(now, True), False), label)
        new = state(now)
        if new == was:
            break
        was = new
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carelake.sources.tables import table_path

    return spark.read.parquet(table_path(sf_dir, "documents"))


FILTER_BITS_PER_KEY = 16
MAX_FILTER_BITS = 1 << 29


def bits_for(rows: int) -> int:
    """Bits of a Bloom filter for ``rows`` keys: a power of two within fixed bounds."""
    return min(MAX_FILTER_BITS, max(1 << 16, 1 << (max(1, rows) * FILTER_BITS_PER_KEY - 1).bit_length()))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    low, high = hashes & U64(0xFFFFFFFF), hashes >> U64(32)
    return [((low + U64(i) * high) & U64(bits - 1)).astype(np.int64) for i in range(3)]


def perhaps_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A test for membership in ``keys`` (one bigint column without nulls) that errs
    only towards true: a Bloom filter of at most 64 MiB, broadcast.  It spares
    rows a shuffle; the join behind it decides."""
    bits = bits_for(keys.count())

    def build(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = mix(np.asarray(batch.column(0)).view(U64))
            for at in _places(hashes, bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pieces = own.reshape(-1, min(len(own), 1 << 13))
        used = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()),
                                          pa.array([pieces[i].tobytes() for i in used], pa.binary())], ["at", "own"])

    def merge(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x, np.uint8)
                whole[i] = whole[i] | x if i in whole else x
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()),
                                          pa.array([x.tobytes() for x in whole.values()], pa.binary())], ["at", "own"])

    schema = "at int, own binary"
    packed = np.zeros((-(-bits // (8 << 13)), min(bits // 8, 1 << 13)), np.uint8)
    for row in keys.mapInArrow(build, schema).repartition("at").mapInArrow(merge, schema).toLocalIterator():
        packed[row.at] = np.frombuffer(row.own, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(packed.reshape(-1))

    def probe(values: pa.Array) -> pa.Array:
        hashes = mix(np.asarray(pc.fill_null(values, 0)).view(U64))
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, bits):
            found &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pa.array(found & values.is_valid().to_numpy(zero_copy_only=False))

    probe.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(probe, "boolean").asNondeterministic()
