"""Document fingerprints (operator 12): bottom-k sketches of word shingles.

A text's fingerprint holds the ``K`` smallest 64-bit names of its distinct
shingles of ``SHINGLE_WORDS`` words (A-Z lower-cased; a shorter text is one shingle), as
16 hex digits each, ascending.  Two sketches merge into that of the texts'
union, so parts of a text, of a document or of a corpus can be sketched apart;
resemblance, containment and the number of distinct shingles are read off the
sketches alone.  A sketch of fewer than ``K`` names holds its whole set and is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import U64, Spans, Words, text_chunks, text_udf

SHINGLE_WORDS = 5
K = 128
BUCKETS_PER_TASK = 4


def sketches(texts: pa.Array) -> list[np.ndarray]:
    """Bottom-k sketch of every text."""
    out = []
    for part in text_chunks(texts):
        w = Words(part, lower=True)
        spans = Spans(w.hashes)
        rolled = spans.windows(SHINGLE_WORDS)
        for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                out.append(np.unique(rolled[a:b - SHINGLE_WORDS + 1])[:K])
            else:
                out.append(spans.names(np.array([a]), np.array([b])) if b > a else np.zeros(0, U64))
    return out


def hexed(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def unhexed(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint or ""), ">u8").astype(U64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:K]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard share of the two sets; 1 for two empty ones."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    union = merge(a, b)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum() / len(union))


def distinct(a: np.ndarray) -> float:
    """Estimated number of distinct shingles; exact below K."""
    return float(len(a)) if len(a) < K else (K - 1) * 2.0 ** 64 / (float(a[K - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 if a is empty.  The two sets' overlap
    is their resemblance times the size of their union."""
    if len(a) == 0:
        return 1.0
    return float(min(1.0, resemblance(a, b) * distinct(merge(a, b)) / distinct(a))) if len(b) else 0.0


def fingerprint(text: str) -> Column:
    """Fingerprint of a text column; a null text counts as empty and has the empty one."""
    return text_udf(lambda texts: pa.array([hexed(s) for s in sketches(texts)], pa.string()), "string")(F.col(text))


def _of_two(fn, ddl: str, kind: pa.DataType):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([fn(unhexed(x), unhexed(y)) for x, y in zip(left.to_pylist(), right.to_pylist())], kind)

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl)


def likeness(a: Column, b: Column) -> Column:
    """Resemblance of two columns of fingerprints, 0 to 1; null counts as empty."""
    return _of_two(resemblance, "double", pa.float64())(a, b)


def contained(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has, 0 to 1."""
    return _of_two(containment, "double", pa.float64())(a, b)


def n_distinct(a: Column) -> Column:
    """Estimated number of distinct shingles of a fingerprint."""
    return _of_two(lambda x, _: distinct(x), "double", pa.float64())(a, a)


def merged(prints: DataFrame, by: list[str], column: str) -> DataFrame:
    """The fingerprint of all rows of each group: one row per group with ``by`` and ``column``.

    Names are made distinct over all tasks, and of a group every task passes on at most its K smallest, so no
    group is gathered; groups keep their nulls, a group of empty texts has the empty fingerprint."""
    names = prints.select(*by, F.explode(F.transform(
        F.sequence(F.lit(0), (F.length(column) / 16).cast("int")),
        lambda i: F.substring(F.col(column), i * 16 + 1, F.lit(16)))).alias("name")).where("name <> ''").distinct()
    rank = Window.partitionBy(*by).orderBy("name")
    least = names.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= K)
    whole = prints.select(*by).distinct()
    joined = least.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("name")), "").alias("found"))
    same = [whole[c].eqNullSafe(joined[c]) for c in by]
    return whole.join(joined, same, "left").select(*[whole[c] for c in by], F.coalesce("found", F.lit("")).alias(column))


def _cuts(docs: DataFrame, key: str, buckets: int) -> list[int]:
    """Keys that cut the table into about equal parts, descending."""
    if buckets < 2:
        return []
    found = docs.select(F.col(key).cast("double").alias("k")).approxQuantile(
        "k", [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    return sorted({int(x) for x in found}, reverse=True)


def _bucket(key: Column, cuts: list[int]) -> Column:
    """Number of the part in descending order of the key; rows without one come in the last."""
    ascending = np.array(cuts[::-1], np.int64)

    def run(keys: pa.Array) -> pa.Array:
        above = len(ascending) - np.searchsorted(ascending, keys.fill_null(0).to_numpy(), "left")
        return pa.array(np.where(keys.is_valid().to_numpy(zero_copy_only=False), above, len(ascending) + 1), pa.int32())

    run.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(key)


OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in descending order of the key, the head of the next bucket behind them."""
    names = [x.split()[0] for x in OUT.split(", ")]
    held = None  # key, text and sketch of the row whose next one is awaited
    for batch in batches:
        keys, texts, heads = (batch.column(i).to_pylist() for i in range(3))
        known = sketches(batch.column(1))
        done = []
        for key, text, head, own in zip(keys, texts, heads, known):
            if held is not None:
                done.append((*held, text, own))
            held = None if head else (key, text, own)
        edits = [t[:len(t) - len(t) // 2] + after[:len(t) // 2] for _, t, _, after, _ in done]
        new = sketches(pa.array(edits, pa.string()))
        rows = [(key, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(own), hexed(other),
                 resemblance(own, other), resemblance(own, follows))
                for (key, t, own, _, follows), e, other in zip(done, edits, new)]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_OUT_TYPE)


_OUT_TYPE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                       ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                       ("near_edited", pa.float64()), ("near_next", pa.float64())])


def sketch_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contract of op12: one row per document with its fingerprint, that of its edited text, and their likeness.

    The next document is the one with the next smaller key, after the last the
    first; rows without a key come last, rows that tie in key are ordered by text.
    Other columns are not read, a null text is empty, a text of any length is
    read whole, repeated rows are rows of their own; a table of one row is its own
    next, an empty table gives an empty table.

    Texts shuffle once: the table is cut into parts by key, every part gets the
    first row of the next one as a sentinel, and a sorted stream through each part
    meets every document with its next.  The cuts come from quantiles and only decide how
    even the parts are; the driver holds one key per part.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(docs, key, tasks * BUCKETS_PER_TASK)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit(""))
                       .alias("text"), _bucket(F.col(key).cast("bigint"), cuts).alias("bucket"))
    tops = {r.bucket: r.top for r in rows.groupBy("bucket").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first one's head follows the last bucket
    wanted = [t for t in tops.values() if t is not None]
    top = F.col("key").isin(wanted) if wanted else F.lit(False)
    if None in tops.values():
        top = top | F.col("key").isNull()
    into = F.create_map(*[F.lit(x) for b in order for x in (b, before[b])]) if order else F.create_map(F.lit(0), F.lit(0))
    heads = rows.where(top).groupBy("bucket").agg(
        F.min("text").alias("text")).select(
        F.lit(None).cast("bigint").alias("key"), "text", into[F.col("bucket")].alias("bucket"), F.lit(True).alias("head"))
    both = rows.select("key", "text", "bucket", F.lit(False).alias("head")).unionByName(heads)
    streams = both.repartition(tasks, "bucket").sortWithinPartitions(
        "bucket", "head", F.col("key").desc_nulls_last(), "text")
    return streams.select("key", "text", "head").mapInArrow(_edited, OUT)
