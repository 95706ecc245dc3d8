"""Best-fit packing by linear grouping (operator 1).

Documents become pieces of at most ``capacity`` tokens; only longer documents
are cut, and their first piece may be shorter.  How many pieces there are of
each length is one grouped count (at most ``capacity`` rows whatever the size of
the corpus), and the driver packs those counts, never single documents:

1. linear grouping: the large lengths, in falling order, fall into ``GROUPS``
   groups of equal cardinality, and each is rounded up to its group's largest;
2. the few sizes left are packed by a linear programme over configurations
   (column generation), rounded down to whole sequences;
3. actual lengths take the places of their groups, largest first;
4. what rounding left over and the small lengths go where they fit best, by
   falling length, into the gaps of the actual lengths.

The plan says, for a range of ranks of a length, which sequences and offset they
get.  Its rows depend on the capacity, not on the corpus: every length starts
few ranges, one for each run of alike sequences it meets.  Pieces are ranked
within their length (counts per task and length give the offsets), and an
equi-join on the length finds each piece's range.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import stored, text_udf
from carelake.llm.tokens import TOKEN_CHUNK_BYTES, encode, tokenizer_path

CAPACITY = 2048
LARGE_SHARE = 0.45
GROUPS = 64
MAX_ROUNDS = 3000
PLAN_SCHEMA = "length bigint, low bigint, high bigint, first bigint, per_sequence bigint, place bigint"


def _best_column(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the configuration of largest value within the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fit = int(np.searchsorted(sizes, room, "right"))
        if fit:
            options = best[room - sizes[:fit]] + values[:fit]
            j = int(options.argmax())
            if options[j] > best[room] + 1e-12:
                best[room], taken[room] = options[j], j
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            column[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, whole sequences) of the fewest-sequences linear programme, rounded down."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = counts / np.diag(basis)
    for _ in range(MAX_ROUNDS):
        price = np.linalg.solve(basis.T, np.ones(m))
        value, column = _best_column(np.maximum(price, 0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out], basis[:, out] = ratio[out], column
    return [(basis[:, j].astype(np.int64), int(amount[j] + 1e-6)) for j in range(m)]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (length, low, high, first, per_sequence, place): the piece of rank r
    of a length, low <= r < high, goes to sequence first + (r - low) // per_sequence
    at offset place + (r - low) % per_sequence * length."""
    ranges: list[tuple[int, int, int, int, int, int]] = []
    ranked = dict.fromkeys(counts, 0)  # ranks given out so far
    alike: dict[int, list[tuple[int, int]]] = defaultdict(list)  # tokens used -> (first sequence, sequences)
    new = 0

    def put(length: int, n: int, first: int, per: int, place: int) -> None:
        ranges.append((length, ranked[length], ranked[length] + n, first, per, place))
        ranked[length] += n

    large = sorted((x for x, n in counts.items() if x > capacity * LARGE_SHARE and n), reverse=True)
    total = sum(counts[x] for x in large)
    if total:
        each = -(-total // GROUPS)
        queues: list[list[list[int]]] = []  # per group: [length, pieces left] from the largest
        room = 0
        for length in large:
            left = counts[length]
            while left:
                if not room:
                    queues.append([])
                    room = each
                take = min(left, room)
                queues[-1].append([length, take])
                left, room = left - take, room - take
        queues.reverse()
        sizes = np.array([q[0][0] for q in queues])
        merged, group = np.unique(sizes, return_inverse=True)
        pools: list[list[list[int]]] = [[] for _ in merged]
        for g, q in sorted(zip(group.tolist(), queues), key=lambda x: (x[0], -x[1][0][0])):
            pools[g].extend(q)
        held = np.array([sum(n for _, n in p) for p in pools])
        for column, copies in configurations(merged, held.astype(float), capacity):
            used = np.flatnonzero(column)
            copies = min([copies, *(int(held[g] // column[g]) for g in used)])
            if not copies:
                continue
            held[used] -= column[used] * copies
            runs = [(new, copies, 0)]
            new += copies
            for g in [g for g in used[::-1] for _ in range(column[g])]:
                split = []
                for first, n, fill in runs:
                    while n:
                        length, left = pools[g][0]
                        take = min(n, left)
                        put(length, take, first, 1, fill)
                        split.append((first, take, fill + length))
                        first, n = first + take, n - take
                        pools[g][0][1] -= take
                        if not pools[g][0][1]:
                            pools[g].pop(0)
                runs = split
            for first, n, fill in runs:
                alike[fill].append((first, n))
    for length in sorted(counts, reverse=True):
        left, fill = counts[length] - ranked[length], capacity - length
        while left:
            while fill >= 0 and not alike.get(fill):
                fill -= 1
            if fill < 0:  # nothing has room: new sequences
                fill = 0
                per = capacity // length
                alike[0].append((new, -(-left // per)))
                new += -(-left // per)
            first, n = alike[fill].pop()
            per = min((capacity - fill) // length, left)
            take = min(n, left // per)
            if take < n:
                alike[fill].append((first + take, n - take))
            put(length, take * per, first, per, fill)
            alike[fill + per * length].append((first, take))
            left -= take * per
            fill = capacity - length
    return ranges


def _pieces(path: str, cut: str, end_id: int, capacity: int):
    def run(texts: pa.Array) -> pa.Array:
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        start, ids, at = [], [], [0]
        for own in encode(texts, path, cut):
            own += end
            head = len(own) % width or width
            cuts = [0, *range(head, len(own) + 1, width)]
            start += [c // 4 for c in cuts[:-1]]
            ids += [own[a:b] for a, b in zip(cuts, cuts[1:])]
            at.append(len(ids))
        flat = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["start", "ids"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)

    return text_udf(run, "array<struct<start: bigint, ids: binary>>", keeps=True, limit=TOKEN_CHUNK_BYTES)


def token_pieces(docs: DataFrame, path: str, cut: str = "keeps_space", end_id: int = 0,
                 capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table of the pieces of every document: key, piece, start, length,
    ids (packed little-endian unsigned 32-bit) and the task that made them.

    A null text counts as empty and gives one piece with the end id; every row of
    ``docs`` is packed, also rows that repeat or have a null key.  Other columns
    are not read."""
    cut_up = docs.select(F.col(key).alias("key"), _pieces(path, cut, end_id, capacity)(F.col(text)).alias("own"))
    rows = cut_up.select("key", F.posexplode("own").alias("piece", "own"))
    return stored(rows.select("key", "piece", "own.start", (F.octet_length("own.ids") / 4).cast("bigint").alias("length"),
                              "own.ids", F.spark_partition_id().alias("task"),
                              F.monotonically_increasing_id().alias("row")), "op1-pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, task, row and any other columns) with sequence_id and
    offset; task and row must be stored values, with row unique."""
    counts = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "op1-counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = pieces.sparkSession.createDataFrame(plan(lengths, capacity), PLAN_SCHEMA)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "task").orderBy("row")
    ranked = (pieces.withColumn("at", F.row_number().over(own)).join(offsets, ["length", "task"])
              .withColumn("rank", F.col("before") + F.col("at") - 1).drop("before", "at"))
    # The plan's rows are bounded by the capacity, so it may be broadcast.
    found = ranked.join(F.broadcast(ranges.withColumnRenamed("length", "of")),
                        (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return found.withColumn("sequence_id", F.expr("first + (rank - low) div per_sequence")).withColumn(
        "offset", F.col("place") + nth % F.col("per_sequence") * F.col("length")).drop(
        "of", "low", "high", "first", "per_sequence", "place", "rank")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids and the pieces' keys in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "key", "piece", "length")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
        F.expr("transform(parts, x -> struct(x.key, x.piece, x.offset, x.length))").alias("parts"))


def packing_report(docs: DataFrame) -> DataFrame:
    """Contract of op1: one row per piece with its ids' checksum and its place."""
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    narrow = pieces.select("key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "row")
    return place(narrow).select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id",
                                "offset")
