"""Conversation structure repair (operator 13).

Cheapest edits that bring a conversation's roles into the form ``(s?(ua)+)?``:
a row is kept (0), given the role that is due (2) or deleted (3, the only way for
a blank or repeated row), an empty row of the role that is due is put in (2), and a
truncated row that stays costs 1.  Of equally cheap edits the ASCII-least letters
(D, I, K, R) win.

Four states tell which role is due, so a row is a step between vectors of four
costs, from the end backward.  Conversations are cut into blocks of ``BLOCK`` rows;
a row of the table is a block of one-byte codes, never a text.

1. Every block, on its own: its 4 x 4 matrix of least costs from state to state.
2. One stream per conversation over its blocks, last to first: the cost vector at
   each block's end, the checkpoint.  Vectors inside blocks are not kept.
3. Every block, on its own: from its checkpoint, again checkpoints each
   square root of its rows, the vectors between two of them recomputed while walking
   forward along tight edits, for each state that the block may be entered in.
4. One stream per conversation, first to last, picks the walk of the state it is in;
   the texts follow in the same stream and go into the digest of the repaired conversation.

A stream keeps four numbers and one block's letters, whatever its conversation's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import stored
from carelake.llm.turns import WORD, numbered, turn_digest

BLOCK = 1024
# Fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INITIALS = "sua"
NAMES = {"u": "user", "a": "assistant"}
# States: nothing yet; system said; user said; assistant said.  The role that is due
# leads to DUE[state]; a kept row of initial x leads to KEEP[x][state], -1 where it may not stand.
DUE = np.array([2, 2, 3, 2])
KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
DUE_ROLE = ["user", "user", "assistant", "user"]
END = np.array([0, 2 * INSERT, INSERT, 0])  # inserts that finish a conversation from each state
FAR = 1 << 40
PAD = 255
# Letters of the inserts and the step that a row takes, for walks of whole blocks as arrays.
STEPS = [x + y for x in ("", "I", "II") for y in "DKR"]


def coded(initial: Column, delete: Column, truncated: Column) -> Column:
    """One-byte code of a row: initial (0 s, 1 u, 2 a, 3 other), 4 where it must go, 8 where truncated."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), initial).cast("int"), F.lit(0))
    return (F.when(place == 0, 3).otherwise(place - 1) + F.when(delete, 4).otherwise(0)
            + F.when(truncated, 8).otherwise(0))


def step(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost vectors (..., 4) before rows with these codes, from those behind them; padding changes nothing."""
    keep = KEEP[codes & 3]
    stay = np.where((codes & 8) > 0, TRUNCATED, 0)[..., None]
    kept = np.where(keep >= 0, np.take_along_axis(after, np.maximum(keep, 0), -1) + stay, FAR)
    best = np.minimum(kept, after[..., DUE] + REROLE + stay)
    best = np.where((codes & 4)[..., None] > 0, FAR, best)
    best = np.minimum(best, after + DELETE)
    out = np.minimum(best, best[..., DUE] + INSERT)
    return np.where((codes == PAD)[..., None], after, np.minimum(out, FAR))


def matrices(codes: np.ndarray) -> np.ndarray:
    """(blocks, to, from): least costs through every block, for each state behind it."""
    ends = np.where(np.eye(4, dtype=bool), 0, FAR) + np.zeros((len(codes), 1, 1), np.int64)
    # A state behind a block is left as it is: inserts stand before rows.
    for i in range(codes.shape[1] - 1, -1, -1):
        ends = step(np.repeat(codes[:, i:i + 1], 4, axis=1), ends)
    return ends


def walks(codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every block and state that it may be entered in: the steps taken (index of
    ``STEPS``) and the state behind it, along tight edits.

    Backward, cost vectors are kept at every square root of the rows; forward, those
    between two of them are computed again from the latter.
    """
    n, size = codes.shape
    width = isqrt(max(size - 1, 0)) + 1
    points, now = {}, end
    for i in range(size - 1, -1, -1):
        if (i + 1) % width == 0 or i == size - 1:
            points[i // width] = now
        now = step(codes[:, i], now)
    state = np.tile(np.arange(4), (n, 1))
    taken = np.zeros((n, size, 4), np.uint8)
    for part in range(-(-size // width)):
        lo, hi = part * width, min(size, part * width + width)
        vectors = [points[part]]
        for i in range(hi - 1, lo - 1, -1):
            vectors.append(step(codes[:, i], vectors[-1]))
        for i in range(lo, hi):
            before, after = vectors[hi - i], vectors[hi - i - 1]
            code = np.repeat(codes[:, i:i + 1], 4, axis=1)
            real, open_ = code != PAD, code != PAD
            inserts = np.zeros((n, 4), np.int64)
            for _ in range(3):  # at most two inserts before a row are ever tight
                cost = np.take_along_axis(before, state, 1)
                deletes = cost == np.take_along_axis(after, state, 1) + DELETE
                due = DUE[state]
                insert = open_ & ~deletes & (cost == np.take_along_axis(before, due, 1) + INSERT)
                inserts += insert
                state = np.where(insert, due, state)
                open_ = open_ & insert
            cost = np.take_along_axis(before, state, 1)
            stay = np.where((code & 8) > 0, TRUNCATED, 0)
            keep = np.take_along_axis(KEEP[code & 3], state[..., None], 2)[..., 0]
            free = (code & 4) == 0
            deletes = cost == np.take_along_axis(after, state, 1) + DELETE
            keeps = free & (keep >= 0) & (cost == np.take_along_axis(after, np.maximum(keep, 0), 1) + stay)
            move = np.where(deletes, 0, np.where(keeps, 1, 2))
            state = np.where(real, np.where(deletes, state, np.where(keeps, np.maximum(keep, 0), DUE[state])), state)
            taken[:, i] = np.where(real, inserts * 3 + move, PAD)
    return taken, state


def _padded(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of about equal length together, as a padded array of codes."""
    known = [np.frombuffer(x, np.uint8) for x in column.to_pylist()]
    sizes = np.array([len(x) for x in known])
    kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        out = np.full((len(rows), int(sizes[rows].max())), PAD, np.uint8)
        for j, i in enumerate(rows):
            out[j, :sizes[i]] = known[i]
        yield rows, out


def _block_costs(codes: Column) -> Column:
    """Matrix (16 costs, by state behind, then state before) and illegal neighbours inside every block."""

    def run(column: pa.Array) -> pa.Array:
        costs, bad = np.zeros((len(column), 16), np.int64), np.zeros(len(column), np.int64)
        for rows, block in _padded(column):
            costs[rows] = matrices(block).reshape(len(rows), 16)
            bad[rows] = _illegal(block[:, :-1], block[:, 1:]).sum(axis=1)
        at = np.arange(len(column) + 1, dtype=np.int32) * 16
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(costs.reshape(-1))), pa.array(bad)],
                                          ["costs", "illegal"])

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<costs: array<bigint>, illegal: bigint>")(codes)


def _illegal(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of these codes may not follow one another: only su, ua and au may."""
    pair = (left & 3).astype(int) * 4 + (right & 3)
    return ~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]) & (right != PAD) & (left != PAD)


def _block_walks(codes: Column, end: Column) -> Column:
    """Of every block, for each state before it: the steps of its rows and the state behind it."""

    def run(column: pa.Array, ends: pa.Array) -> pa.Array:
        vectors = np.array(ends.to_pylist(), np.int64).reshape(-1, 4)
        steps, states = [None] * len(column), [None] * len(column)
        for rows, block in _padded(column):
            taken, state = walks(block, vectors[rows])
            for j, i in enumerate(rows):
                real = block[j] != PAD
                steps[i] = [taken[j, real, s].tobytes() for s in range(4)]
                states[i] = state[j].tolist()
        return pa.StructArray.from_arrays([pa.array(steps, pa.list_(pa.binary())), pa.array(states, pa.list_(pa.int64()))],
                                          ["steps", "states"])

    run.__annotations__ = {"column": pa.Array, "ends": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<steps: array<binary>, states: array<bigint>>")(codes, end)


CHECKED = "none boolean, conv bigint, block bigint, codes binary, illegal bigint, end array<bigint>, cost bigint"


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from last to first: the vector at each one's end, the cost at the
    first one's beginning, and whether the neighbours across each border may follow one another."""
    key, vector, behind = None, None, PAD
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if key != (row["none"], row["conv"]):
                key, vector, behind = (row["none"], row["conv"]), END, PAD
            codes = row["codes"]
            bad = int(_illegal(np.array([codes[-1]]), np.array([behind]))[0])
            end, behind = vector, codes[0]
            vector = np.minimum((np.array(row["costs"]).reshape(4, 4) + vector[:, None]).min(axis=0), FAR)
            out.append({"none": row["none"], "conv": row["conv"], "block": row["block"], "codes": codes,
                        "illegal": row["illegal"] + bad, "end": end.tolist(),
                        "cost": int(vector[0]) if row["block"] == 0 else None})
        yield pa.RecordBatch.from_pylist(out, schema=_CHECKED_TYPE)


_CHECKED_TYPE = pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()),
                           ("illegal", pa.int64()), ("end", pa.list_(pa.int64())), ("cost", pa.int64())])
REPAIRED = "none boolean, conv bigint, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, each block's walks followed by its rows: the letters of all edits and the digest."""

    class Conversation:
        def __init__(self, key):
            self.key, self.state, self.audit, self.digest, self.some = key, 0, [], hashlib.sha256(), False
            self.steps, self.at = b"", 0

        def say(self, role: str, text: str) -> None:
            self.digest.update((("\n" if self.some else "") + role + ":" + text).encode())
            self.some = True

        def insert(self) -> None:
            self.say(DUE_ROLE[self.state], "")
            self.state = int(DUE[self.state])

        def block(self, steps: list[bytes]) -> None:
            self.steps, self.at = steps[self.state], 0
            self.audit.append("".join(STEPS[x] for x in self.steps))

        def row(self, role: str, text: str) -> None:
            inserts, move = divmod(self.steps[self.at], 3)
            self.at += 1
            for _ in range(inserts):
                self.insert()
            if move == 1:
                self.say(role, text)
                self.state = int(KEEP[INITIALS.index(role[0]), self.state])
            elif move == 2:
                self.say(DUE_ROLE[self.state], text)
                self.state = int(DUE[self.state])

        def end(self) -> dict:
            while END[self.state]:
                self.audit.append("I")
                self.insert()
            return {"none": self.key[0], "conv": self.key[1], "audit": "".join(self.audit),
                    "repaired_sha256": self.digest.hexdigest()}

    now, schema = None, pa.schema([("none", pa.bool_()), ("conv", pa.int64()), ("audit", pa.string()),
                                   ("repaired_sha256", pa.string())])
    for batch in batches:
        done = []
        for none, conv, steps, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if now is None or now.key != (none, conv):
                done += [now.end()] if now else []
                now = Conversation((none, conv))
            if steps is not None:
                now.block(steps)
            else:
                now.row(role, text)
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if now:
        yield pa.RecordBatch.from_pylist([now.end()], schema=schema)


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per conversation: conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are ordered by turn, nulls first, and by the digest of role and text where turns tie.  A null
    role or text is one blank.  Rows without a conversation form the conversation null.
    Repeated rows are duplicates of one another; a text of any length is one row; other columns are
    not read; an empty table gives an empty table.  A role other than system, user and assistant by
    its first letter (s, u, a) may not stay.
    """
    said = turns.select(F.col(conversation).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    said = said.withColumn("digest", turn_digest(F.col("role"), F.col("text")))
    rows = stored(numbered(said, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")], "pos", "op13-order")
                  .withColumn("none", F.col("conv").isNull()), "op13-rows")
    # The first of equal rows, as places: a place has one row, so a hot text does not meet itself.
    first = rows.groupBy("none", "conv", "digest").agg(F.min("pos").alias("pos")).select(
        F.col("none").alias("none_"), F.col("conv").alias("conv_"), F.col("pos").alias("pos_"))
    blank = ~F.col("text").rlike(WORD)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    facts = rows.select("none", "conv", "pos", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
                        (~blank & ~last.isin(".", "!", "?")).alias("open"))
    same = [F.col("none") == F.col("none_"), F.col("conv").eqNullSafe(F.col("conv_")), F.col("pos") == F.col("pos_")]
    facts = facts.join(first, same[0] & same[1] & same[2], "left").withColumn(
        "duplicate", ~F.col("blank") & F.col("pos_").isNull())
    facts = facts.withColumn("truncated", F.col("open") & ~F.col("duplicate"))
    code = coded(F.col("initial"), F.col("blank") | F.col("duplicate"), F.col("truncated"))
    byte = F.struct("pos", F.lpad(F.hex(code), 2, "0").alias("code"))
    ordered = F.array_sort(F.collect_list(byte))
    sums = ("blank", "duplicate", "truncated")
    blocks = stored(facts.groupBy("none", "conv", F.expr(f"(pos - 1) div {BLOCK}").alias("block")).agg(
        F.unhex(F.array_join(F.transform(ordered, lambda x: x["code"]), "")).alias("codes"),
        *[F.sum(F.col(x).cast("bigint")).alias(x) for x in sums]), "op13-blocks")

    costs = blocks.select("none", "conv", "block", "codes", _block_costs(F.col("codes")).alias("m")).select(
        "none", "conv", "block", "codes", "m.*")
    checked = stored(costs.repartition("none", "conv").sortWithinPartitions("none", "conv", F.desc("block"))
                     .mapInArrow(_checkpoints, CHECKED), "op13-checked")
    walked = checked.select("none", "conv", "block", _block_walks(F.col("codes"), F.col("end")).alias("w"))
    stream = walked.select("none", "conv", "block", F.lit(0).cast("bigint").alias("pos"), F.col("w.steps").alias("steps"),
                           F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")
                           ).unionByName(rows.select("none", "conv", F.expr(f"(pos - 1) div {BLOCK}").alias("block"),
                                                     "pos", F.lit(None).cast("array<binary>").alias("steps"), "role",
                                                     "text"))
    done = (stream.repartition("none", "conv").sortWithinPartitions("none", "conv", "block", "pos")
            .select("none", "conv", "steps", "role", "text").mapInArrow(_repaired, REPAIRED))
    counts = blocks.groupBy("none", "conv").agg(*[F.sum(x).alias(x) for x in sums])
    found = checked.groupBy("none", "conv").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    out = counts
    for other in (found, done):
        other = other.withColumnRenamed("none", "none_").withColumnRenamed("conv", "conv_")
        out = out.join(other, same[0] & same[1]).drop("none_", "conv_")
    return out.select("conv", *sums, "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Contract of op13: the rows after damage by crc32(conv_id:turn) % 20; nulls are one blank."""
    key = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")])
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), kind).where("kind <> 0")
    said = said.withColumn("text", F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).withColumn(
        "role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return said.withColumn("copy", F.explode(copies)).drop("copy", "kind")


def repair_report(turns: DataFrame) -> DataFrame:
    """Contract of op13: one row per original conversation after damage and repair."""
    rows = damaged(turns)
    seen = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy(F.col("conv_id").alias("of")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    every = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    done = every.join(repair(rows), F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        seen, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
            for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
