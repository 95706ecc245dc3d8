"""Conversation prefix trie (operator 11).

Every distinct sequence of first turns is a node.  Conversations are cut into
blocks of ``BLOCK`` turns; a block carries the name of all turns before it and
one name a turn, so a row is bounded however long its conversation is.  Equal
blocks after equal turns form one class.  The classes are sorted by range, and
each run of sorted classes grows a forest: the common prefixes (LCP) of sorted
neighbours are edges, taken in descending depth by union-find; every merge of
components makes a branching node, and the depths between two merges make the
chain of nodes with the same members.

What lies inside a run is settled there.  Only the nodes on the path of a run's first or
last class, and those with deeper blocks below, may have members elsewhere: these
contracted forests meet by node, and each seam between two runs adds the one LCP edge
that no run has seen.  Sums over subtrees follow from the edges: members share the
first words of a node, so what a node's subtree saves is, over its edges, the words
up to the edge less those before the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import stored
from carelake.llm.turns import WORD, numbered, turn_digest

BLOCK = 64
RUN_ROWS = 1 << 15  # classes whose forest is grown at once
ID_RANGE = 4096  # ids of one piece of a node's list of ended conversations
NODE = ("a bigint, b bigint, up_a bigint, up_b bigint, depth bigint, conv bigint, up_conv bigint, n_convs bigint, "
        "n_children bigint, n_leaves bigint, saved bigint, deep_conv bigint, deep_saved bigint, deep_leaves bigint")
SIDE = ("struct<a0: bigint, b0: bigint, depth0: bigint, words0: bigint, path: array<bigint>, words: array<bigint>, "
        "ended: boolean>")
NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]
SIDE_TYPE = pa.struct([*((x, pa.int64()) for x in ("a0", "b0", "depth0", "words0")), ("path", pa.list_(pa.int64())),
                       ("words", pa.list_(pa.int64())), ("ended", pa.bool_())])


def sequences(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv, pos, digest, words): every turn's number from 1, its name and its words.

    Turns are ordered by number, nulls first, and by name where numbers tie; a null
    role or text is empty; rows without a conversation belong to none and are left out.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    named = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        turn_digest(role_, text_).alias("digest"), F.regexp_count(text_, F.lit(WORD)).cast("bigint").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    return numbered(named, "conv", order, "pos", "op11-turns").select("conv", "pos", "digest", "words")


def _blocks(seq: DataFrame, members: DataFrame) -> DataFrame:
    """One row per conversation and ``BLOCK`` turns (one empty row for a conversation without
    turns): the names (a, b) of all turns before and up to the block's end, and the turns."""
    lanes = seq.select("conv", F.expr(f"(pos - 1) div {BLOCK}").alias("block"), F.struct(
        "pos", F.xxhash64("pos", "digest").alias("a"), F.xxhash64("digest", "pos", F.lit("b")).alias("b"),
        "words").alias("t"))
    cut = lanes.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list("t")).alias("turns"), F.bit_xor("t.a").alias("xa"), F.bit_xor("t.b").alias("xb"),
        F.sum("t.words").alias("xw"))
    in_order = Window.partitionBy("conv").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    cut = cut.select(
        "conv", "block", "turns", "xa", "xb", F.coalesce(F.bit_xor("xa").over(before), zero).alias("a0"),
        F.coalesce(F.bit_xor("xb").over(before), zero).alias("b0"),
        F.coalesce(F.sum("xw").over(before), zero).alias("words0"),
        F.lead("block").over(in_order).isNotNull().alias("goes_on"))
    every = members.select("conv").join(cut, "conv", "left")
    turns = F.coalesce("turns", F.array().cast("array<struct<pos: bigint, a: bigint, b: bigint, words: bigint>>"))
    return every.select(
        "conv", F.coalesce(F.col("block") * BLOCK, zero).alias("depth0"), F.coalesce("words0", zero).alias("words0"),
        F.coalesce("a0", zero).alias("a0"), F.coalesce("b0", zero).alias("b0"),
        F.coalesce(F.col("a0").bitwiseXOR(F.col("xa")), zero).alias("a1"),
        F.coalesce(F.col("b0").bitwiseXOR(F.col("xb")), zero).alias("b1"),
        F.coalesce("goes_on", F.lit(False)).alias("goes_on"),
        F.flatten(F.transform(turns, lambda t: F.array(t["a"], t["b"]))).alias("path"),
        F.transform(turns, lambda t: t["words"]).alias("words"))


class _Run:
    """A run of sorted classes: names and word counts of every prefix, and the LCP edges.

    ``at_a[i, d]``, ``at_b[i, d]``: the node of class i at depth d of its block;
    ``upto[i, d]``: its words up to there.  ``lcp[i]``: turns that class i shares with
    the one before; -1 where another group (or the run) begins, also behind the last.
    """

    def __init__(self, table: pa.Table):
        def column(name):
            return table.column(name).to_numpy()

        self.a0, self.b0, self.depth0, self.words0 = (column(x) for x in ("a0", "b0", "depth0", "words0"))
        self.conv, self.convs, self.goes_on = column("conv"), column("convs"), column("goes_on").astype(bool)
        paths = table.column("path").combine_chunks()
        at = paths.offsets.to_numpy().astype(np.int64) // 2
        self.size = np.diff(at)
        lanes = paths.values.to_numpy()[2 * at[0]:2 * at[-1]].reshape(-1, 2)
        words = table.column("words").combine_chunks().flatten().to_numpy()
        m, most = len(self.size), int(self.size.max())
        row = np.repeat(np.arange(m), self.size)
        col = np.arange(len(row)) - np.repeat(at[:-1] - at[0], self.size)
        a, b, w = (np.zeros((m, most + 1), np.int64) for _ in range(3))
        a[row, col + 1], b[row, col + 1], w[row, col + 1] = lanes[:, 0], lanes[:, 1], words
        there = np.arange(1, most + 1) <= np.minimum(self.size[1:], self.size[:-1])[:, None]
        equal = (a[1:, 1:] == a[:-1, 1:]) & (b[1:, 1:] == b[:-1, 1:]) & there
        self.lcp = np.full(m + 1, -1, np.int64)
        group = (self.a0[1:] == self.a0[:-1]) & (self.b0[1:] == self.b0[:-1])
        self.lcp[1:m] = np.where(group, np.logical_and.accumulate(equal, axis=1).sum(axis=1), -1)
        a[:, 0], b[:, 0], w[:, 0] = self.a0, self.b0, self.words0
        self.at_a, self.at_b = np.bitwise_xor.accumulate(a, axis=1), np.bitwise_xor.accumulate(b, axis=1)
        self.upto = np.cumsum(w, axis=1)

    def merges(self) -> dict[str, np.ndarray]:
        """Components of the descending union-find: rows first..last, depths above..depth
        (exclusive, inclusive), smallest member, edges at that depth and the component that it joins next."""
        m, lcp = len(self.size), self.lcp
        root, first, last = list(range(m)), list(range(m)), list(range(m))
        least, chain = self.conv.tolist(), list(range(m))
        made = [(i, i, d, c, 0) for i, (d, c) in enumerate(zip(self.size.tolist(), least))]
        joins = [-1] * m

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges = np.flatnonzero(lcp[:m] >= 0)
        edges = edges[np.argsort(-lcp[edges], kind="stable")]
        cuts = np.flatnonzero(np.diff(lcp[edges])) + 1
        for level in np.split(edges, cuts) if len(edges) else []:
            old, count = [], {}
            for i in level.tolist():
                x, y = find(i - 1), find(i)
                old += [(chain[x], first[x]), (chain[y], first[y])]
                if last[x] - first[x] < last[y] - first[y]:
                    x, y = y, x
                root[y] = x
                first[x], last[x] = min(first[x], first[y]), max(last[x], last[y])
                least[x] = min(least[x], least[y])
                count[x] = count.pop(x, 0) + count.pop(y, 0) + 1
            depth = int(lcp[level[0]])
            for x, n in count.items():
                chain[x] = len(made)
                made.append((first[x], last[x], depth, least[x], n))
                joins.append(-1)
            for one, row in old:
                joins[one] = chain[find(row)]
        found = dict(zip(("first", "last", "depth", "least", "edges"), np.array(made, np.int64).T))
        found["joins"] = np.array(joins, np.int64)
        found["above"] = np.maximum(lcp[found["first"]], lcp[found["last"] + 1])
        return found

    def nodes(self) -> pa.RecordBatch:
        """Every node that has members in the run, with what the run knows of it."""
        c, m = self.merges(), len(self.size)
        first, last, depth, above = c["first"], c["last"], c["depth"], c["above"]
        leaf = (~(self.goes_on | (self.lcp[1:] == self.size))).astype(np.int64)
        copies = (self.convs - 1) * self.upto[np.arange(m), self.size]
        edge = np.where(self.lcp[:m] >= 0, self.upto[np.arange(m), np.maximum(self.lcp[:m], 0)], 0)

        def within(values: np.ndarray, lo: np.ndarray = first) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[last + 1] - total[lo]

        members, leaves, words = within(self.convs), within(leaf), within(copies) + within(edge, first + 1)
        open_ = (first == 0) | (last == m - 1) | (within(self.goes_on.astype(np.int64)) > 0)
        branch = c["edges"] + 1 - (self.size[first] == depth)

        size = np.maximum(depth - above, 0)
        of = np.repeat(np.arange(len(size)), size)
        d = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + above[of] + 1
        row, up = first[of], np.maximum(d - 1, 0)
        bottom = d == 0  # the group's own root
        deep = bottom & (self.depth0[row] > 0)  # a node that ends a block elsewhere
        saved = words[of] - (members[of] - 1) * self.upto[row, up]
        edge_open = open_[of] | deep
        top = d == above[of] + 1
        parent = np.where(top, c["joins"][of], of)
        up_open = open_[parent] | ((d == 1) & (self.depth0[row] > 0))
        no = np.zeros(len(of), bool)
        columns = {
            "a": (self.at_a[row, d], no), "b": (self.at_b[row, d], no),
            "up_a": (self.at_a[row, up], bottom), "up_b": (self.at_b[row, up], bottom),
            "depth": (self.depth0[row] + d, no), "conv": (c["least"][of], deep),
            "up_conv": (c["least"][parent], bottom | up_open), "n_convs": (np.where(deep, 0, members[of]), no),
            "n_children": (np.where(d < depth[of], 1, branch[of]), no),
            "n_leaves": (np.where(deep, 0, leaves[of]), no), "saved": (np.where(deep, 0, saved), no),
            "deep_conv": (c["least"][of], ~deep), "deep_saved": (saved, ~deep), "deep_leaves": (leaves[of], ~deep)}
        arrays = [pa.array(columns[x][0], pa.int64(), mask=columns[x][1]) for x in NODE_NAMES]
        n = len(of)
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(edge_open), pa.nulls(n, pa.int64()), pa.nulls(n, SIDE_TYPE), pa.nulls(n, SIDE_TYPE)],
            [*NODE_NAMES, "open", "run", "head", "tail"])

    def side(self, table: pa.Table, i: int) -> dict:
        row = table.slice(i, 1).to_pylist()[0]
        return {x: row[x] for x in ("a0", "b0", "depth0", "words0", "path", "words")} | {"ended": not row["goes_on"]}


def _forests(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[pa.RecordBatch]:
    """The nodes of every run of a range, and its first and last class."""
    from pyspark import TaskContext

    run = TaskContext.get().partitionId() << 32

    def grown(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal run
        table = pa.Table.from_batches(rows)
        own = _Run(table)
        yield own.nodes()
        head, tail = own.side(table, 0), own.side(table, len(table) - 1)
        empty = [pa.nulls(1, pa.int64())] * len(NODE_NAMES)
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.nulls(1, pa.bool_()), pa.array([run], pa.int64()), pa.array([head], SIDE_TYPE),
             pa.array([tail], SIDE_TYPE)], [*NODE_NAMES, "open", "run", "head", "tail"])
        run += 1

    held, count = [], 0
    for batch in batches:
        held, count = held + [batch], count + len(batch)
        if count >= run_rows:
            yield from grown(held)
            held, count = [], 0
    if count:
        yield from grown(held)


def _rows_of(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in found], pa.int64()) for k in NODE_NAMES], NODE_NAMES)


def _path(side: dict) -> tuple[list, list]:
    """Nodes of a class from its block's beginning, and its words up to each."""
    nodes, upto = [(side["a0"], side["b0"])], [side["words0"]]
    for a, b, w in zip(side["path"][::2], side["path"][1::2], side["words"]):
        nodes.append((nodes[-1][0] ^ a, nodes[-1][1] ^ b))
        upto.append(upto[-1] + w)
    return nodes, upto


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the LCP edge between two runs adds to the nodes on it."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            tail, head = row["tail"], row["head"]
            if (tail["a0"], tail["b0"]) != (head["a0"], head["b0"]):
                continue
            nodes, upto = _path(tail)
            lcp = 0
            for x, y in zip(nodes[1:], _path(head)[0][1:]):
                if x != y:
                    break
                lcp += 1
            leaf = -1 if tail["ended"] and lcp == len(nodes) - 1 else 0
            for d in range(lcp + 1):
                saved = upto[lcp] - upto[max(d - 1, 0)]
                own = {"a": nodes[d][0], "b": nodes[d][1], "n_convs": 0, "n_children": -int(d < lcp), "n_leaves": 0,
                       "saved": 0}
                if d == 0 and tail["depth0"]:
                    own |= {"deep_saved": saved, "deep_leaves": leaf}
                else:
                    own |= {"saved": saved, "n_leaves": leaf}
                found.append(own)
        yield _rows_of(found)


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the blocks below a class add to its nodes."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            nodes, _ = _path(row)
            for a, b in nodes[1 if row["depth0"] else 0:]:
                found.append({"a": a, "b": b, "n_convs": 0, "n_children": 0, "n_leaves": row["deep_leaves"],
                              "saved": row["deep_saved"]})
        yield _rows_of(found)


def _merged(rows: DataFrame) -> DataFrame:
    sums = ("n_convs", "n_children", "n_leaves", "saved", "deep_saved", "deep_leaves")
    return rows.groupBy("a", "b").agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.max("depth").alias("depth"),
        F.min("conv").alias("conv"), F.min("deep_conv").alias("deep_conv"), *[F.sum(x).alias(x) for x in sums])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of every node, which arrive in order."""
    def out(key, digest):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()),
                                           pa.array([digest.hexdigest()])], ["a", "b", "ends_sha256"])

    key = digest = None
    for batch in batches:
        for a, b, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if key == (a, b):
                digest.update(b"," + piece.encode())
                continue
            if key:
                yield out(key, digest)
            key, digest = (a, b), hashlib.sha256(piece.encode())
    if key:
        yield out(key, digest)


def _ended(blocks: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes at which conversations end.  Ids are joined in
    pieces of an id range first; a node's pieces pass one task as a stream, because
    SHA-256 takes them in order."""
    ids = F.array_sort(F.collect_list("conv"))
    pieces = blocks.where(~F.col("goes_on")).groupBy(
        F.col("a1").alias("a"), F.col("b1").alias("b"), F.expr(f"conv div {ID_RANGE}").alias("piece")).agg(
        F.min("conv").alias("low"), F.array_join(ids.cast("array<string>"), ",").alias("ids"))
    return (pieces.repartition("a", "b").sortWithinPartitions("a", "b", "low").select("a", "b", "ids")
            .mapInArrow(_digests, "a bigint, b bigint, ends_sha256 string"))


def trie(seq: DataFrame, members: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """The trie of ``members`` (conv) over their turns ``seq`` (conv, pos from 1 without gaps, digest, words).

    One row per node: conv (smallest member), depth, up_conv (that of its parent, null for the root),
    n_convs, n_children, n_leaves, saved (words that storing the subtree's nodes once
    spares) and ends_sha256.  Without members there is no node.
    """
    blocks = stored(_blocks(seq, members), "op11-blocks")
    classes = blocks.groupBy("a0", "b0", "a1", "b1", "depth0", "words0").agg(
        F.first("path").alias("path"), F.first("words").alias("words"), F.min("conv").alias("conv"),
        F.count("*").alias("convs"), F.max("goes_on").alias("goes_on"))
    order = ["a0", "b0", "path"]
    forest = stored(classes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        partial(_forests, run_rows=run_rows), f"{NODE}, open boolean, run bigint, head {SIDE}, tail {SIDE}"), "op11-forest")
    # One row per run; a run holds run_rows classes or is the rest of a partition.
    runs = forest.where("run is not null").select(
        "tail", F.lead("head").over(Window.orderBy("run")).alias("head")).where("head is not null")
    nodes = forest.where("run is null").drop("run", "head", "tail")
    shared = nodes.where("open").drop("open").unionByName(runs.mapInArrow(_seams, NODE))

    if not blocks.where("depth0 > 0").isEmpty():
        roots = stored(_merged(shared).where("deep_conv is not null").select(
            F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("deep_conv").alias("conv"), "deep_saved",
            "deep_leaves"), "op11-roots")
        # A group's sums count for all groups on the way of its smallest conversation.
        way = Window.partitionBy("conv").orderBy(F.desc("depth0")).rowsBetween(Window.unboundedPreceding, 0)
        sums = [F.sum(F.coalesce(x, F.lit(0))).over(way).alias(x) for x in ("deep_saved", "deep_leaves")]
        under = (blocks.where("depth0 > 0").select("conv", "a0", "b0", "depth0").join(roots, ["conv", "a0", "b0"], "left")
                 .select("a0", "b0", *sums).groupBy(F.col("a0").alias("a1"), F.col("b0").alias("b1"))
                 .agg(F.sum("deep_saved").alias("deep_saved"), F.sum("deep_leaves").alias("deep_leaves")))
        shared = shared.unionByName(classes.where("goes_on").join(under, ["a1", "b1"]).select(
            "a0", "b0", "depth0", "words0", "path", "words", "deep_saved", "deep_leaves").mapInArrow(_below, NODE))

    merged = stored(_merged(shared), "op11-merged")
    heads = merged.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("known"))
    keep = ["a", "b", "depth", "conv", "n_convs", "n_children", "n_leaves", "saved"]
    inner = nodes.where("not open")
    waiting = inner.where("up_conv is null").select(*keep, "up_a", "up_b").unionByName(
        merged.select(*keep, "up_a", "up_b"))
    every = waiting.join(heads, ["up_a", "up_b"], "left").select(*keep, F.col("known").alias("up_conv")).unionByName(
        inner.where("up_conv is not null").select(*keep, "up_conv"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(_ended(blocks), ["a", "b"], "left").select(
        "conv", "depth", "up_conv", "n_convs", "n_children", "n_leaves", "saved",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """The trie of a table's conversations as they are; see ``sequences`` for nulls and ties,
    ``trie`` for the columns.  Repeated rows are repeated turns, a text of any length is one turn, other
    columns are not read, an empty table gives no node."""
    seq = stored(sequences(turns, conversation, turn, role, text), "op11-sequences")
    return trie(seq, seq.select("conv").distinct())


def rebuilt(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract of op11: the turns and members of the rebuilt conversations.  Conversation c begins with the
    first h turns of c - c % 20 and goes on with its own after its first h; h = crc32(c) % 4."""
    base = F.col("conv") - F.col("conv") % 20
    heads = seq.where("conv % 20 = 0 and pos <= 3").groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    members = seq.select("conv").distinct().select(
        "conv", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int").alias("h"))
    none = F.array().cast("array<struct<pos: bigint, digest: string, words: bigint>>")
    members = members.join(heads, "base", "left").withColumn("head", F.coalesce("head", none)).select(
        "conv", "h", F.slice("head", F.lit(1), F.col("h")).alias("head"))
    front = members.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    own = seq.join(members.select("conv", "h", F.size("head").alias("taken")), "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    return front.unionByName(own), members.select("conv")


def trie_report(turns: DataFrame) -> DataFrame:
    """Contract of op11: one row per node of the rebuilt conversations."""
    seq = stored(sequences(turns), "op11-sequences")
    return trie(*rebuilt(seq)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
