"""N-gram Jaccard join with PartEnum signatures (operator 3).

Two texts link when their sets of distinct word shingles overlap by the asked
Jaccard share.  Sets are cut into size bands; within the sizes of a band a
linked pair differs in at most k elements.  The element domain is cut into more
than k parts by hash, so a linked pair agrees on whole parts, and each
enumerated subset of parts gives one signature (a hash of the set's elements in
it): sets that may link share a signature, sets far apart practically never do.

* k = 0: only equal sets link; they are one class and need no signature.
* k <= ``PAIRED_K``: k + 2 parts, one signature for every two parts.
* above: k + 1 + m parts, one signature a part.  A part may be empty in a set;
  as m spare parts agree as well, sets with at most m empty parts leave their
  empty signatures out, and only sets with more of them emit those too.
* A set near the next band is a guest there.  Two guests meet in their own band, so
  buckets of guests alone are dropped and two guests of a bucket are not compared.

Equal sets form classes first (two 64-bit names; sets that share only the first
one are told apart).  Each class is then checked against one other: of the
smallest buckets' hubs, the classes that meet most others, the busiest.  Around an
original that is in the table this links its copies in one step, a pair a class.  What
remains are buckets that still hold several components.  There the classes of different
components are compared by sketches (an exact lower bound of the difference) inside
the bucket's blocks, in numpy, and every class names only its nearest candidates; these
pairs are checked, components merge, and the next round names eight times as many,
until no class holds back any.  So no link between different components is lost, and
neither copies nor buckets are ever expanded into pairs.  A pair links only
by comparing the words of the two texts' shingles.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import U64, Words, components, mix, spare_name, stored, text_udf, windows

SHINGLE_WORDS = 3
MIN_PERCENT = 90
PAIRED_K = 5
BAND_RATIO = 1.25
SKETCH_LONGS = 8
MAX_SET = 1 << 40
BLOCK = 4096  # classes of a bucket that are compared at once
FIRST_NEAREST, MORE_NEAREST = 1, 8


def max_difference(total: int, percent: int) -> int:
    """Most elements in which linked sets with ``total`` elements together differ."""
    return total * (100 - percent) // (100 + percent)


@lru_cache
def bands(percent: int) -> tuple[int, ...]:
    """First size of every band.  The first band holds the sizes at which only
    equal sets link; the others are wide enough that linked sets lie in the same
    or in neighbouring bands."""
    first = 1
    while max_difference(2 * first + 1, percent) == 0:
        first += 1
    starts, ratio = [1, first + 1], max(BAND_RATIO, 100 / percent)
    while starts[-1] < MAX_SET:
        starts.append(max(starts[-1] + 1, int(np.ceil(starts[-1] * ratio))))
    return tuple(starts)


@lru_cache
def scheme(band: int, percent: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Parts, spare parts, cuts of the domain, subsets (pairs of parts or single ones) and their tags."""
    k = max_difference(2 * (bands(percent)[band + 1] - 1), percent)
    smallest, spare = bands(percent)[band] * percent / 100, 1
    for _ in range(30):  # as many as the empty parts of nearly all sets of the band
        parts = k + 1 + spare
        empty = parts * np.exp(-smallest / parts)
        spare = min(1 + k // 4, int(np.ceil(1 + empty + 4 * empty ** 0.5)))
    parts = k + 2 if k <= PAIRED_K else k + 1 + spare
    subsets = np.array(list(combinations(range(parts), 2)) if k <= PAIRED_K else [(i, i) for i in range(parts)])
    cuts = np.array([-(-(i << 64) // parts) for i in range(1, parts)], U64)
    tags = mix(np.arange(len(subsets), dtype=U64) + U64(band << 40))
    return parts, spare if k > PAIRED_K else parts, cuts, subsets, tags


def shingle_sets(texts: pa.Array, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text (A-Z lower-cased)."""
    w = Words(texts, lower=True)
    rolled = windows(w.hashes, n)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        out.append(np.unique(rolled[a:b - n + 1]) if b - a >= n else windows(w.hashes[a:b], max(1, b - a)))
    return out


def banded_signatures(elements: np.ndarray, percent: int) -> list[tuple[bool, np.ndarray]]:
    """PartEnum signatures of one sorted set by band, and whether the set is a guest there."""
    starts, size = bands(percent), len(elements)
    band = int(np.searchsorted(starts, size, "right")) - 1
    own = [band] if band else []
    if 100 * size >= percent * starts[band + 1]:
        own.append(band + 1)
    sums = np.zeros(size + 1, U64)
    np.cumsum(mix(elements + U64(0xA0761D6478BD642F)), out=sums[1:])
    out = []
    for b in own:
        parts, spare, cuts, subsets, tags = scheme(b, percent)
        at = np.concatenate([[0], np.searchsorted(elements, cuts), [size]])
        part, full = sums[at[1:]] - sums[at[:-1]], np.diff(at) > 0
        if subsets[0, 0] != subsets[0, 1]:
            signs = mix(part[subsets[:, 0]] + part[subsets[:, 1]] + tags)
        else:
            signs = mix(part + tags)
            signs = signs if parts - full.sum() > spare else signs[full]
        out.append((b > band, signs))
    return out


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of one sorted set."""
    return np.concatenate([np.zeros(0, U64), *(s for _, s in banded_signatures(elements, percent))])


def _marked(elements: np.ndarray, percent: int) -> np.ndarray:
    """The signatures, whose lowest bit tells whether the set is a guest."""
    return np.concatenate([np.zeros(0, U64), *(s & ~U64(1) | U64(g) for g, s in banded_signatures(elements, percent))])


def _sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements in 64 * SKETCH_LONGS cells; sets differ in at least as many elements as cells."""
    cell = (mix(elements) >> U64(32)).astype(np.int64) % (64 * SKETCH_LONGS)
    odd = (np.bincount(cell, minlength=64 * SKETCH_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def _wide_sketch(elements: np.ndarray, percent: int) -> bytes:
    """Parities in four cells or more for each element in which a linked set may differ: as tight for long sets."""
    most = max(16, max_difference(len(elements) + len(elements) * 100 // percent, percent))
    cells = 1 << (4 * most - 1).bit_length()
    odd = np.bincount((mix(elements + U64(1)) & U64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_link(percent: int):
    """Whether sizes and wide sketches allow a link: sets differ in at least as many elements as cells."""

    def run(left: pa.Array, n_left: pa.Array, right: pa.Array, n_right: pa.Array) -> pa.Array:
        out = []
        for x, n, y, m in zip(*(c.to_pylist() for c in (left, n_left, right, n_right))):
            ok = 100 * min(n, m) >= percent * max(n, m)
            if ok:
                x, y = sorted((np.frombuffer(z, np.uint8) for z in (x, y)), key=len)
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # cells are the low bits: halves fold
                ok = (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * (n + m)
            out.append(ok)
        return pa.array(out, pa.bool_())

    run.__annotations__ = dict.fromkeys(("left", "n_left", "right", "n_right", "return"), pa.Array)
    return F.arrow_udf(run, "boolean")


NAME_SCHEMA = "struct<n_shingles: bigint, node: bigint, other: bigint"
SET_SCHEMA = NAME_SCHEMA + ", wide: binary, " + ", ".join(f"p{i}: bigint" for i in range(SKETCH_LONGS)) + ">"
SIGN_SCHEMA = NAME_SCHEMA + ", signs: array<bigint>>"


def _names(sets: list[np.ndarray], node_bits: int) -> list[pa.Array]:
    """Size and two names of every set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    sums = np.array([[mix(s ^ U64(len(s))).sum(), mix(s + U64(0xC2B2AE3D27D4EB4F)).sum()] for s in sets],
                    U64).reshape(-1, 2)
    names = mix(sums) >> U64(64 - node_bits)
    return [pa.array(sizes), pa.array(names[:, 0].view(np.int64), mask=sizes == 0), pa.array(mix(sums[:, 1]).view(np.int64))]


def _sketched(percent: int, words: int, node_bits: int):
    def run(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, words)
        cells = np.array([_sketch(s) for s in sets], np.int64).reshape(-1, SKETCH_LONGS)
        columns = [*_names(sets, node_bits), pa.array([_wide_sketch(s, percent) for s in sets], pa.binary()),
                   *(pa.array(np.ascontiguousarray(cells[:, i])) for i in range(SKETCH_LONGS))]
        return pa.StructArray.from_arrays(columns, ["n_shingles", "node", "other", "wide"]
                                          + [f"p{i}" for i in range(SKETCH_LONGS)])

    return text_udf(run, SET_SCHEMA)


def _signed(percent: int, words: int, node_bits: int):
    """Signatures, which are many: made where they are shuffled, never stored."""

    def run(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, words)
        signs = [_marked(s, percent) if len(s) else np.zeros(0, U64) for s in sets]
        at = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype(np.int32)
        flat = np.concatenate([*signs, np.zeros(0, U64)]).view(np.int64)
        return pa.StructArray.from_arrays([*_names(sets, node_bits), pa.ListArray.from_arrays(at, pa.array(flat))],
                                          ["n_shingles", "node", "other", "signs"])

    return text_udf(run, SIGN_SCHEMA)


def _shingles(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves: what a link is decided on."""
    own = text.encode().lower().split()  # bytes: A-Z alone are lowered, and cut is at ASCII white space
    return set(zip(*(own[i:] for i in range(words)))) if len(own) >= words else {tuple(own)} if own else set()


def similar(a: Column, b: Column, percent: int, words: int = SHINGLE_WORDS) -> Column:
    """Whether two texts link, from the words of their whole shingle sets."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, known = [], None, set()
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            if x != last:
                last, known = x, _shingles(x, words)
            other = _shingles(y, words)
            both = len(known & other)
            out.append(100 * both >= percent * (len(known) + len(other) - both))
        return pa.array(out, pa.bool_())

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "boolean").asNondeterministic()(a, b)


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int, label: str) -> DataFrame:
    """The pairs (a, b) of classes with ``ok``, whether they link: checked on the texts of their first documents,
    which only the pairs meet that wide sketches allow."""
    ends = [classes.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}"), F.col("n").alias(f"n_{x}"))
            .hint("merge") for x in "ab"]
    tried = stored(pairs.join(ends[0], "a").join(ends[1], "b").select(
        "a", "b", _may_link(percent)(F.col("wide_a"), F.col("n_a"), F.col("wide_b"), F.col("n_b")).alias("may")),
        f"{label}-tried")
    pairs = tried.where("may").select("a", "b")
    wanted = stored(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
                    .join(classes.select(F.col("node").alias("a"), "first.*"), "a")
                    .withColumnRenamed("a", "node"), f"{label}-wanted")
    texts = docs.join(wanted, docs["key"].eqNullSafe(wanted["doc"]) & (F.xxhash64(docs["text"]) == wanted["hash"]))
    # Texts are larger than their compressed size suggests: never broadcast them.
    texts = texts.groupBy("node").agg(F.first("text").alias("text")).hint("merge")
    checked = (pairs.join(texts.withColumnRenamed("node", "b").withColumnRenamed("text", "text_b"), "b")
               .join(texts.withColumnRenamed("node", "a").withColumnRenamed("text", "text_a"), "a"))
    checked = stored(checked.select("a", "b", similar(F.col("text_a"), F.col("text_b"), percent, words).alias("ok")), label)
    return checked.unionByName(tried.where("not may").select("a", "b", F.col("may").alias("ok")))


def nearest(group: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, side: np.ndarray,
            cells: np.ndarray, percent: int, most: int, guest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among rows of equal ``group`` (adjacent rows): for every row the ``most`` nearest by sketch.

    Only rows of different components whose sizes and sketches allow a link, not both of them
    guests, and of different sides where both sides of a block pair are given (side 0 alone: all of one block).
    Returns the candidates as two index arrays, and the rows that have more than that.
    """
    change = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    length = np.diff(np.append(change, len(group)))
    place = np.arange(len(group)) - np.repeat(change, length)
    left = np.repeat(length, length) - place  # rows of the group from this one on
    two = np.repeat(np.maximum.reduceat(side, change), length) > 0
    held = [np.zeros((3, 0), np.int64)]
    more = np.zeros(len(group), bool)
    guest = np.zeros(len(group), bool) if guest is None else guest

    def prune() -> None:
        """The nearest of every row, from both ends' view."""
        i, j, apart = np.concatenate(held, axis=1)
        ends, where = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
        order = np.lexsort((where, np.concatenate([apart, apart]), ends))
        ends, where = ends[order], where[order]
        first = np.searchsorted(ends, ends)
        kept = np.arange(len(ends)) - first < most
        more[ends[~kept]] = True
        use = np.unique(where[kept])
        held[:] = [np.stack([i[use], j[use], apart[use]])]

    active, d, count = np.flatnonzero(left > 1), 1, 0
    while len(active):
        i, j = active, active + d
        fits = (root[i] != root[j]) & ((side[i] != side[j]) | ~two[i]) & ~(guest[i] & guest[j])
        i, j = i[fits], j[fits]
        fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        apart = np.bitwise_count((cells[i] ^ cells[j]).view(U64)).sum(axis=1, dtype=np.int64)  # of signed ones: the absolute value's
        fits = (100 + percent) * apart <= (100 - percent) * (size[i] + size[j])
        held.append(np.stack([i[fits], j[fits], apart[fits]]))
        count += int(fits.sum())
        if count > 1 << 20:
            prune()
            count = 0
        d += 1
        active = active[left[active] > d]
    prune()
    return held[0][0], held[0][1], more


def _shared(batches):
    """Of rows (sign, node, guest) sorted by sign, guest and node, the distinct ones whose sign has several nodes, one
    of them no guest: two guests meet in their own band.  Without a third column none is a guest.  One row is held back."""
    names = ["sign", "node", "guest"]
    held, held_known, held_own = np.zeros((3, 0), np.int64), False, False

    def rows(of: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(of[0]), pa.array(of[1]), pa.array(of[2].astype(bool))], names)

    for batch in batches:
        guest = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else np.zeros(len(batch))
        both = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                                               guest.astype(np.int64)])], axis=1)
        known = np.zeros(both.shape[1], bool)  # the row before has the same sign
        known[:held.shape[1]] = held_known
        new = np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])
        both, known = both[:, new], known[new]
        same = both[0, 1:] == both[0, :-1]
        known[1:] |= same
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(both.shape[1]), 0))
        own = both[2, begin] == 0  # guests come last
        if held.shape[1]:
            own[begin == 0] = held_own
        keep = known.copy()
        keep[:-1] |= same
        yield rows(both[:, :-1][:, (keep & own)[:-1]])
        held, held_known, held_own = both[:, -1:], bool(known[-1]), bool(own[-1])
    if held_known and held_own:
        yield rows(held)


OPEN = ["sign", "part", "node", "root", "n", "side", "guest"] + [f"p{i}" for i in range(SKETCH_LONGS)]


def _candidates(percent: int, most: int):
    """Pairs (a, b) of whole groups of (sign, part), which arrive together; ``more`` marks a class with further ones."""
    names = ["a", "b", "more"]

    def found(table: pa.Table) -> pa.RecordBatch:
        column = {x: table.column(x).to_numpy(zero_copy_only=False) for x in OPEN}
        group = np.cumsum(np.concatenate([[0], (np.diff(column["sign"]) != 0) | (np.diff(column["part"]) != 0)]))
        cells = np.stack([column[f"p{i}"] for i in range(SKETCH_LONGS)], axis=1)
        i, j, more = nearest(group, column["node"], column["root"], column["n"], column["side"], cells, percent, most,
                             column["guest"])
        x, y = column["node"][i], column["node"][j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)),
                                           pa.array(more[i] | more[j])], names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held, rows = held + [batch], rows + len(batch)
            if rows < 4 * BLOCK:
                continue
            table = pa.Table.from_batches(held)
            sign, part = table.column("sign").to_numpy(), table.column("part").to_numpy()
            cut = np.flatnonzero((np.diff(sign) != 0) | (np.diff(part) != 0))
            if len(cut):
                yield found(table.slice(0, int(cut[-1]) + 1))
                table = table.slice(int(cut[-1]) + 1)
            held, rows = table.to_batches(), len(table)
        if rows:
            yield found(pa.Table.from_batches(held))

    return run


def similarity_groups(docs: DataFrame, percent: int = MIN_PERCENT, key: str = "doc_id", text: str = "text",
                      words: int = SHINGLE_WORDS, node_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: key, hash of the text, n_shingles, class and
    component (its smallest key), and whether the row represents its component.

    Texts without words, and null texts, link with nothing and are their own
    component.  Null keys come after all others: a component without any key has
    component null.  Repeated rows fall in one class; rows that tie in key and
    text share one fate.  Other columns are not read; an empty table gives an
    empty table.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    signed = stored(rows.select("key", F.xxhash64("text").alias("hash"),
                                _sketched(percent, words, node_bits)(F.col("text")).alias("s"))
                    .select("key", "hash", "s.*"), "op3-signed")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("doc"), F.col("hash").alias("hash"))

    def classed(of: DataFrame) -> DataFrame:
        return stored(of.where("n_shingles > 0").groupBy("node").agg(
            F.min(order).alias("first"), F.first("n_shingles").alias("n"), F.min("other").alias("low"),
            F.max("other").alias("high"), F.first("wide").alias("wide"), *[F.first(f"p{i}").alias(f"p{i}") for i in range(SKETCH_LONGS)]), "op3-classes")

    classes = classed(signed)
    signs = rows.select(_signed(percent, words, node_bits)(F.col("text")).alias("s")).select("s.*").where("n_shingles > 0")
    twins = classes.where("low <> high").select(F.col("node").alias("twin"))
    if not twins.isEmpty():  # different sets under one name get names from both

        def renamed(of: DataFrame) -> DataFrame:
            return of.join(twins, F.col("node") == F.col("twin"), "left").withColumn("node", F.when(
                F.col("twin").isNull(), F.col("node")).otherwise(F.xxhash64("node", "other"))).drop("twin")

        signed, signs = stored(renamed(signed), "op3-renamed"), renamed(signs)
        classes = classed(signed)
    signs = signs.select(F.explode("signs").alias("sign"), "node")
    # One shuffle of all signatures: neighbours in sorted order tell which ones are shared.
    members = stored(signs.repartition(F.shiftright("sign", 1)).sortWithinPartitions("sign", "node")
                     .select(F.shiftright("sign", 1).alias("sign"), "node", F.col("sign").bitwiseAND(1).alias("guest"))
                     .mapInArrow(_shared, "sign bigint, node bigint, guest boolean"), "op3-members")
    # Hubs: a class meets as many others as its buckets hold; a bucket's hub is its busiest class.
    filled = members.groupBy("sign").agg(F.count("*").alias("many"))
    met = members.hint("merge").join(filled.hint("merge"), "sign").groupBy("node").agg(F.sum("many").alias("met"))
    busy = members.hint("merge").join(met.hint("merge"), "node")
    hubs = busy.groupBy("sign").agg(F.max(F.struct("met", "node")).alias("hub"))
    star = members.hint("merge").join(hubs.hint("merge"), "sign").where(F.col("hub.node") != F.col("node"))
    star = star.groupBy("node").agg(F.max("hub").alias("hub")).select(
        F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    seen = _linked(stored(star, "op3-star"), classes, rows, percent, words, "op3-first")
    roots = components(seen.where("ok").select("a", "b"), "op3-roots")

    # What is left: buckets that hold several components, in blocks of about BLOCK classes.
    cells = [f"p{i}" for i in range(SKETCH_LONGS)]
    most = FIRST_NEAREST
    while True:
        rooted = members.hint("merge").join(roots.hint("merge"), "node", "left").select(
            "sign", "node", "guest", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("sign").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                           F.count("*").alias("many")).where("low < high")
        open_ = rooted.join(mixed.select("sign", F.expr(f"(many - 1) div {BLOCK} + 1").alias("blocks")).hint("merge"),
                            "sign").join(classes.select("node", "n", *cells).hint("merge"), "node")
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        # Block i meets block j under one part number, as side 0 (the smaller) or 1.
        parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.struct(
            (F.least(own, j) * F.col("blocks") + F.greatest(own, j)).alias("part"), (own > j).cast("int").alias("side")))
        dealt = open_.select("sign", "node", "root", "n", "guest", *cells, F.explode(parts).alias("p")).select(
            "sign", "p.part", "node", "root", "n", "p.side", "guest", *cells)
        found = dealt.repartition("sign", "part").sortWithinPartitions("sign", "part").mapInArrow(
            _candidates(percent, most), "a bigint, b bigint, more boolean")
        found = stored(found.groupBy("a", "b").agg(F.max("more").alias("more")), "op3-candidates")
        new = stored(found.select("a", "b").join(seen.select("a", "b"), ["a", "b"], "left_anti"), "op3-new")
        if not new.isEmpty():
            seen = seen.unionByName(_linked(new, classes, rows, percent, words, "op3-rest"))
            roots = components(seen.where("ok").select("a", "b"), "op3-roots")
        if found.where("more").isEmpty():
            break
        most *= MORE_NEAREST

    grouped = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("head"))
    named = stored(grouped.join(heads, "root").select("node", "head"), "op3-named")
    own = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("doc"), F.col("hash").alias("hash"))
    return signed.join(named, "node", "left").select(
        "key", "hash", "n_shingles", F.col("node").alias("class"),
        F.when(F.col("head").isNull(), F.col("key")).otherwise(F.col("head.doc")).alias("component"),
        F.when(F.col("head").isNull(), F.lit(True)).otherwise(own == F.col("head")).alias("kept"))


def join_report(docs: DataFrame) -> DataFrame:
    """Contract of op3: one row per document with its set size and component."""
    return similarity_groups(docs).select(F.col("key").alias("doc_id"), "n_shingles",
                                          F.col("component").alias("component_id"))


def keep_representatives(docs: DataFrame, percent: int = MIN_PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that represent their component, with their own columns."""
    gone = stored(similarity_groups(docs, percent, words=words).where(~F.col("kept")).select("key", "hash").distinct(), "op3-gone")
    mark = spare_name(docs, "text_hash")
    hashed = docs.withColumn(mark, F.xxhash64("text"))
    return hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["key"]) & (hashed[mark] == gone["hash"]),
                       "left_anti").drop(mark)
