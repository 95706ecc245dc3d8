"""Substring dedup by recompression (operator 8).

Every text is rewritten, round by round, into fewer symbols: maximal runs of a
symbol become one symbol, then every adjacent pair whose left symbol has coin 1
and right symbol coin 0 becomes one.  A symbol's name is a hash of what it
stands for, so all tasks give equal token strings equal names without a shared
dictionary, and equal substrings get the same symbols except near their ends:
with each symbol goes the span of words that its formation depends on, and any
text that holds those words has the symbol there.

A window of ``WINDOW`` words is anchored at the leftmost symbol, of the highest
level that has one, whose span lies inside the window, so equal windows have
equal anchors; an anchor is named by its symbol and by all words of its span
(some 25), so texts share anchors where they share passages, hardly by chance.
(A window without such a symbol is its own anchor.)  Consecutive windows with
one anchor form a range, named by the hash of all its words.  Spark then works in rounds:

1. anchors that occur in more than one document are kept, with their ranges;
2. per range, the smallest document that has it: in larger documents all its
   windows are repeats, verified by the name of all its words;
3. where one anchor has different ranges (texts that agree only in part), the
   windows of each range, taken from its smallest document, are named one by one
   and meet under (anchor, window), which settles the rest exactly;
4. the verdicts go back to their documents, which mark the covered words.

Only anchors and verdicts shuffle, and the texts of documents that have some.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import CHUNK_BYTES, U64, Spans, Words, mix, perhaps_in, stored, text_chunks, text_udf

WINDOW = 50
ROUNDS = 7  # symbols of about 7 words, whose spans mostly fit a window
ANCHOR_ROUNDS = 3  # the last rounds, whose symbols anchor windows
FAR = 1 << 40


class Parse:
    """Symbols of a chunk of texts: names, first and last word, and the words lo..hi they depend on."""

    def __init__(self, words: np.ndarray, text: np.ndarray, bounds: np.ndarray):
        n = len(words)
        self.words, self.name, self.text = words, words, text
        # What depends on the edge of its text depends on a place just outside it.
        self.edge_lo, self.edge_hi = bounds[:-1] - 1, bounds[1:]
        self.first, self.last, self.lo, self.hi = (np.arange(n) for _ in range(4))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the symbols before and after belong to the same text."""
        same = self.text[1:] == self.text[:-1]
        return np.concatenate([[False], same]), np.concatenate([same, [False]])

    def keep(self, at: np.ndarray) -> None:
        for k in ("name", "text", "first", "last", "lo", "hi"):
            setattr(self, k, getattr(self, k)[at])

    def runs(self) -> None:
        """Maximal runs of equal symbols become one.  That a run ends depends on
        the next word alone if that word differs from the symbol's own first
        word, else on the whole next symbol; likewise to the left."""
        equal = np.zeros(len(self.name), bool)
        equal[1:] = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        head = np.flatnonzero(~equal)
        tail = np.append(head[1:], len(self.name)) - 1
        count = (tail - head + 1).astype(U64)
        own_last, own_first, last = self.last[head], self.first[tail], self.last[tail]
        lo, hi = np.minimum.reduceat(self.lo, head), np.maximum.reduceat(self.hi, head)
        self.keep(head)
        self.name = np.where(count > 1, mix(self.name + count * U64(0x9E3779B97F4A7C15)), self.name)
        self.last, self.lo, self.hi = last, lo, hi
        before, after = self.neighbours()
        left, right = self.edge_lo[self.text], self.edge_hi[self.text]
        i = np.flatnonzero(before)
        unclear = self.words[self.first[i] - 1] == self.words[own_last[i]]
        left[i] = np.where(unclear, lo[i - 1], self.first[i] - 1)
        i = np.flatnonzero(after)
        unclear = self.words[last[i] + 1] == self.words[own_first[i]]
        right[i] = np.where(unclear, hi[np.minimum(i + 1, len(hi) - 1)], last[i] + 1)
        self.lo, self.hi = np.minimum(lo, left), np.maximum(hi, right)

    def pairs(self, number: int) -> None:
        """Adjacent symbols with coins 1 and 0 become one; a symbol left alone
        depends on the neighbour that it could have joined."""
        before, after = self.neighbours()
        coin = (mix(self.name + U64(7919 * number + 13)) & U64(1)).astype(bool)
        pair = np.zeros(len(coin), bool)
        pair[:-1] = coin[:-1] & ~coin[1:] & after[:-1]
        second = np.concatenate([[False], pair[:-1]])
        lo, hi = self.lo.copy(), self.hi.copy()
        i = np.flatnonzero(~pair & ~second & coin)
        hi[i] = np.where(after[i], np.maximum(hi[i], self.hi[np.minimum(i + 1, len(hi) - 1)]),
                         self.edge_hi[self.text[i]])
        i = np.flatnonzero(~pair & ~second & ~coin)
        lo[i] = np.where(before[i], np.minimum(lo[i], self.lo[np.maximum(i - 1, 0)]),
                         self.edge_lo[self.text[i]])
        p = np.flatnonzero(pair)
        lo[p], hi[p] = np.minimum(lo[p], self.lo[p + 1]), np.maximum(hi[p], self.hi[p + 1])
        name, last = self.name.copy(), self.last.copy()
        name[p] = mix(self.name[p] * U64(3) + mix(self.name[p + 1] + U64(1)))
        last[p] = self.last[p + 1]
        self.name, self.last, self.lo, self.hi = name, last, lo, hi
        self.keep(np.flatnonzero(~second))


class Ranges:
    """Ranges of windows with one anchor: first and last window (by first word),
    text, anchor, and the name of all their words."""

    def __init__(self, w: Words, window: int = WINDOW, rounds: int = ROUNDS):
        self.w, self.window = w, window
        text, n = w.text_of(), len(w.hashes)
        self.span_names = Spans(w.hashes).names
        at = np.arange(max(0, n - window + 1))
        at = at[text[at] == text[at + window - 1]] if len(at) else at
        anchor, place = self.span_names(at, at + window), at.copy()
        parse = Parse(w.hashes, text, w.first)
        for r in range(1, rounds + 1 if len(at) else 1):
            parse.runs()
            parse.pairs(r)
            if r > rounds - ANCHOR_ROUNDS:
                inside = np.concatenate([[0], np.cumsum(np.bincount(parse.lo + 1, minlength=n + 2))])
                j = inside[at + 1]  # symbols whose span begins before the window
                fits = j < len(parse.hi)
                fits[fits] = parse.hi[j[fits]] <= at[fits] + window - 1
                j = j[fits]
                anchor[fits] = mix(parse.name[j] ^ self.span_names(parse.lo[j], parse.hi[j] + 1))
                place[fits] = parse.first[j] + r * FAR
        change = np.ones(len(at), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(change)
        tail = np.append(head[1:], len(at)) - 1
        self.begin, self.end, self.anchor, self.text = at[head], at[tail], anchor[head], text[at[head]]
        self.name = self.span_names(self.begin, self.end + window)


def _anchors(texts: pa.Array) -> pa.Array:
    w = Words(texts)
    r = Ranges(w)
    keep = np.sort(np.unique(mix(r.name ^ mix(r.text.astype(U64))), return_index=True)[1])
    at = np.searchsorted(r.text[keep], np.arange(w.n_texts + 1)).astype(np.int32)
    # bytes.split() cuts at exactly the white space between words.
    data, ends = w.data.tobytes(), w.offsets.tolist()
    digests = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(ends, ends[1:])]
    pairs = pa.StructArray.from_arrays([pa.array(r.anchor[keep].view(np.int64)), pa.array(r.name[keep].view(np.int64))],
                                       ["anchor", "name"])
    return pa.StructArray.from_arrays([pa.array(np.diff(w.first), pa.int64()), pa.array(digests, pa.string()),
                                       pa.ListArray.from_arrays(at, pairs)], ["n_words", "whole", "ranges"])


def _batched(texts: pa.Array, *more: pa.Array):
    """Chunks of texts with the matching values of other columns as Python lists."""
    at = 0
    for part in text_chunks(texts, CHUNK_BYTES):
        yield part, [c.slice(at, len(part)).to_pylist() for c in more]
        at += len(part)


def _window_names(text: Column, names: Column) -> Column:
    """For the asked ranges of a text: anchor, range name, and every window's place and name."""

    def run(texts: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for part, (lists,) in _batched(texts, asked):
            r = Ranges(Words(part))
            wanted = np.zeros(len(r.name), bool)
            bounds = np.searchsorted(r.text, np.arange(len(part) + 1))
            for i, own in enumerate(lists):
                a, b = bounds[i], bounds[i + 1]
                wanted[a:b] = np.isin(r.name[a:b], np.array(own, np.int64).view(U64))
            chosen = np.flatnonzero(wanted)
            size = (r.end - r.begin + 1)[chosen]
            of = np.repeat(chosen, size)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            start = r.begin[of] + nth
            at = np.searchsorted(r.text[of], np.arange(len(part) + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array(r.anchor[of].view(np.int64)), pa.array(r.name[of].view(np.int64)), pa.array(nth, pa.int32()),
                 pa.array(r.span_names(start, start + r.window).view(np.int64))], ["anchor", "name", "nth", "window"])
            out.append(pa.ListArray.from_arrays(at, flat))
        return pa.concat_arrays(out)

    run.__annotations__ = {"texts": pa.Array, "asked": pa.Array, "return": pa.Array}
    ddl = "array<struct<anchor: bigint, name: bigint, nth: int, window: bigint>>"
    return F.arrow_udf(run, ddl).asNondeterministic()(text, names)


def _marked(text: Column, verdicts: Column) -> Column:
    """Removed words and the kept text, from (range name, window or -1 for all) verdicts."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        removed, kept = [], []
        for part, (lists,) in _batched(texts, found):
            w = Words(part)
            r = Ranges(w)
            marks = np.zeros(len(w.hashes) + 1, np.int64)
            bounds = np.searchsorted(r.text, np.arange(len(part) + 1))
            for i, own in enumerate(lists):
                a, b = bounds[i], bounds[i + 1]
                order = np.argsort(r.name[a:b], kind="stable") + a
                names = r.name[order]
                value = np.array([v["name"] for v in own], np.int64).view(U64)
                nth = np.array([v["nth"] for v in own], np.int64)
                lo, hi = np.searchsorted(names, value), np.searchsorted(names, value, "right")
                of = np.concatenate([order[x:y] for x, y in zip(lo, hi)] + [np.zeros(0, np.int64)]).astype(np.int64)
                n = np.repeat(nth, hi - lo)
                np.add.at(marks, r.begin[of] + np.maximum(n, 0), 1)
                np.add.at(marks, np.where(n < 0, r.end[of], r.begin[of] + n) + r.window, -1)
            stays = np.cumsum(marks[:-1]) <= 0
            data, ends = w.data.tobytes(), w.offsets.tolist()
            for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
                removed.append(int(b - a - stays[a:b].sum()))
                own = data[ends[i]:ends[i + 1]].split()
                kept.append(b" ".join(compress(own, stays[a:b].tolist())).decode("utf-8"))
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                          ["n_removed", "kept_text"])

    run.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<n_removed: bigint, kept_text: string>").asNondeterministic()(text, verdicts)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all, changed).  ``all``: key, n_words and the digest of the whole word
    sequence of every row.  ``changed``: of the documents that lose words, key,
    text_hash, n_removed and kept_text (their kept words joined by one blank).

    A window of 50 words goes if the same words start in a document with a
    smaller key.  Rows without a key neither lose words nor make others lose
    them; rows with one key are one document, so they do not affect each other.
    A null text has no words.  Other columns are not read; an empty table gives
    empty tables.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    parsed = stored(rows.select(
        "key", F.xxhash64("text").alias("text_hash"),
        text_udf(_anchors, "struct<n_words: bigint, whole: string, "
                           "ranges: array<struct<anchor: bigint, name: bigint>>>")(F.col("text")).alias("p"))
        .select("key", "text_hash", "p.*"), "op8-parsed")
    ranges = parsed.where("key is not null").select("key", F.explode("ranges").alias("r")).select("key", "r.*")
    # Round 1.  There are many more ranges than the table's file size suggests: no broadcast of them.
    shared = ranges.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    common = stored(ranges.hint("merge").join(shared.select("anchor").hint("merge"), "anchor", "left_semi"),
                    "op8-common")
    # Round 2.
    firsts = stored(common.groupBy("anchor", "name").agg(F.min("key").alias("first"), F.max("key").alias("last")),
                    "op8-firsts")
    whole = common.join(firsts.where("first < last").select("anchor", "name", "first").hint("merge"),
                        ["anchor", "name"]).where(
        "key > first").select("key", "name", F.lit(-1).alias("nth"))
    # Round 3.
    differ = firsts.groupBy("anchor").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    asked = stored(firsts.join(differ.select("anchor"), "anchor", "left_semi").groupBy(F.col("first").alias("of"))
                   .agg(F.collect_set("name").alias("names")), "op8-asked")
    some = rows.where(perhaps_in(asked.select("of"))(F.col("key")))
    # Texts meet their requests by a shuffle at every size, so that growth shows in small runs too.
    named = some.join(asked.hint("merge"), F.col("key") == F.col("of")).select(
        "key", F.explode(_window_names(F.col("text"), F.col("names"))).alias("w")).select("key", "w.*")
    named = stored(named, "op8-windows")
    earliest = named.groupBy("anchor", "window").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    single = named.join(earliest.where("first < last").select("anchor", "window", "first"), ["anchor", "window"]).where(
        "key > first").select("key", "name", "nth")
    # Round 4.
    verdicts = stored(whole.unionByName(single).groupBy(F.col("key").alias("of")).agg(
        F.collect_set(F.struct("name", "nth")).alias("verdicts")), "op8-verdicts")
    losing = rows.where(perhaps_in(verdicts.select("of"))(F.col("key"))).join(
        verdicts.hint("merge"), F.col("key") == F.col("of"))
    changed = losing.select("key", F.xxhash64("text").alias("text_hash"),
                            _marked(F.col("text"), F.col("verdicts")).alias("m")).select("key", "text_hash", "m.*")
    return parsed.select("key", "text_hash", "n_words", "whole"), changed


def substring_report(docs: DataFrame) -> DataFrame:
    """Contract of op8: one row per document with its words, removed words and the
    digest of what is kept."""
    every, changed = repeated_passages(docs)
    changed = stored(changed.select(F.col("key").alias("of"), F.col("text_hash").alias("hash"), "n_removed",
                                    F.sha2("kept_text", 256).alias("digest")).distinct(), "op8-changed")
    both = every.join(changed, (F.col("key") == F.col("of")) & (F.col("text_hash") == F.col("hash")), "left")
    return both.select(F.col("key").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                       F.coalesce("digest", "whole").alias("kept_sha256"))
