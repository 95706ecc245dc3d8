"""Quality rules: repetition coverage (operator 10).

For every text, rolling hashes of the n-word windows of several lengths are
taken in numpy; a window found twice or more in the text marks all its words,
and the code points of the marked words are the length's coverage.  Repeated
lines are measured the same way.  Texts are independent, so nothing shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import U64, Spans, Words, mix, spare_name, text_udf

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_WORDS_PERCENT = 20
# Largest share of a text's word characters inside duplicated windows of n words
# and inside lines that repeat an earlier line.
MAX_COVERAGE_PERCENT = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
MAX_DUP_LINE_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

SCHEMA = ("struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, "
          "dup_line_chars: bigint, n_repeat_words: bigint, "
          + ", ".join(f"repeat_chars_{n}: bigint" for n in MAX_COVERAGE_PERCENT) + ">")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)


def _covered(w: Words, spans: Spans, n: int) -> np.ndarray:
    """Flags of the words inside an n-word window found twice or more in their text."""
    marks = np.zeros(len(w.hashes) + 1, np.int64)
    key = spans.windows(n)
    if len(key):
        text = w.text_of()
        own = np.flatnonzero(text[n - 1:] == text[:len(key)])
        own = own[_repeated(mix(key[own] + text[own].astype(U64) * U64(0xD6E8FEB86659FD93)))]
        np.add.at(marks, own, 1)
        np.add.at(marks, own + n, -1)
    return np.cumsum(marks[:-1]) > 0


def _per_text(w: Words, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[w.first[1:]] - total[w.first[:-1]]


def _dup_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and the code points of their words."""
    cuts = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.offsets[:-1], cuts + 1]), kind="stable")
    ends = np.sort(np.concatenate([w.offsets[1:], cuts]), kind="stable")
    words, chars = np.zeros(len(w.data) + 1, np.int64), np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.is_word, out=words[1:])
    np.cumsum(w.is_word & ((w.data & 0xC0) != 0x80), out=chars[1:])
    some = words[ends] > words[starts]
    starts, ends = starts[some], ends[some]
    text = np.searchsorted(w.offsets, starts, "right") - 1
    key = mix(w.span_hashes(starts, ends) + text.astype(U64) * U64(0xD6E8FEB86659FD93))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    count = np.bincount(text[~first], minlength=w.n_texts)
    size = np.zeros(w.n_texts, np.int64)
    np.add.at(size, text[~first], (chars[ends] - chars[starts])[~first])
    return count, size


def _signals(texts: pa.Array) -> pa.Array:
    w = Words(texts)
    lengths = w.lengths()
    spans = Spans(w.hashes)
    covered = {n: _covered(w, spans, n) for n in sorted({BASE_WINDOW, *MAX_COVERAGE_PERCENT})}
    n_dup, dup_chars = _dup_lines(w)
    columns = [np.diff(w.first), _per_text(w, lengths), w.counts(_SYMBOL[w.data]), n_dup, dup_chars,
               _per_text(w, covered[BASE_WINDOW])] + [_per_text(w, lengths * covered[n]) for n in MAX_COVERAGE_PERCENT]
    names = [f.split(":")[0].strip() for f in SCHEMA[7:-1].split(",")]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def repetition(docs: DataFrame, text: str = "text", out: str = "repetition") -> DataFrame:
    """``docs`` and a struct column ``out``: counts, character coverage and the verdict.

    A null text counts as empty: no words, so it fails the base rule.  Rows are
    judged one by one, so ties, repeated rows and nulls in other columns change
    nothing; an empty table gives an empty table.  ``out`` must not be a column
    of ``docs``.  ``base_failed``: fewer than 10 words, or more than 20 % of the
    words in 5-word windows found twice.  ``kept``: the base rule holds and no
    coverage is above its limit.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {out}")
    raw = spare_name(docs, f"{out}_raw")
    measured = docs.withColumn(raw, text_udf(_signals, SCHEMA)(F.col(text)))
    q = F.col(raw)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_WORDS_PERCENT * q["n_words"])
    over = 100 * q["dup_line_chars"] > MAX_DUP_LINE_PERCENT * q["word_chars"]
    for n, most in MAX_COVERAGE_PERCENT.items():
        over = over | (100 * q[f"repeat_chars_{n}"] > most * q["word_chars"])
    fields = [f.split(":")[0].strip() for f in SCHEMA[7:-1].split(",")]
    return measured.withColumn(out, F.struct(*[q[f].alias(f) for f in fields], failed.alias("base_failed"),
                                             (~failed & ~over).alias("kept"))).drop(raw)


def quality_report(docs: DataFrame) -> DataFrame:
    """Contract of op10: one row per document with counts, coverage and verdict."""
    return repetition(docs.select("doc_id", "text")).select("doc_id", "repetition.*")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    name = spare_name(docs, "repetition")
    return repetition(docs, out=name).where(F.col(name)["kept"]).drop(name)
