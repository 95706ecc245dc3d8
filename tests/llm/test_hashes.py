"""Names of words and spans over Thue-Morse texts, whose complements cancel out in sums of powers."""

import numpy as np
import pyarrow as pa
import pytest

from carelake.llm import ngram_join, quality, substring
from carelake.llm.common import Spans, Words

from .cases import table

SWAP = str.maketrans("ab", "ba")


def thue_morse(size):
    text = "a"
    while len(text) < size:
        text += text.translate(SWAP)
    return text


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_and_spans_of_patterns_differ(size):
    text = thue_morse(size)
    other = text.translate(SWAP)
    assert len(set(Words(pa.array([text, other])).hashes.tolist())) == 2
    w = Words(pa.array([" ".join(text), " ".join(other)]))
    spans = Spans(w.hashes)
    whole = spans.windows(size)
    assert whole[0] != whole[size]
    assert np.array_equal(spans.names(np.array([0, size]), np.array([size, 2 * size])), whole[[0, size]])


def test_equal_spans_have_equal_names():
    w = Words(pa.array(["abcdefghijk lm abcdefghijk lm", "lm abcdefghijk lm x"]))
    assert len(set(w.hashes.tolist())) == 3
    for n in (1, 2, 3):
        names = Spans(w.hashes).windows(n)
        at = np.arange(len(names))
        assert np.array_equal(Spans(w.hashes).names(at, at + n), names)
        words = ["abcdefghijk", "lm", "abcdefghijk", "lm", "lm", "abcdefghijk", "lm", "x"]
        assert len(set(names.tolist())) == len({tuple(words[i:i + n]) for i in at})


def test_operators_tell_patterns_apart(spark):
    text = thue_morse(2048)
    other = text.translate(SWAP)
    joined = ngram_join.join_report(table(spark, [(1, text, "en", "s"), (2, other, "en", "s")]))
    assert sorted((r.doc_id, r.component_id) for r in joined.collect()) == [(1, 1), (2, 2)]
    lines = quality.quality_report(table(spark, [(1, text + "\n" + other, "en", "s")])).first()
    assert lines.n_dup_lines == 0
    passages = [(i, " ".join(f"{x}{k}" for k in range(50)), "en", "s") for i, x in ((1, text), (2, other))]
    assert [r.n_removed for r in substring.substring_report(table(spark, passages)).collect()] == [0, 0]
