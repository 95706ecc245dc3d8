"""Operator 12: fingerprints against the exact shingle sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from carelake.llm import sketches
from pyspark.sql import functions as F

from .cases import CLASHING, LOWER, odd_rows, prose, table, words


def _set(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def _wanted(rows):
    """Each row with its next one, by descending key, keyless rows last, ties by text."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        yield i, t, t[:len(t) - half] + after[:half], after


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows()[:1], [(i, f"text {i} " * 9, "en", "s") for i in range(700)]],
                         ids=["odd", "one", "many"])
def test_report(spark, rows):
    got = sketches.sketch_report(table(spark, rows)).collect()
    want = list(_wanted(rows))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(
        (i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want)
    own = {(i, hashlib.sha256(e.encode()).hexdigest()): (_jaccard(_set(t), _set(e)), _jaccard(_set(t), _set(a)),
                                                         max(len(_set(t)), len(_set(e)), len(_set(a))))
           for i, t, e, a in want}
    for r in got:
        edited, follows, size = own[r.doc_id, r.edited_sha256]
        # A sketch of the union is exact while the union has at most K names.
        slack = 1e-9 if 2 * size <= sketches.K else 0.2
        assert abs(r.near_edited - edited) <= slack and abs(r.near_next - follows) <= slack
    texts = {}
    for r, w in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.edited_sha256)),
                    sorted(want, key=lambda w: (w[0] is None, w[0] or 0, hashlib.sha256(w[2].encode()).hexdigest()))):
        assert texts.setdefault(w[1], r.fingerprint) == r.fingerprint


def test_estimates_over_large_sets():
    rng = random.Random(4)
    base = [prose(rng, 3000, 10 ** 6) for _ in range(6)]
    errors = []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for one, two in zip(base, base[1:]):
            a, b = one, one[:int(len(one) * share)] + " " + two
            x, y = sketches.sketches(pa.array([a, b]))
            errors.append(sketches.resemblance(x, y) - _jaccard(_set(a), _set(b)))
            assert abs(sketches.containment(x, y) - len(_set(a) & _set(b)) / len(_set(a))) < 0.35
            assert 0.7 < sketches.distinct(x) / len(_set(a)) < 1.4
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.04


def test_parts_merge_to_the_whole(spark):
    rng = random.Random(5)
    parts = [prose(rng, n, 10 ** 6) for n in (5, 80, 400, 1, 900)]
    names = [sketches.Spans(sketches.Words(pa.array([p]), lower=True).hashes).windows(5) for p in parts]
    merged = np.zeros(0, np.uint64)
    for s in sketches.sketches(pa.array(parts)):
        merged = sketches.merge(merged, s)
    every = np.concatenate([*names, sketches.sketches(pa.array(parts[3:4]))[0]])
    assert np.array_equal(merged, np.unique(every)[:sketches.K])
    docs = spark.createDataFrame([(p, "g" if i % 2 else None) for i, p in enumerate([*parts, None, ""])],
                                 "text string, part string")
    prints = docs.select("part", sketches.fingerprint("text").alias("print"))
    got = {r.part: r.print for r in sketches.merged(prints, ["part"], "print").collect()}
    for part, some in ((None, parts[::2]), ("g", parts[1::2])):
        own = np.zeros(0, np.uint64)
        for s in sketches.sketches(pa.array(some)):
            own = sketches.merge(own, s)
        assert got[part] == sketches.hexed(own)
    empty = sketches.merged(prints.where("print = ''").select(F.lit("e").alias("part"), "print"), ["part"], "print")
    assert [tuple(r) for r in empty.collect()] == [("e", "")]
    two = prints.select("print", F.lit("").alias("none"))
    same = two.select(sketches.likeness(F.col("print"), F.col("print")).alias("x"),
                      sketches.likeness(F.col("print"), F.col("none")).alias("y"), "print",
                      sketches.contained(F.col("none"), F.col("print")).alias("z"),
                      sketches.n_distinct(F.col("print")).alias("n")).collect()
    assert all(r.x == 1 and r.z == 1 and r.y == float(not r.print) and (r.n > 0) == bool(r.print) for r in same)


def test_empty_table(spark):
    none = table(spark, odd_rows()).limit(0)
    assert sketches.sketch_report(none).count() == 0 and set(CLASHING) <= set(none.columns)
