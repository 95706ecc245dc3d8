"""Operator 11 against a plain trie."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from carelake.llm import prefix_trie

from .cases import words

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv bigint, pos string, a string, open string"


def table(spark, rows):
    return spark.createDataFrame([(*r, r[0], "p", "a", "o") for r in rows], SCHEMA).repartition(3)


def _digest(turn):
    return hashlib.md5(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()


def _turns(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _digest((role or "", text or "")), (role or "", text or "")))
    return {c: [t[-1] for t in sorted(x)] for c, x in own.items()}


def _rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c > 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        gain = (len(m) - 1) * len(words(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += gain
            leaves[k[:d]] += not children[k]
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
                   for k, m in members.items())


def _rows(seed, convs=120, longest=9, shared=3):
    rng = random.Random(seed)
    said = [" ".join(["w"] * rng.randint(0, 6)) + str(i % 4) for i in range(6)]
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 3, 5, longest])):
            rows.append((c * rng.choice([1, 1, 1]), t, "user" if t % 2 == 0 else "assistant",
                         said[0] if t < shared and rng.random() < 0.8 else rng.choice(said)))
    return rows


ODD = [(None, 0, "user", "x"), (20, None, None, None), (20, 0, "user", ""), (20, 0, "user", ""), (20, 0, "a", "b c"),
       (21, None, "", "long " * 5000), (-3, 1, "user", "x y"), (-20, 1, "user", "x"), (-20, 2, "user", "y z"),
       (7, 1, "user", "x y"), (47, 0, "system", "é 漢字")]
LONG = [(c, t, "user", f"word {t if t < cut else (c, t)}") for c, n, cut in (
    (0, 200, 200), (1, 200, 200), (2, 150, 130), (3, 131, 64), (4, 64, 64), (5, 128, 128), (6, 65, 10), (40, 190, 190),
    (41, 300, 200)) for t in range(n)]


def _plain(df):
    return Counter((r.conv, r.depth, r.up_conv, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256)
                   for r in df.collect())


@pytest.mark.parametrize("rows", [_rows(1), LONG + ODD], ids=["short", "long"])
def test_trie_equals_brute_force(spark, rows):
    got = Counter(tuple(r) for r in prefix_trie.trie_report(table(spark, rows)).collect())
    assert got == _trie(_rebuilt(_turns(rows)))


@pytest.mark.parametrize("rows", [_rows(2, 60, 30), LONG], ids=["deep", "long"])
def test_runs_of_two_classes_meet_at_their_seams(spark, rows):
    seq = prefix_trie.sequences(table(spark, rows))
    seq = seq.select("*").cache()
    assert _plain(prefix_trie.trie(seq, seq.select("conv").distinct(), 2)) == _trie(_turns(rows))


def test_odd_rows(spark):
    assert _plain(prefix_trie.prefix_trie(table(spark, ODD))) == _trie(_turns(ODD))


def test_empty_table(spark):
    assert prefix_trie.trie_report(table(spark, ODD).limit(0)).count() == 0
