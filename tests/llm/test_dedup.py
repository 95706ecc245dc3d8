"""Operators 3, 4, 8 and 10 against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from carelake.llm import exact, ngram_join, quality, substring

from .cases import CLASHING, LOWER, odd_rows, similar_copies, table, words


def _exact(rows):
    groups = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    out = []
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known) if known else None, len(ids), digest) for i in ids]
    return out, len(groups)


def test_exact_groups_and_survivors(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    got = exact.duplicate_report(docs).collect()
    want, texts = _exact(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
    assert sum(r.kept for r in got) == texts
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_exact_stays_right_when_the_filter_is_full(spark, monkeypatch):
    monkeypatch.setattr(exact, "filter_bits", lambda rows: exact.SEGMENT_BITS)
    rows = [(i, f"text {i % 30000}", "en", "s") for i in range(40000)]
    got = exact.duplicate_report(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(_exact(rows)[0])


def _sets(rows, n=3):
    out = []
    for _, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n
                   else frozenset([tuple(w)] if w else []))
    return out


def _components(rows, percent=90, n=3):
    sets, root = _sets(rows, n), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for n, (i, *_) in enumerate(rows):
        r = find(n)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return Counter((rows[n][0], len(sets[n]), least[find(n)]) for n in range(len(rows))), sets


@pytest.mark.parametrize("rows", [odd_rows(), similar_copies(), similar_copies(seed=11)], ids=["odd", "near", "near2"])
def test_join_components(spark, rows):
    got = ngram_join.join_report(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows)[0]


def _around_an_original(copies=150, length=60):
    """Copies of one text, some beyond the limit from it but near each other, and far ones that share its parts."""
    import random

    from .cases import prose

    rng = random.Random(21)
    base = prose(rng, length, 10 ** 6).split(" ")
    rows = [(0, " ".join(base), "en", "s")]
    for i in range(1, copies):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 8])):
            own[rng.randrange(length)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(own), "en", "s"))
    return rows


@pytest.mark.parametrize("percent, n", [(90, 3), (80, 5)])
@pytest.mark.parametrize("rows", [similar_copies(), _around_an_original()], ids=["near", "star"])
def test_one_document_of_each_component_stays(spark, rows, percent, n):
    docs = table(spark, rows)
    kept = ngram_join.keep_representatives(docs, percent, n)
    assert kept.columns == docs.columns
    want = {c for _, _, c in _components(rows, percent, n)[0]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_sets_that_share_a_name_are_told_apart(spark):
    rows = similar_copies()
    got = ngram_join.similarity_groups(table(spark, rows), node_bits=3)
    assert Counter((r.key, r.n_shingles, r.component) for r in got.collect()) == _components(rows)[0]


def test_wide_sketches_allow_every_link():
    rng = np.random.default_rng(10)
    pa, u64 = ngram_join.pa, np.uint64
    for size in (3, 40, 150, 700, 5000):
        for percent in (80, 90):
            ok, a = [], np.unique(rng.integers(0, 1 << 63, size, dtype=u64))
            for far in (0, 1, 2, 4):  # multiples of the largest difference
                most = far * ngram_join.max_difference(2 * size, percent) // 2
                b = np.unique(np.concatenate([a[most:], rng.integers(0, 1 << 63, most, dtype=u64)]))
                wide = [pa.array([ngram_join._wide_sketch(x, percent)]) for x in (a, b)]
                n = [pa.array([len(a)]), pa.array([len(b)])]
                may = ngram_join._may_link(percent).func(wide[0], n[0], wide[1], n[1])[0].as_py()
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert may
                ok.append(may)
            assert size < 700 or not ok[3]


@pytest.mark.parametrize("cut", [1, 2, 7, 1000])
def test_shared_signatures_across_batches(cut):
    rows = sorted(np.random.default_rng(cut).integers(0, 12, (200, 2)).tolist() + [[50, 1], [50, 1], [51, 2], [52, 3]])
    batches = [ngram_join.pa.RecordBatch.from_arrays(
        [ngram_join.pa.array(x) for x in zip(*rows[i:i + cut])], ["sign", "node"]) for i in range(0, len(rows), cut)]
    got = [(r["sign"], r["node"]) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist()]
    nodes = defaultdict(set)
    for sign, node in rows:
        nodes[sign].add(node)
    assert got == sorted((s, n) for s, x in nodes.items() if len(x) > 1 for n in x)


@pytest.mark.parametrize("cut", [1, 2, 7, 1000])
def test_shared_signatures_of_guests(cut):
    rng = np.random.default_rng(cut)
    rows = sorted([s, g, n] for s, n, g in zip(*rng.integers(0, 40, (2, 200)).tolist(), rng.random(200) < 0.6))
    batches = [ngram_join.pa.RecordBatch.from_arrays(
        [ngram_join.pa.array([r[c] for r in rows[i:i + cut]]) for c in (0, 2, 1)], ["sign", "node", "guest"])
        for i in range(0, len(rows), cut)]
    got = [(r["sign"], r["guest"], r["node"]) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist()]
    members = defaultdict(set)
    for sign, guest, node in rows:
        members[sign].add((guest, node))
    assert got == sorted((s, g, n) for s, x in members.items() if len(x) > 1 and not min(x)[0] for g, n in x)


def test_sketches_with_the_sign_bit():
    cells = np.full((2, ngram_join.SKETCH_LONGS), 7, np.int64)
    cells[1, 0] ^= np.int64(-1 << 63)  # one cell apart; as absolute value of a signed number far more
    cells[1, 1] ^= np.int64(-2)
    zero = np.zeros(2, np.int64)
    for size, linked in ((290, True), (280, False)):  # 64 cells: sets of 288 elements or more may link at 80 %
        i, _, _ = ngram_join.nearest(zero, np.arange(2), np.arange(2), np.full(2, size), zero, cells, 80, 9)
        assert bool(len(i)) == linked


def test_two_guests_are_no_candidates():
    size, cells = np.full(4, 100), np.zeros((4, ngram_join.SKETCH_LONGS), np.int64)
    guest = np.array([True, False, True, False])
    i, j, more = ngram_join.nearest(np.zeros(4, np.int64), np.arange(4), np.arange(4), size, np.zeros(4, np.int64),
                                    cells, 80, 9, guest)
    assert {*zip(i.tolist(), j.tolist())} == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3)} and not more.any()


@pytest.mark.parametrize("percent", [80, 90])
def test_guests_meet_all_linked_sets(percent):
    """Linked sets share a signature under which not both are guests."""
    rng = np.random.default_rng(percent)
    for size in (*range(1, 60), *rng.integers(60, 3000, 60).tolist()):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64) << np.uint64(1))
        grown = np.unique(np.concatenate([a, rng.integers(0, 1 << 62, len(a) * (100 - percent) // percent).astype(np.uint64)]))
        if 100 * len(a) < percent * len(grown):
            continue
        bands = [[(g, set(s.tolist())) for g, s in ngram_join.banded_signatures(x, percent)] for x in (a, grown)]
        if len(grown) > len(a):
            assert any(x & y and not (g and h) for g, x in bands[0] for h, y in bands[1])


def test_nearest_candidates_of_blocks():
    rng = np.random.default_rng(8)
    group, side = np.repeat([0, 1, 2], [40, 1, 30]), np.repeat([0, 0, 0, 1], [40, 1, 14, 16])
    root = rng.integers(0, 9, 71)
    size, cells = rng.integers(30, 34, 71), rng.integers(0, 4, (71, ngram_join.SKETCH_LONGS))
    wanted = [(i, j, apart) for i in range(71) for j in range(i + 1, 71)
              if group[i] == group[j] and root[i] != root[j] and (group[i] < 2 or side[i] != side[j])
              and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j])
              and 180 * (apart := int(np.bitwise_count(cells[i] ^ cells[j]).sum())) <= 20 * (size[i] + size[j])]
    i, j, more = ngram_join.nearest(group, np.arange(71), root, size, side, cells, 80, 100)
    assert {*zip(i.tolist(), j.tolist())} == {w[:2] for w in wanted} and not more.any()
    i, j, more = ngram_join.nearest(group, np.arange(71), root, size, side, cells, 80, 2)
    some = {*zip(i.tolist(), j.tolist())}
    for r in range(71):
        own = sorted(w[2] for w in wanted if r in w[:2])
        assert more[r] == (len(own) > 2)
        got = sorted(w[2] for w in wanted if r in w[:2] and w[:2] in some)
        assert got[:2] == own[:2]


def test_linked_sets_share_a_signature():
    """PartEnum's promise, over random pairs right at the limit, at many sizes."""
    rng = np.random.default_rng(5)
    for size in [9, 10, 11, 13, 18, 19, 20, 27, 28, 45, 60, 100, 250, 900, 5000]:
        for _ in range(25):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = ngram_join.max_difference(2 * len(a), 90)
            drop = int(rng.integers(0, most // 2 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(
                0, 1 << 63, int(rng.integers(0, most // 2 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert np.intersect1d(ngram_join.signatures(a, 90), ngram_join.signatures(b, 90)).size


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.concatenate([a[int(rng.integers(0, 50)):], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
        bits = sum(int(x).bit_count() for x in (ngram_join._sketch(a) ^ ngram_join._sketch(np.unique(b))).view("<u8"))
        assert bits <= len(np.setxor1d(a, b))


def _passages(rows):
    starts = defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            for p in range(len(w) - 49):
                starts[tuple(w[p:p + 50])].add(i)
    least = {k: min(v) for k, v in starts.items()}
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 49 if i is not None else 0):
            if least[tuple(w[p:p + 50])] < i:
                gone[p:p + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _passage_rows():
    import random

    from .cases import prose

    rng = random.Random(9)
    passages = [prose(rng, n, 60) for n in (49, 50, 51, 75, 120, 300)]
    rows = []
    for i in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [prose(rng, rng.randint(0, 30), 60), rng.choice(passages)]
            if rng.random() < 0.3:
                w = rng.choice(passages).split(" ")
                parts.append(" ".join(w[rng.randint(0, 20):]))
            if rng.random() < 0.2:
                parts.append("same " * rng.randint(40, 120) + "ab cd " * rng.randint(20, 60))
        rows.append((i, " \n".join(parts), "en", "s"))
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), _passage_rows()], ids=["odd", "passages"])
def test_repeated_passages(spark, rows):
    got = substring.substring_report(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(_passages(rows))


def _quality(text):
    w = words(text)

    def inside(n):
        seen = defaultdict(list)
        for i in range(len(w) - n + 1):
            seen[tuple(w[i:i + n])].append(i)
        mark = [False] * len(w)
        for places in seen.values():
            if len(places) > 1:
                for i in places:
                    mark[i:i + n] = [True] * n
        return mark

    lines, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            if line in lines:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, words(line)))
            lines.add(line)
    chars, repeat = sum(map(len, w)), sum(inside(5))
    coverage = {n: sum(len(x) for x, m in zip(w, inside(n)) if m) for n in quality.MAX_COVERAGE_PERCENT}
    failed = len(w) < 10 or 100 * repeat > 20 * len(w)
    over = 100 * dup_chars > 30 * chars or any(100 * coverage[n] > m * chars
                                               for n, m in quality.MAX_COVERAGE_PERCENT.items())
    return (len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, repeat, *coverage.values(), failed,
            not failed and not over)


def test_quality(spark):
    rows = [r for r in odd_rows() if r[0] != 64] + [(70 + i, t, "en", "s") for i, t in enumerate(
        ["a b c d e " * 8, "# * $ one two three four five six seven eight", "l m n\n" * 30 + "x"])]
    got = quality.quality_report(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    *(r[f"repeat_chars_{n}"] for n in quality.MAX_COVERAGE_PERCENT), r.base_failed, r.kept)
                   for r in got) == Counter((i, *_quality(t)) for i, t, *_ in rows)
    docs = table(spark, rows)
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(_quality(t)[-1] for _, t, *_ in rows)


def test_empty_tables(spark):
    none = table(spark, odd_rows()).limit(0)
    for report in (exact.duplicate_report, ngram_join.join_report, substring.substring_report, quality.quality_report):
        assert report(none).count() == 0
    for stage in (exact.drop_duplicates, ngram_join.keep_representatives, quality.keep_quality):
        out = stage(none)
        assert out.count() == 0 and out.columns == none.columns
    assert set(CLASHING) <= set(none.columns)
