"""Operator 13 against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from carelake.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, pos string, none string, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "n", "b") for r in rows], SCHEMA).repartition(3)


def _damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            for _ in range(2 if kind == 3 else 1):
                yield conv, turn, "user" if kind == 4 else role, text


def _least(rows):
    """(cost, audit, repaired) by trying every edit; inserts never pay more than twice in a row."""
    @lru_cache(None)
    def best(i, state, inserts):
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            c, a, r = best(i, due, inserts + 1)
            found.append((c + 2, "I" + a, ((repair.NAMES[due], ""), *r)))
        if i < len(rows):
            (role, text), fault = rows[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more, x = int(fault == "truncated"), role[:1]
                if x == due or (x == "s" and state == ""):
                    c, a, r = best(i + 1, x, 0)
                    found.append((c + more, "K" + a, ((role, text), *r)))
                c, a, r = best(i + 1, due, 0)
                found.append((c + 2 + more, "R" + a, ((repair.NAMES[due], text), *r)))
        return min(found) if found else (10 ** 9, "", ())

    return best(0, "", 0)


def _digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _report(rows):
    after = defaultdict(list)
    for conv, turn, role, text in _damaged(rows):
        after[conv].append(((turn is not None, turn or 0, _digest(role, text)), turn, role, text))
    for conv in {r[0] for r in rows}:
        own = sorted(after[conv], key=lambda x: x[0])
        seen, faults = set(), []
        for _, _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for _, t, _, _ in own if t is not None]
        pairs = zip(own, own[1:])
        cost, audit, repaired = _least([((r, t), f) for (_, _, r, t), f in zip(own, faults)])
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(
            faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def _rows(seed, convs=150, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "Why?", "open end", " \t", "", None, "Good!\n", "é 漢字 .", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"]
    return [(c if c else None, rng.choice([t, t, t, t + 1, None]), rng.choice(roles[:rng.choice([2, 4, 9])]),
             rng.choice(texts)) for c in range(convs) for t in range(rng.randint(1, most))]


def _key(x):
    return (x[0] is not None, x[0] or 0)


@pytest.mark.parametrize("rows", [_rows(1), _rows(2, 5, 180)], ids=["short", "long"])
def test_repair_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(repair, "BLOCK", 16)
    got = sorted((tuple(r) for r in repair.repair_report(table(spark, rows)).collect()), key=_key)
    assert got == sorted(_report(rows), key=_key)


def test_walk_equals_costs_at_any_cut():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 15, 16, 17, 100):
        codes = rng.integers(0, 4, (20, size)) + 4 * (rng.random((20, size)) < 0.2) + 8 * (rng.random((20, size)) < 0.3)
        codes = codes.astype(np.uint8)
        end = np.tile(repair.END, (20, 1))
        whole = (repair.matrices(codes) + end[:, :, None]).min(axis=1)
        cut = size // 2
        later = (repair.matrices(codes[:, cut:]) + end[:, :, None]).min(axis=1)
        assert np.array_equal((repair.matrices(codes[:, :cut]) + later[:, :, None]).min(axis=1), whole)
        steps, behind = repair.walks(codes, end)
        for b in range(20):
            for s in range(4):
                price = 0
                for i, x in enumerate(steps[b, :, s].tolist()):
                    inserts, move = divmod(x, 3)
                    price += 2 * inserts + (3, 0, 2)[move] + (codes[b, i] & 8) // 8 * (move > 0)
                assert price + repair.END[behind[b, s]] == whole[b, s]


def test_empty_table(spark):
    assert repair.repair_report(table(spark, _rows(1)).limit(0)).count() == 0
