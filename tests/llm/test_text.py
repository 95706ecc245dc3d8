"""Operators 5, 6, 7 and 9, and the pipeline, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from carelake.llm import chat, mixing, pii, secrets

from .cases import CLASHING, odd_rows, table, words


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "a <|im_end|> b"),
             (1, 3, "ann", "a <|im_end|> b"), (1, 300, "c d", "late"), (2, 0, "system", "alone"), (3, None, None, "who"),
             (3, 1, "é", "漢字"), (None, 0, "x", ""), (None, 1, None, None)]
    df = spark.createDataFrame([(*t, "extra") for t in turns],
                               "conv_id bigint, turn bigint, role string, text string, part string")
    got = chat.rotate(df).collect()
    want = {}
    for c in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == c]
        for p in {t[2] for t in own} - {"system", None}:
            for part in {(t[1] or 0) // chat.PART_TURNS for t in own}:
                text, mask = "", []
                some = [t for t in own if (t[1] or 0) // chat.PART_TURNS == part]
                for t in sorted(some, key=lambda t: (t[1] is not None, t[1], t[2] is not None, t[2], t[3] or "")):
                    who = "system" if t[2] == "system" else "assistant" if t[2] == p else (
                        "user name=" + re.sub(r"[^\w-]", "_", t[2] or "unknown"))
                    text += f"<|im_start|>{who}\n"
                    begin = len(text)
                    text += (t[3] or "").replace("<|im_", "<| im_") + "<|im_end|>"
                    if t[2] == p:
                        mask.append((begin, len(text)))
                    text += "\n"
                want[c, p, part] = (text, mask)
    assert {(r.conv_id, r.perspective, r.part): (r.rendered, [tuple(m) for m in r["mask"]]) for r in got} == want
    assert chat.chat_report(df.limit(0)).count() == 0


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def _spans(text):
    """Base spans and the weak ones with their complements in reach, by all pairs."""
    found = secrets.scan(text or "")

    def meets(a, kinds):
        return any(b[0] in kinds and b != a and b[1] <= a[2] + secrets.REACH and b[2] >= a[1] - secrets.REACH
                   for b in found)

    names, values = (1, 3), (0, 2, 4)
    keep = [s for s in found if s[0] < 3 or s[0] == 4 and meets(s, names) or s[0] == 3 and meets(s, values)
            or s[0] == 5 and meets(s, names) and meets(s, values)]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for k, a, b in sorted(keep, key=lambda s: (s[1], s[0], s[2])))


def _secret_texts():
    rng = random.Random(4)
    parts = ["AKIA" + "A1B2" * 4, "AKIASHORT", "password = hunter22", "Token: abc", "secret=token: abcdefgh",
             "deadbeef" * 4, "user: alice", "account_id=123456", "https://db.internal:5432/x", "api.acme.io:443",
             "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "aB3" * 13, "ſecret=abcdefgh", "api_KEY:'zzzzzzz'", "é漢" * 5]
    texts = []
    for _ in range(80):
        texts.append(" ".join(rng.choice([rng.choice(parts), "word " * rng.choice([1, 10, 30, 60])])
                              for _ in range(rng.randint(1, 25))))
    return texts + [None, "", "AKIA" + "X" * 10_000 + " user: bob " * 3000, "user: bob " * 500]


def test_secrets(spark):
    rows = [(i, t, None, None) for i, t in enumerate(_secret_texts())] + odd_rows()[-6:]
    got = secrets.secret_report(table(spark, rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        base = _base(t)
        text = ",".join(f"{secrets.BASE_KINDS[k]}:{a}:{b}" for a, k, b in base)
        want[(i, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(text.encode()).hexdigest(),
              _spans(t))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == want
    assert any("value" in r.spans for r in got) and any("endpoint" in r.spans for r in got)
    assert secrets.secret_report(table(spark, rows).limit(0)).count() == 0


def _targets(sizes):
    """Shares by weight, the excess over the limit reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def _many_sources():
    rng = random.Random(2)
    return [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "b", "B", "é", None, "", "hot", "hot", "hot", "hot"]))
            for i in range(3000)] + [(4000, "one two", "en", "tiny")]


@pytest.mark.parametrize("rows", [odd_rows(), _many_sources()], ids=["odd", "sources"])
def test_mixing(spark, rows):
    docs = table(spark, rows)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
        largest[s] = max(largest[s], len(words(t)))
    target = _targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    repeats = Counter((i, t) for i, t, *_ in rows)
    for s in sizes:
        own = max((n * len(words(t)) for (i, t), n in repeats.items() if any(x[:2] == (i, t) and x[3] == s for x in rows)),
                  default=0)
        assert abs(taken[s] - target[s]) <= max(largest[s], own)
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixed_rows_are_the_reported_ones(spark):
    docs = table(spark, _many_sources())
    mixed = mixing.mix(docs)
    assert mixed.columns[:len(docs.columns)] == docs.columns and len(mixed.columns) == len(docs.columns) + 3
    drawn, reported = Counter(), Counter()
    for r in mixed.collect():
        drawn[r.doc_id] += len(words(r.text))
    for r in mixing.mix_report(docs).collect():
        reported[r.doc_id] += r.taken
    assert +drawn == +reported
    assert mixing.draw_documents(docs.limit(0)).columns == docs.columns
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_splitting_tree_is_exact_and_even(spark):
    draws = spark.createDataFrame([(s, f"{b:03x}", e, "g") for s, n in (("a", 900), ("b", 90), (None, 11))
                                   for b in range(n) for e in (1,)], "source string, block string, epoch int, cut string")
    out = mixing.split(draws).collect()
    per_shard = Counter(r.shard for r in out)
    assert len(out) == 1001 and max(per_shard.values()) - min(per_shard.values()) <= 1
    share = Counter(r.shard for r in out if r.source == "b")
    assert all(2 <= share[k] <= 25 for k in range(8))


def test_surrogates(spark):
    texts = ["Mrs. Anna Lopez met Mr John LOPEZ; Dr Lopez wrote a.b9@x.org, A.B9@X.org and c@y.org.",
             "call +1 (017) 555-7713 or +10175557713, not 9807915762804490; card 4111-1111-1111-1111 4111111111111111",
             "hosts 1.2.3.4 and 10.0.0.300, 123-45-6789; Господин Иван Петров", None, "", "nothing here: 1.5, v2.0, 2024",
             "1.2.3.4"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "mail c@y.org", None, None)] * 2
    docs = table(spark, rows)
    got = pii.replace_entities(docs).collect()
    by = {r.doc_id: r.text for r in got}
    assert sum(r.doc_id is None for r in got) == 2
    for secret in ("Anna", "Lopez", "LOPEZ", "a.b9@x.org", "A.B9@X.org", "555-7713", "5557713", "4111", "1.2.3.4",
                   "123-45-6789", "Иван", "Петров"):
        assert not any(secret in (t or "") for t in by.values()), secret
    assert by[3] is None and by[4] == "" and by[5] == texts[5] and "9807915762804490" in by[1] and "10.0.0.300" in by[2]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) (\w+); Dr (\w+) wrote (\S+@\S+), (\S+@\S+) and (\S+@\S+)\.", by[0])
    assert m[2] == m[5] == m[4].capitalize() and m[4].isupper() and m[1] != m[3]
    assert m[6] == m[7] != m[8] and m[8] in by[None]
    assert m[1].lower().endswith(tuple(pii.ENDINGS["latin"]["female"]))
    phones = re.search(r"call (\+\d \(\d{3}\) \d{3}-\d{4}) or (\+\d{11})", by[1])
    assert re.sub(r"\D", "", phones[1]) == phones[2][1:]
    cards = re.search(r"card (\d{4}-\d{4}-\d{4}-\d{4}) (\d{16})", by[1])
    assert cards[1].replace("-", "") == cards[2]
    digits = [int(c) for c in reversed(cards[2])]
    assert sum(digits[0::2] + [x * 2 - 9 if x > 4 else x * 2 for x in digits[1::2]]) % 10 == 0
    assert by[6] in by[2] and re.fullmatch(r"\d+(\.\d+){3}", by[6])
    assert re.search(r"Господин [А-Я][а-я]+ [А-Я][а-я]+$", by[2])
    assert set(CLASHING) <= set(pii.replace_entities(docs).columns)
    assert pii.pii_report(docs.limit(0)).count() == 0
    other = pii.replace_entities(docs, secret="other").collect()
    assert {r.doc_id: r.text for r in other}[6] != by[6]


def test_surrogates_stay_distinct(spark, monkeypatch):
    ips = [f"10.{a}.{b}.7" for a in range(40) for b in range(50)]
    entities = spark.createDataFrame([("ip", x) for x in ips] + [("ssn", f"{n:09d}") for n in range(3000)]
                                     + [("surname", f"n{n}") for n in range(5000)], "kind string, norm string")
    got = pii.assign(entities).collect()
    assert len(got) == 10000 and len({(r.kind, r.norm) for r in got}) == 10000
    assert len({(r.kind, r.surrogate) for r in got}) == 10000
    assert not {r.surrogate for r in got} & {r.norm for r in got}


def test_pipeline(spark):
    from .test_dedup import _components, _quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    good = [r for r in rows if _quality(r[1])[-1]]
    last = {}
    for r in good:
        key = (r[1] or "").translate({c: c + 32 for c in range(65, 91)})
        last[key] = max(r, last.get(key, r), key=lambda x: x[0])
    left = list(last.values())
    heads = {c for _, _, c in _components(left, 80, 5)[0]}
    left = [r for r in left if r[0] in heads]
    steps = [good, list(last.values()), left]
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        assert sorted(map(tuple, now.select("doc_id", "text", "lang", "source").collect())) == sorted(want), name
    mixed = Counter(r.doc_id for r in mixing.draw_documents(now).collect())
    packed = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).where("piece = 0").collect())
    assert packed == mixed and set(packed) <= heads
