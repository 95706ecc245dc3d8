"""Tables for the operators' tests: odd rows, planted copies, and plain-Python words."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Names that operators use inside, as extra columns of their input.
CLASHING = ("key", "row", "digest", "maybe", "hash", "text_hash", "node", "draw", "block", "size", "origin", "shard",
            "epoch", "order_key", "own_key", "repetition_raw", "at", "rank")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          + ", ".join(f"{c} string" for c in CLASHING))


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source) with nulls in any column, empty and very long
    texts, ties, repeated rows, exact and near copies, and shared passages."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(12)]
    shared = prose(rng, 70)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        rows += [(20 + i, t.upper(), "en", None), (30 + i, " ".join(w), None, "s1"),
                 (40 + i, t[: len(t) // 2] + " " + shared + " " + prose(rng, 20), "fr", "s2")]
    rows += [(50, None, "en", "s0"), (51, "", None, ""), (52, " \t\n\r ", "en", "s0"), (53, "one", "en", "s0"),
             (54, "One", "en", "s0"), (55, "a b", "en", "s0"), (56, None, None, None), (None, base[0], "en", "s0"),
             (None, base[0], "en", "s0"), (None, None, None, None), (60, base[1], "en", "s1"), (60, base[1], "en", "s1"),
             (61, "x " * 3000, "en", "s2"), (62, "x " * 3001, "en", "s2"), (63, "äß 漢字 été x y " * 30, "de", "é"),
             (64, prose(rng, 30000), "en", "s0"), (65, "q" * 200_000, "en", "s1"),
             (66, "line one is here\n" * 20 + prose(rng, 40), "en", "s1")]
    return rows


def table(spark, rows):
    full = [(i, t, lang, source, None if t is None else len(t), *(f"c{k}" for k in range(len(CLASHING))))
            for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


def similar_copies(n=60, seed=3):
    """Texts with groups of near copies around the similarity limit."""
    rng = random.Random(seed)
    rows = []
    for g in range(n // 6):
        w = prose(rng, rng.choice([4, 8, 12, 25, 60, 120, 400]), 5000).split(" ")
        for _ in range(6):
            own = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(own), "en", "s"))
    return rows
