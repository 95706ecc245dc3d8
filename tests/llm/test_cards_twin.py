"""Entities of random texts against a plain scan that settles one match at a time."""

import random
import time

import regex
from pyspark.sql import functions as F

from carelake.llm import pii

from .cases import table

ENTITY = regex.compile(pii.ENTITY)
NUMBER = regex.compile(r"(?:\d{3}-\d{2}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\d-])")


def luhn(e):
    digits = [int(c) for c in e if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def usual(e):
    return bool(regex.fullmatch(pii.USUAL_CARD, e))


def settle(text):
    """The text with its marks: scan, settle the first match that is no card, scan again."""
    while True:
        last = 0
        for m in ENTITY.finditer(text):
            e, gap = m.group(), text[last:m.start()]
            last = m.end()
            late = bool(regex.search(rf"{pii.MARK}\d[\d -]*$", gap))
            number = bool(NUMBER.match(e))
            if not regex.fullmatch(pii.CARD_FORM, e) or (luhn(e) and (usual(e) or not (late or number))):
                continue
            ends = [regex.match(rf"(\d(?:[ -]?\d){{{n - 1}}})[ -]", e) for n in range(18, 12, -1)]
            fits = [p.group(1) for p in ends if p and luhn(p.group(1)) and (usual(p.group(1)) or not (late or number))]
            at = m.start() + (len(fits[0]) if fits else 0)
            text = text[:at] + pii.MARK + text[at:]
            break
        else:
            return text


def sample(rng):
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        sep = rng.choice(["", " ", "-"])
        body = digits(15)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        return sep.join(number[i:i + 4] for i in range(0, 16, 4))

    kinds = [card, card, lambda: digits(rng.randint(1, 5)), lambda: digits(4) + " " + digits(4),
             lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
             lambda: f"+{digits(2)} {digits(3)} {digits(3)}", lambda: f"1.2.3.{rng.randint(0, 255)}",
             lambda: f" u{digits(2)}@x.example", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}",
             lambda: "Mrs Anna Lopez", lambda: "word", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
             lambda: digits(rng.randint(13, 21)), lambda: "﷐﷑﷐"[:rng.randint(1, 3)]]
    return "".join(rng.choice(kinds)() + rng.choice([" ", " ", " ", " ", "-", ", ", "", "  ", "."])
                   for _ in range(rng.randint(1, 14)))


def test_settled_cards_against_a_plain_scan(spark):
    rng = random.Random(17)
    texts = [sample(rng) for _ in range(400)] + ["", "﷐﷑", "0.4111111111111111", "4111111111111111" * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.settled_cards(F.col("t")).alias("s"))
    for r in rows.collect():
        assert [m.group() for m in ENTITY.finditer(r.s)] == [m.group() for m in ENTITY.finditer(settle(texts[r.i]))], texts[r.i]


def test_a_long_run_of_numbers_takes_time_in_proportion(spark):
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(1000, 10000)) for _ in range(40_000))
    card = "4111 1111 1111 1111"
    begin = time.time()
    (row,) = pii.replace_entities(table(spark, [(1, f"{text}, {card}.", "en", "s")])).collect()
    assert time.time() - begin < 120
    assert len(row.text) == len(text) + len(card) + 3 and card not in row.text[-30:]
    assert row.entities["card"] > 1


def test_the_callers_own_marks_stay(spark):
    own = f"a {pii.MARK} b {pii.OWN}{pii.SAFE} 4111 1111 1111 1111 12/27 {pii.MARK}"
    (row,) = pii.replace_entities(table(spark, [(1, own, "en", "s")])).collect()
    assert row.text[:12] == own[:12] and row.text.endswith(f" 12/27 {pii.MARK}") and row.entities["card"] == 1
