"""Cards and phones that stand beside other digits."""

import re

from carelake.llm import pii

from .cases import table


def _replaced(spark, texts):
    rows = pii.replace_entities(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    return {r.doc_id: (r.text, r.entities) for r in rows}


def test_cards_and_phones_beside_other_digits(spark):
    card = "4111 1111 1111 1111"
    texts = [f"card {card} 12/27", f"card {card} 123", "call 555-123-4567 555-987-6543 now", f"{card} 555-123-4567",
             f"order 12 {card} today", f"{card} 12/27, {card} 123 and {card}", "123-45-6789 555-123-4567",
             "no card 4111 1111 1111 1112 12/27", "4111-1111-1111-1111-123", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 17",
             "555-123-4567 555-987-6543 555-222-3333 555-444-5555", f"{card} {card} {card}"]
    got = _replaced(spark, texts)
    want = {0: (1, 0, 0), 1: (1, 0, 0), 2: (0, 2, 0), 3: (1, 1, 0), 4: (1, 0, 0), 5: (3, 0, 0), 6: (0, 1, 1),
            7: (0, 0, 0), 8: (1, 0, 0), 10: (0, 4, 0), 11: (3, 0, 0)}
    for i, (cards, phones, ssns) in want.items():
        text, n = got[i]
        assert (n["card"], n["phone"], n["ssn"]) == (cards, phones, ssns), (texts[i], text)
        shape = re.sub(r"\d", "9", texts[i])
        assert re.sub(r"\d", "9", text) == shape and pii.MARK not in text
        if i != 7:
            assert not any(x in text for x in (card, "1111 1111", "1111-1111", "555-123-4567", "555-987-6543", "123-45-6789"))
    assert got[7][0] == texts[7] and got[0][0].endswith(" 12/27") and got[1][0].endswith(" 123")
    assert got[4][0].startswith("order 12 ")
    assert got[0][0][5:24] == got[1][0][5:24] == got[4][0][9:28]  # one card, one surrogate
