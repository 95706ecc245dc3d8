"""Names of more than two words, with initials and particles."""

import re

from carelake.llm import pii

from .cases import table


def test_long_names_initials_and_particles(spark):
    texts = ["Mrs Anna Maria Lopez met Mrs Lopez.", "Señora Ana Lopez Garcia came", "Dr. J. Smith and Dr Smith, Dr. J.R. Smith",
             "Frau von Berg met Herr Karl van der Velde today", "Prof. John Q. Public III spoke", "Mr J Miller left", "the Mr is"]
    rows = pii.replace_entities(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    got = {r.doc_id: r.text for r in rows}
    for left in ("Anna", "Maria", "Lopez", "Ana", "Garcia", "J.", "Smith", "Berg", "Karl", "Velde", "John", "Q.", "Public",
                 "III", "J ", "Miller"):
        assert not any(left in t for t in got.values()), left
    a = re.fullmatch(r"Mrs (\w+) (\w+) (\w+) met Mrs (\w+)\.", got[0])
    assert a and a[3] == a[4] and len({a[1], a[2], a[3]}) == 3
    assert re.fullmatch(r"Señora \w+ \w+ \w+ came", got[1])
    b = re.fullmatch(r"Dr\. (\S+) (\w+) and Dr (\w+), Dr\. (\S+) (\w+)", got[2])
    assert b and b[2] == b[3] == b[5] and b[1].endswith(".")
    c = re.fullmatch(r"Frau \w+ (\w+) met Herr (\w+) \w+ \w+ (\w+) today", got[3])
    assert c and got[6] == texts[6]
    assert {r.doc_id: r.entities["name"] for r in rows} == {0: 2, 1: 1, 2: 3, 3: 2, 4: 1, 5: 1, 6: 0}
