"""Credentials written as unspaced key=value pairs, and very long values."""

from carelake.llm import secrets

from .cases import table

ACCESS = "AKIA" + "A1B2" * 4
SECRET = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"[:36] + "a1Z9"


def test_unspaced_pairs_and_long_values(spark):
    session = "FwoGZXIvYXdzE" + "aB3xY/z+9Q" * 39  # more than 400 characters
    texts = [f"aws_access_key_id={ACCESS}\naws_secret_access_key={SECRET}",
             f"AccountName=x;account_id=12345678;AccountKey={SECRET}==;",
             f"{ACCESS} {session}", f"NAME={SECRET} alone", f"{ACCESS} NAME={SECRET}==="]
    assert len(session) > 400
    got = {r.doc_id: r.spans for r in secrets.secret_report(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}

    def value(i, part):
        at = texts[i].index(part)
        return f"value:{at}:{at + len(part)}"

    assert got[0].split(",")[-1] == value(0, SECRET) and "access:" in got[0]
    assert value(1, SECRET + "==") in got[1].split(",") and "identifier:" in got[1]
    assert value(2, session) in got[2].split(",")
    assert got[3] == "" and "value" not in got[4]
