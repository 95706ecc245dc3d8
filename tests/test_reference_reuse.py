"""The scoring reference can be counted from cleaned patients that a query has stored."""

from carelake.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_reference_from_stored_patients_does_not_clean_again(spark, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    cleaned = Q._clean(spark, SF).checkpoint(eager=True)
    monkeypatch.setattr(Q, "_reference_paths", {})
    want = rows(Q.reference_table(spark, SF))
    monkeypatch.setattr(Q, "_reference_paths", {})
    monkeypatch.setattr(Q, "_clean", lambda *a, **b: 1 / 0)
    assert rows(Q.reference_table(spark, SF, cleaned)) == want and want
