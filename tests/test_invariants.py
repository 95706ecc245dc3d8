"""Invariants: clean is idempotent, triage counts sum to upcoming, admissions partition requests."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from carelake.operators import clean as C
from carelake.sources import views as VW

SF = "/root/testdata/sf0.001"


def test_clean_is_idempotent(spark):
    once = C.clean_patients(VW.patients_raw(spark, SF))
    as_text = once.select(*[F.col(c).cast("string").alias(c) if c not in ("seq",) else F.col(c)
                            for c in once.columns if c not in ("Gender_Encoded", "Symptom_Count")])
    twice = C.clean_patients(as_text)
    cols = [c for c in once.columns]
    assert sorted(map(tuple, once.select(*cols).collect())) == sorted(map(tuple, twice.select(*cols).collect()))


def test_triage_counts_sum_to_upcoming(spark):
    q = entry.queries()
    stats = q["dashboard_stats"](spark, SF).first()
    wl = q["dashboard_worklist"](spark, SF)
    n = wl.filter((F.col("bucket") == "upcoming") & F.col("triage_level").isNotNull()).count()
    assert sum(stats) == n


def test_admissions_partition_requests(spark):
    q = entry.queries()
    b = q["booking_admission"](spark, SF)
    assert b.count() == VW.appointments(spark, SF).count()
    assert b.filter(F.col("accepted") & F.col("reject_reason").isNotNull()).count() == 0
    assert b.filter(~F.col("accepted") & F.col("reject_reason").isNull()).count() == 0
