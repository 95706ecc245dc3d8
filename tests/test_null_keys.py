"""Symptom texts of rows whose keys are null, and the levels at which leaves are looked up."""

from pyspark.sql import functions as F

from carelake.operators import records as RC
from carelake.sources.views import _symptom_text


def test_null_customer_adds_no_symptom(spark):
    df = spark.createDataFrame([(0, None), (13, None), (None, None), (1, 0)], "ok bigint, ck bigint")
    got = [r.t for r in df.select(_symptom_text(F.col("ok"), F.col("ck")).alias("t")).collect()]
    assert got == ["headache, persistent cough", "seizure", "", "fever"]


def test_instants_are_made_for_the_levels_of_leaves_only(spark):
    leaves = spark.sql("""SELECT * FROM VALUES
        (1L, 'd@x', timestamp'2020-01-01 00:00:00', timestamp'2020-01-02 00:00:00'),
        (2L, 'd@x', timestamp'2020-01-01 00:00:00', timestamp'2021-01-01 00:00:00'),
        (3L, 'd@x', timestamp'2020-05-01 00:00:00', timestamp'2020-04-01 00:00:00')
        AS t(id, doctor_email, start_at, end_at)""")
    events = spark.sql("SELECT 7L AS k, 'D@x ' AS doc, timestamp'2020-06-01 00:00:00' AS at")
    assert {r["__level"] for r in RC._at_levels(events, "at", leaves).collect()} == {0, 1}
    assert RC._at_levels(events, "at", leaves.filter("id = 1")).count() == 1
    assert RC._at_levels(events, "at", leaves.filter("id = 3")).count() == 0
    assert [r.leave_id for r in RC.leave_for(events, leaves, "k", "doc", "at").collect()] == [2]
    assert [r.on_leave for r in RC.leave_for(events, leaves.filter("id = 3"), "k", "doc", "at").collect()] == [False]
