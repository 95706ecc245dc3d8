"""Checks of one time segment share its list, and meet it on the segment."""

import datetime as dt

from carelake.operators.portal import leave_check


def test_lists_are_met_on_segments(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ref = spark.createDataFrame([(1, "a@x", "Ann", "", "", "yes"), (2, "b@x", "Bo", "", "", "1"), (3, "c@x", "Cy", "", "", "no")],
                                "seq long, doctor_id string, doctor_name string, specialization string, "
                                "available_time string, emergency_doctor string")
    leaves = spark.createDataFrame([(10, "a@x", t(5), t(8))],
                                   "id long, doctor_email string, start_at timestamp, end_at timestamp")
    checks = spark.createDataFrame([(1, "a@x", t(4)), (2, "a@x", t(6)), (3, "c@x", t(7)), (4, "b@x", t(9)), (5, "b@x", None)],
                                   "id long, doctor_email string, scheduled_for timestamp")
    out = leave_check(checks, ref, leaves, "id", "doctor_email", "scheduled_for")
    got = {r.id: (r.on_leave, r.emergency_doctors, r.emergency_available) for r in out.collect()}
    assert got == {1: (False, "Ann, Bo", 2), 2: (True, "Bo", 1), 3: (False, "Bo", 1), 4: (False, "Ann, Bo", 2),
                   5: (False, "", 0)}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert "__segment" in joins[0]  # the last join, of the lists; on instants it would shuffle each list per instant
