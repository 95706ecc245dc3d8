"""The reference's four end-to-end smoke scenarios, as small tables."""

import datetime as dt

from pyspark.sql import functions as F

from carelake.operators import analytics as AN
from carelake.operators import records as RC

T0 = dt.datetime(2030, 1, 10, 9, 0, 0)


def _users(spark):
    rows = [(1, "Pat One", "pat@example.com", "5550000001", "patient"),
            (2, "Doc One", "doc1@example.com", "5560000001", "doctor"),
            (3, "Doc Two", "doc2@example.com", "5560000002", "doctor"),
            (4, "Nurse One", "nurse@example.com", "5570000001", "nurse")]
    return spark.createDataFrame(rows, "id long, full_name string, email string, phone string, role string")


def _leaves(spark):
    return spark.createDataFrame([(10, "doc1@example.com", T0, T0 + dt.timedelta(days=2))],
                                 "id long, doctor_email string, start_at timestamp, end_at timestamp")


def _ref(spark):
    return spark.createDataFrame([("doc1@example.com", "Doc One", "GP", "9-5", "yes"),
                                  ("ghost@example.com", "Ghost", "GP", "9-5", "yes")],
                                 "doctor_id string, doctor_name string, specialization string, "
                                 "available_time string, emergency_doctor string")


def _details(spark):
    return spark.createDataFrame([], "email string, id long, submitted_at timestamp, payload_json string")


def test_directory_marks_leave(spark):
    when = T0 + dt.timedelta(hours=1)
    d = {r.email: r for r in RC.directory(_users(spark), _ref(spark), _leaves(spark), _details(spark),
                                          F.lit(when).cast("timestamp")).collect()}
    assert d["doc1@example.com"].on_leave is True and d["doc1@example.com"].available is False
    assert d["doc1@example.com"].leave_id == 10
    assert d["doc2@example.com"].on_leave is False


def test_directory_only_registered_doctors(spark):
    d = RC.directory(_users(spark), _ref(spark), _leaves(spark), _details(spark), "2030-01-01 00:00:00").collect()
    assert {r.email for r in d} == {"doc1@example.com", "doc2@example.com"}
    assert all(r.role == "doctor" for r in d)


def test_doctor_sees_own_appointments(spark):
    now = T0
    rows = [(1, "pat@example.com", now + dt.timedelta(days=1), "Pending", "doc1@example.com"),
            (2, "pat@example.com", now + dt.timedelta(days=1), "Pending", "doc2@example.com"),
            (3, "pat@example.com", now + dt.timedelta(days=1), "Pending", None)]
    a = spark.createDataFrame(rows, "id long, patient_email string, scheduled_for timestamp, status string, "
                                    "doctor_email string")
    a = a.withColumn("predicted_risk_level", F.lit("Low")).withColumn("created_at", F.lit(None).cast("timestamp"))
    up = a.filter(AN.upcoming_flag(F.col("scheduled_for"), F.col("status"), F.lit(now)))
    k = {r.doctor_email: r for r in AN.doctor_kpis(up, F.lit(now)).collect()}
    assert k["doc1@example.com"].appointments == 1
    assert set(k) == {"doc1@example.com", "doc2@example.com"}  # unassigned never shown


def test_basic_booking_flow(spark):
    req = spark.createDataFrame(
        [(1, "pat@example.com", T0 + dt.timedelta(hours=1), "General checkup", "doc1@example.com", None, None,
          "5550000001"),
         (2, "pat@example.com", T0 + dt.timedelta(days=5), "General checkup", "doc1@example.com", "Cough", None,
          "5550000001"),
         (3, "nurse@example.com", T0 + dt.timedelta(days=5), "General checkup", None, None, None, "5550000001"),
         (4, "pat@example.com", T0 + dt.timedelta(days=5), "General checkup", None, None, None, "555-0001")],
        "request_id long, patient_email string, scheduled_for timestamp, appointment_type string, "
        "doctor_email string, reason string, notes string, contact_info string")
    out = {r.request_id: r for r in RC.booking_admission(req, _users(spark), _ref(spark), _leaves(spark)).collect()}
    assert out[1].accepted is False and out[1].reject_reason.startswith("Selected doctor is on leave")
    assert "Ghost" in out[1].reject_reason and "Doc One" not in out[1].reject_reason
    assert out[2].accepted is True and out[2].status == "Pending" and out[2].reason == "Cough"
    assert out[3].reject_reason == "Patient account not found."
    assert out[4].reject_reason == "Phone number must contain digits only (0-9)."


def test_dedup_ignores_the_order_column_and_ids_go_on_from_the_whole_part(spark):
    from carelake.operators.clean import clean_patients

    cols = "seq long, Patient_ID string, Age string, Gender string, Symptoms string, Disease string, Glucose string, " \
           "BloodPressure string, BMI string"
    same = ("7.6", "40", "m", "fever", "Flu", "100", "80", "22.5")
    rows = [(5, *same), (3, *same), (9, None, "30", "f", None, None, "90", "70", "20.0"),
            (8, None, "30", "f", None, None, "90", "70", "20.0"), (1, "2", "50", "f", "cough", "Flu", "110", "90", "30.5")]
    got = sorted((r.seq, r.Patient_ID, r.BMI) for r in clean_patients(spark.createDataFrame(rows, cols)).collect())
    assert got == [(1, 2, 30.5), (3, 8, 22.5), (8, 8, 20.0), (9, 9, 20.0)]


def test_medians_and_mode_from_counts(spark):
    from carelake.operators.clean import coerce_numeric, global_stats, value_counts

    rows = [(i, str(i), str(a), str(g), "1", str(b), d) for i, (a, g, b, d) in enumerate(
        [(10, 50.5, 10.1, "x"), (20, 60.25, 10.2, "y"), (30, 70.75, 79.9, "y"), (40, 400, 80, "x"), (121, 39, 81, None)])]
    df = coerce_numeric(spark.createDataFrame(rows, "seq long, Patient_ID string, Age string, Glucose string, "
                                                    "BloodPressure string, BMI string, Disease string"))
    s = global_stats(value_counts(df, "seq")).first().asDict()
    assert (s["__med_Age"], s["__med_Glucose"], s["__mode_Disease"], s["__max_id"]) == (25.0, 65.5, "x", 4.0)
    assert abs(s["__med_BMI"] - 45.05) < 1e-9 and s["__med_BloodPressure"] is None


def test_full_emergency_list_in_file_order(spark):
    from carelake.operators.portal import leave_check

    ref = spark.createDataFrame([(i, f"{n}@x.com", n, "", "", "yes") for i, n in enumerate(["zed", "bob", "amy", "kim", "lee"])],
                                "seq long, doctor_id string, doctor_name string, specialization string, "
                                "available_time string, emergency_doctor string")
    leaves = spark.createDataFrame([(1, "BOB@x.com", T0, dt.datetime(9999, 1, 1)), (2, "amy@x.com", T0, T0)],
                                   "id long, doctor_email string, start_at timestamp, end_at timestamp")
    checks = spark.createDataFrame([(1, "bob@x.com", T0), (2, "kim@x.com", T0 + dt.timedelta(days=900)),
                                    (3, "kim@x.com", T0 - dt.timedelta(seconds=1))],
                                   "id long, doctor_email string, at timestamp")
    got = {r.id: r for r in leave_check(checks, ref, leaves, "id", "doctor_email", "at").collect()}
    assert got[1].emergency_doctors == "zed, kim, lee" and got[1].on_leave and got[1].emergency_available == 3
    assert got[2].emergency_doctors == "zed, amy, kim, lee" and not got[2].on_leave
    assert got[3].emergency_doctors == "zed, bob, amy, kim, lee"


def test_cancellation_keeps_stored_notes(spark):
    rows = [(1, "pat@example.com", T0, "Pending", " call first "), (2, "pat@example.com", T0, "Pending", "call first"),
            (3, "pat@example.com", T0, "Pending", None)]
    a = spark.createDataFrame(rows, "id long, patient_email string, scheduled_for timestamp, status string, notes string")
    req = spark.createDataFrame([(1, "pat@example.com", 1, " ill "), (2, "pat@example.com", 2, None),
                                 (3, "pat@example.com", 3, "ill")],
                                "request_id long, patient_email string, appointment_id long, cancel_reason string")
    done = RC.cancel_admission(req, a, _users(spark), F.lit(T0 - dt.timedelta(days=1)))
    got = {r.appointment_id: r.notes for r in done.collect()}
    assert got == {1: "call first\nCancelled: ill", 2: "call first", 3: "Cancelled: ill"}
    up = done.select(F.col("appointment_id").alias("id"), "status", F.lit(None).cast("string").alias("notes"),
                     F.col("request_id").alias("update_id"))
    after = {r.id: (r.status, r.notes) for r in RC.update_status(a, up).collect()}
    assert after[1] == ("Cancelled", " call first ") and after[3] == ("Cancelled", None)


def test_iso_times_only(spark):
    from carelake.operators.portal import parse_iso_utc

    texts = ["12:30", "2024", "2024-01", "2024-01-05", "2024-01-05T10:00Z", "2024-01-05T10:00:00+02:00", "junk", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_iso_utc(F.col("t")).alias("p")).collect()
    assert [r.p is not None for r in rows] == [False, False, False, True, True, True, False, False]


def test_feature_names_that_coincide_get_numbers(spark):
    from carelake.operators.features import vocabulary_names

    top = spark.createDataFrame([("a b", 1), ("a-b", 2), ("c", 3)], "symptom string, rank int")
    assert vocabulary_names(top, "SYM_", ["symptom"]) == [("SYM_a_b", "a b"), ("SYM_a_b_2", "a-b"), ("SYM_c", "c")]
