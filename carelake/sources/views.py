"""Clinic tables as DataFrame views over the driver tables.

The reference keeps its operational data in small relational tables (users,
health-detail submissions, appointments, doctor leaves, a doctor reference
list, an access log) and trains on a raw patient CSV.  The driver only ships
TPC-H-like tables, so each clinic table is derived from them with the
deterministic column rules documented in FIXTURES.md.  The same rules are
written as SQL in ``carelake.plans.fixture_sql`` for the DuckDB oracle; this
module is the independent DataFrame form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# The 20 symptom phrases the fixture tables draw from, in the
# order the fixture rules index them (1-based).
SYMPTOM_VOCABULARY = [
    "fever", "Cough", "shortness of breath", "chest pain", "fatigue", "headache",
    "dizziness", "high fever", "mild cough", "persistent cough", "vomiting",
    "uncontrolled vomiting", "sore throat", "runny nose", "seizure", "abdominal pain",
    "rash with fever", "body aches", "difficulty in breathing", "nausea",
]

# Fixed clock used by every "now"-dependent query.
AS_OF = "1998-06-01 00:00:00"


def _vocab(index_expr: Column) -> Column:
    """1-based pick from the symptom vocabulary (``split_part`` in SQL)."""
    return F.element_at(F.array(*[F.lit(s) for s in SYMPTOM_VOCABULARY]), index_expr.cast("int"))


def _gender_token(key: Column) -> Column:
    m = key % 9
    return (
        F.when(m == 0, "Male").when(m == 1, " f ").when(m == 2, "FEMALE").when(m == 3, "m")
        .when(m == 4, "non  binary").when(m == 5, "prefer not to say").when(m == 6, "unknown")
        .when(m == 7, F.lit(None).cast("string")).otherwise("xyz")
    )


def _symptom_text(ok: Column, ck: Column) -> Column:
    parts = [
        F.when(ck.isNotNull(), _vocab(ck % 20 + 1)),  # generated code takes a null index for -1
        F.when(ck % 3 > 0, _vocab((ck * 7) % 20 + 1)),
        F.when(ck % 5 > 1, _vocab((ck * 11 + 3) % 20 + 1)),
        F.when(ok % 13 == 0, _vocab((ok * 13 + 5) % 20 + 1)),
        F.when(ok % 11 == 0, _vocab((ok * 17 + 9) % 20 + 1)),
    ]
    # concat_ws skips nulls; the separator depends on the row (one of three).
    sep = F.when(ok % 3 == 0, ", ").when(ok % 3 == 1, ";").otherwise(" | ")
    return F.call_function("concat_ws", sep, *parts)


def patients_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        ok.alias("seq"),
        F.when(ok % 41 == 0, F.lit(None).cast("string")).otherwise(ok.cast("string")).alias("Patient_ID"),
        F.when(ok % 29 == 0, F.lit("n/a")).otherwise(((ok * 37) % 131).cast("string")).alias("Age"),
        _gender_token(ok).alias("Gender"),
        F.when(ok % 31 == 0, F.lit(None).cast("string"))
        .when(ok % 37 == 0, F.lit(" NaN "))
        .otherwise(_symptom_text(ok, ck)).alias("Symptoms"),
        F.when(ok % 17 == 0, F.lit(None).cast("string"))
        .when(ok % 19 == 0, F.lit("null"))
        .otherwise(F.col("o_orderpriority")).alias("Disease"),
        F.when(ok % 23 == 0, F.lit("")).otherwise((35 + (ok * 53) % 380).cast("string")).alias("Glucose"),
        (25 + (ok * 31) % 240).cast("string").alias("BloodPressure"),
        ((90 + (ok * 67) % 740).cast("double") / 10).cast("string").alias("BMI"),
    )


def patients_raw_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw patients plus a copy of every 50th row under a ``seq`` of its own (dedup input)."""
    raw = patients_raw(spark, sf_dir)
    return raw.unionByName(raw.filter(F.col("seq") % 50 == 0).withColumn("seq", F.col("seq") + 1_000_000_000))


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        ok.alias("request_id"),
        ((ok * 37) % 121).cast("int").alias("age"),
        _gender_token(ok).alias("gender"),
        _symptom_text(ok, ck).alias("symptoms"),
        (40 + (ok * 53) % 300).cast("double").alias("glucose"),
        F.when(ok % 2 == 0, "fasting").otherwise("random").alias("glucose_type"),
        (80 + (ok * 31) % 130).cast("double").alias("systolic_bp"),
        (45 + (ok * 17) % 90).cast("double").alias("diastolic_bp"),
        ((150 + (ok * 67) % 300).cast("double") / 10).alias("bmi"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ck = F.col("c_custkey")
    patients = c.filter(ck % 97 != 96).select(
        ck.alias("id"), F.col("c_name").alias("full_name"),
        F.concat(F.lit("c"), ck.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(ck % 10 == 0, F.lit(None).cast("string"))
        .otherwise((F.lit(5550000000) + ck % 1000).cast("string")).alias("phone"),
        F.lit("patient").alias("role"),
    )
    sk = F.col("s_suppkey")
    doctors = s.select(
        sk.alias("id"), F.col("s_name").alias("full_name"),
        F.concat(F.lit("s"), sk.cast("string"), F.lit("@example.com")).alias("email"),
        (F.lit(5560000000) + sk).cast("string").alias("phone"),
        F.lit("doctor").alias("role"),
    )
    nk = F.col("n_nationkey")
    nurses = n.select(
        nk.cast("bigint").alias("id"), F.col("n_name").alias("full_name"),
        F.concat(F.lit("n"), nk.cast("string"), F.lit("@example.com")).alias("email"),
        (F.lit(5570000000) + nk).cast("string").alias("phone"),
        F.lit("nurse").alias("role"),
    )
    return patients.unionByName(doctors).unionByName(nurses)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions_from(read_table(spark, sf_dir, "events"))


def submissions_from(events: DataFrame) -> DataFrame:
    """Submission feed rows from event rows (batch or streaming)."""
    e = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    eid, uid = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    payload = F.concat(
        F.lit('{"age": '), s(18 + uid % 70),
        F.lit(', "gender": "'), F.when(uid % 2 == 0, "Female").otherwise("Male"),
        F.lit('", "symptoms": "'), _vocab(uid % 20 + 1), F.lit(", "), _vocab((eid * 7) % 20 + 1),
        F.lit('", "glucose": '), F.when(eid % 6 == 0, F.lit("null")).otherwise(s(40 + eid % 300)),
        F.lit(', "blood_pressure": '),
        F.when(eid % 5 == 0, F.lit("null")).otherwise(
            F.concat(F.lit('"'), s(80 + eid % 120), F.lit("/"), s(45 + eid % 80), F.lit('"'))),
        F.lit(', "bmi": '), s((150 + uid % 300).cast("double") / 10),
        F.lit(', "height_cm": '), s(140 + uid % 60), F.lit(', "weight_kg": '), s(45 + eid % 70),
        F.lit(', "smoking_habit": "'), F.when(uid % 3 == 0, "never").otherwise("daily"), F.lit('"}'),
    )
    return e.select(
        eid.alias("id"),
        F.when(eid % 9 == 0, F.concat(F.lit("C"), s(uid), F.lit("@Example.com"))).otherwise(
            F.concat(F.lit("c"), s(uid), F.lit("@example.com"))).alias("email"),
        F.col("ts").alias("submitted_at"),
        payload.alias("payload_json"),
    )


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    # scalar subquery: the supplier count is computed once and used as a value
    n_sup = read_table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    ok = F.col("o_orderkey")
    return o.select(
        ok.alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("patient_email"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(ok % 24).cast("int"))).alias("scheduled_for"),
        F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderstatus") == "P", "Confirmed")
        .when(ok % 3 == 0, "Cancelled").otherwise("Completed").alias("status"),
        F.when(ok % 4 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("reason"),
        F.when(ok % 2 == 0, "General checkup").otherwise("Follow-up").alias("appointment_type"),
        F.when(ok % 7 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("s"), (ok % n_sup).cast("string"), F.lit("@example.com"))).alias("doctor_email"),
        (F.lit(5550000000) + ok % 10000000).cast("string").alias("contact_info"),
        F.when(ok % 5 == 0, "High").otherwise(F.lit(None).cast("string")).alias("priority"),
        F.when(ok % 6 == 0, " call first ").when(ok % 6 == 1, "").when(ok % 6 == 2, F.concat(F.lit("bring "), F.repeat(F.lit("x"), 990)))
        .otherwise(F.lit(None).cast("string")).alias("notes"),
        (F.col("o_orderdate") - F.make_dt_interval(hours=(ok % 240 + 1).cast("int"))).alias("created_at"),
    )


def doctor_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@example.com")).alias("doctor_email"),
        F.col("l_shipdate").alias("start_at"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_quantity").cast("int"))).alias("end_at"),
    )


def doctors_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sk = F.col("s_suppkey")
    m = sk % 4
    return s.filter(sk % 5 != 0).select(
        (sk * 37 % 100003).alias("seq"),  # place in the file
        F.concat(F.lit("s"), sk.cast("string"), F.lit("@example.com")).alias("doctor_id"),
        F.when(sk % 6 == 0, F.lit("")).otherwise(F.col("s_name")).alias("doctor_name"),
        F.lit("General Medicine").alias("specialization"),
        F.lit("10:00 AM to 9:00 PM").alias("available_time"),
        F.when(m == 0, "yes").when(m == 1, "no").when(m == 2, " TRUE ").otherwise("0").alias("emergency_doctor"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log_from(read_table(spark, sf_dir, "events"))


def access_log_from(events: DataFrame) -> DataFrame:
    """Access-log rows from event rows (batch or streaming)."""
    e = events.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select(
        "event_id",
        F.col("event_type").alias("scope"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"),
        F.col("ts"),
    )
