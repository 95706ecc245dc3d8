"""Registered queries for the portal operators (display, lookups, leaves, search, time parsing, facts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keywords import symptom_count_form
from ..operators import features as FE
from ..operators import model as M
from ..operators import portal as P
from ..operators import records as RC
from ..operators import scoring as SC
from ..sources import files as FS
from ..sources import views as VW
from ..streaming.sources import scratch_path
from .queries import _clean, _featured, reference_table
from .queries_records import AS_OF, dashboard_rows


def q_probability_bars(spark, sf):
    s = SC.score(VW.score_requests(spark, sf), reference_table(spark, sf))
    return P.probability_bars(s, "request_id", "risk_probabilities")


def q_final_group_display(spark, sf):
    s = SC.score(VW.score_requests(spark, sf), reference_table(spark, sf))
    m = P.final_probability_map(F.col("risk_group"))
    return s.select("request_id", P.normalize_final_group(F.col("risk_group")).alias("final_group"),
                    P.appointment_kind(F.col("booking_priority"), F.col("risk_group")).alias("appointment_kind"),
                    *[F.element_at(m, F.lit(x)).alias(f"prob_{x.lower()}") for x in P.BAR_ORDER])


def q_user_lookup(spark, sf):
    u = VW.users(spark, sf)
    req = u.filter(F.col("role") == "patient").select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 2 == 0, F.upper("email")).alias("email"),
        F.when(F.col("id") % 2 == 1, F.col("phone")).alias("phone"))
    return P.lookup_users(req, u)


def q_leave_check(spark, sf):
    a = VW.appointments(spark, sf).filter(F.col("doctor_email").isNotNull())
    return P.leave_check(a.select("id", "doctor_email", "scheduled_for"), VW.doctors_ref(spark, sf),
                         VW.doctor_leaves(spark, sf), "id", "doctor_email", "scheduled_for")


def q_doctor_leaves_list(spark, sf):
    return P.leaves_newest_first(VW.doctor_leaves(spark, sf)).select("id", "doctor_email", "start_at", "end_at",
                                                                     "rank_in_doctor")


def leave_requests(spark, sf):
    lv = VW.doctor_leaves(spark, sf)
    i = F.col("id")
    return lv.select(
        F.col("id").alias("request_id"), "doctor_email",
        F.when(i % 11 == 0, F.lit("s0@example.com")).otherwise(F.col("doctor_email")).alias("requester_email"),
        F.when(i % 7 == 0, F.col("end_at")).otherwise(F.col("start_at")).alias("start_at"),
        F.when(i % 7 == 0, F.col("start_at")).otherwise(F.col("end_at")).alias("end_at"))


def q_leave_admission(spark, sf):
    return P.leave_admission(leave_requests(spark, sf), VW.doctor_leaves(spark, sf))


def q_history_rows(spark, sf):
    return P.history_rows(RC.record_changes(VW.submissions(spark, sf)))


def q_protected_fold(spark, sf):
    d = SC.parse_details(VW.submissions(spark, sf))
    feed = d.select("email", "submitted_at", "id",
                    F.when(F.col("id") % 4 == 0, "clinical_update").otherwise("patient_form").alias("source"),
                    F.col("d.glucose").alias("glucose"), F.col("d.blood_pressure").alias("blood_pressure"))
    return RC.protected_form_fold(feed)


def q_patient_directory(spark, sf):
    return P.patient_directory(VW.users(spark, sf), "000001")


def q_parse_times(spark, sf):
    a = VW.appointments(spark, sf)
    i = F.col("id")
    base = F.date_format("scheduled_for", "yyyy-MM-dd'T'HH:mm:ss")
    shifted = F.date_format(F.col("scheduled_for") + F.expr("INTERVAL 5 HOURS 30 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(i % 17 == 0, F.lit("not a time")).when(i % 19 == 0, F.lit("12:30")).when(i % 23 == 0, F.lit("2024-01"))
            .when(i % 29 == 0, F.lit("2024")).when(i % 31 == 0, F.lit("2024-01-05")).when(i % 3 == 0, F.concat(base, F.lit("Z")))
            .when(i % 3 == 1, F.concat(shifted, F.lit("+05:30"))).otherwise(base))
    t = a.select("id", text.alias("text"))
    return t.select("id", "text", P.parse_iso_utc(F.col("text")).alias("parsed"))


def q_nurse_search(spark, sf):
    d = dashboard_rows(spark, sf).filter(F.col("bucket") == "upcoming")
    order = [F.desc("show_on_top"), F.asc("level_rank"), F.asc("scheduled_for"), F.asc("id")]
    return P.search_top(d, "c1", 12, order).select("id", "patient_email", "patient_name", "triage_level",
                                                    "scheduled_for")


def q_nurse_search_booked(spark, sf):
    d = dashboard_rows(spark, sf).filter(F.col("bucket") == "past")
    return P.search_top(d, "c1", 16, [F.asc("scheduled_for"), F.asc("id")]).select(
        "id", "patient_email", "patient_name", "triage_level", "scheduled_for")


def q_nurse_search_patients(spark, sf):
    d = P.patient_directory(VW.users(spark, sf)).withColumnRenamed("email", "patient_email").withColumn(
        "patient_name", F.col("full_name"))
    return P.search_top(d, "c1", 12, [F.lower(F.trim("full_name")), F.asc("id")]).select("id", "full_name", "patient_email")


def q_file_round_trip(spark, sf):
    """The accounts written in every file form and read back."""
    u = VW.users(spark, sf)
    base = scratch_path(spark, "files")
    FS.write_csv(u, f"{base}/typed")
    FS.write_csv_rows(u, f"{base}/rows", ["role", "id", "email", "phone", "full_name"])
    FS.write_json_array(u, f"{base}/array")
    FS.write_users_csv(u, f"{base}/accounts")
    exported = FS.export_tables({"users": u}, f"{base}/export")
    back = {
        "typed_csv": FS.read_csv_typed(spark, f"{base}/typed", {"id": "bigint"}),
        "csv_rows": FS.read_csv_rows(spark, f"{base}/rows", ["role", "id", "email", "phone", "full_name"]),
        "json_array": FS.read_json_array(spark, f"{base}/array", u.schema),
        "users_csv": FS.read_users_csv(spark, f"{base}/accounts", SC.DETAILS_SCHEMA),
        "export": spark.read.parquet(exported["users"]),
    }
    out = None
    for form, df in back.items():
        one = df.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("bigint")).alias("id_sum"),
            F.sum(F.length("email") + F.length("full_name") + F.length("role")).cast("bigint").alias("text_length"),
            F.count_if(F.coalesce("phone", F.lit("")) != "").alias("phones")).select(F.lit(form).alias("form"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def q_doctor_choices(spark, sf):
    d = RC.directory(VW.users(spark, sf), VW.doctors_ref(spark, sf), VW.doctor_leaves(spark, sf),
                     RC.latest_details(VW.submissions(spark, sf)), AS_OF)
    return P.doctor_choices(d)


def q_patient_recent(spark, sf):
    return P.recent_per_patient(VW.appointments(spark, sf), 10).select("patient_email", "rn", "id", "scheduled_for")


def q_target_distribution(spark, sf):
    return M.target_distribution(M.prepare_dataset(_featured(spark, sf))).select(
        F.col(M.TARGET).alias("label"), "n")


def q_report_facts(spark, sf):
    """M16 / F22 facts: rows kept for the alternate label, dropped rows, split sizes."""
    f = _featured(spark, sf).withColumn("Risk_Level", M.derive_risk_level(F.col("Age"), F.col("Symptom_Count")))
    # One pass over the features: rows per label and whether they are kept; the rest is sums of those few counts.
    kept = F.col("Risk_Level").isNotNull() & F.col("Age").isNotNull() & F.col("Symptom_Count").isNotNull()
    n = f.groupBy(F.when(kept, F.col("Risk_Level")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.when(F.col("label").isNotNull(), F.col("n"))
    zero = F.lit(0).cast("bigint")
    return n.agg(F.coalesce(F.sum("n"), zero).alias("feature_rows"), F.coalesce(F.sum(rows), zero).alias("model_rows"),
                 F.sum(F.bround(rows * 0.2)).cast("bigint").alias("test_rows")).select(
        "feature_rows", "model_rows", (F.col("feature_rows") - F.col("model_rows")).alias("dropped_rows"),
        "test_rows", (F.col("model_rows") - F.col("test_rows")).alias("train_rows"))


def q_form_symptom_counts(spark, sf):
    d = SC.parse_details(VW.submissions(spark, sf))
    s = F.col("d.symptoms")
    return d.select("id", symptom_count_form(s, True).alias("count_comma_newline"),
                    symptom_count_form(s, False).alias("count_comma"))


def q_pair_columns(spark, sf):
    top = FE.top_symptom_pairs(_featured(spark, sf))
    from ..functions.text import safe_name

    return top.select(F.concat(F.lit("PAIR_"), safe_name("first_symptom"), F.lit("_"), safe_name("second_symptom"))
                      .alias("column_name"), "first_symptom", "second_symptom")


def q_feature_report(spark, sf):
    c = _clean(spark, sf)
    return FE.feature_report(c, FE.feature_table(c))


def registry_extra():
    return {
        "probability_bars": q_probability_bars,
        "final_group_display": q_final_group_display,
        "user_lookup": q_user_lookup,
        "leave_check": q_leave_check,
        "doctor_leaves_list": q_doctor_leaves_list,
        "leave_admission": q_leave_admission,
        "history_rows": q_history_rows,
        "protected_fold": q_protected_fold,
        "patient_directory": q_patient_directory,
        "parse_times": q_parse_times,
        "nurse_search": q_nurse_search,
        "nurse_search_booked": q_nurse_search_booked,
        "nurse_search_patients": q_nurse_search_patients,
        "file_round_trip": q_file_round_trip,
        "doctor_choices": q_doctor_choices,
        "patient_recent": q_patient_recent,
        "target_distribution": q_target_distribution,
        "report_facts": q_report_facts,
        "form_symptom_counts": q_form_symptom_counts,
        "pair_columns": q_pair_columns,
        "feature_report": q_feature_report,
    }
