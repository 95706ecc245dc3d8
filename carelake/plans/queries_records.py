"""Registered queries over the clinic tables (J-, A-, S-series and T1 twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounts as AC
from ..operators import analytics as AN
from ..operators import records as RC
from ..operators import scoring as SC
from ..operators.stored_table import BucketedTable
from ..sources import views as VW
from ..streaming import rate_limit as RL
from ..streaming.sources import scratch_path
from .queries import _j, reference_table

AS_OF = VW.AS_OF


def _ref(spark, sf):
    return reference_table(spark, sf)


def _details(spark, sf):
    return RC.health_details(VW.submissions(spark, sf))


def patient_risk_table(spark, sf, ref=None, details=None) -> DataFrame:
    """R14 once per patient (not per appointment)."""
    r = SC.patient_risk(details if details is not None else _details(spark, sf),
                        ref if ref is not None else _ref(spark, sf))
    return r.select(F.col("email").alias("risk_email"), "risk_level", "risk_source", "risk_booking_priority",
                    F.col("submitted_at").alias("details_submitted_at"))


def patient_triage_table(spark, sf, ref=None, details=None) -> DataFrame:
    """N10 once per patient from the stored document."""
    hd = details if details is not None else _details(spark, sf)
    inp = SC.details_inputs(hd, nurse=True)
    t = SC.nurse_triage(inp.select("email", "age", "gender", "symptoms", "glucose", "glucose_type", "systolic_bp",
                                   "diastolic_bp", "bmi"), ref if ref is not None else _ref(spark, sf))
    return t.select(F.col("email").alias("triage_email"), "triage_level", "show_on_top")


def enriched_appointments(spark, sf, ref=None, details=None) -> DataFrame:
    """Appointment + patient name + stored-document risk."""
    a = VW.appointments(spark, sf)
    u = VW.users(spark, sf).select(F.col("email").alias("u_email"), F.col("full_name").alias("u_name"))
    r = patient_risk_table(spark, sf, ref, details)
    d = a.join(u, a["patient_email"] == u["u_email"], "left").join(r, a["patient_email"] == r["risk_email"], "left")
    return d.select(
        "id", "patient_email", F.coalesce("u_name", "patient_email").alias("patient_name"), "scheduled_for",
        F.coalesce("status", F.lit("Pending")).alias("status"), "appointment_type", "doctor_email",
        F.col("risk_level").alias("predicted_risk_level"), F.col("risk_source").alias("predicted_risk_source"),
        F.col("risk_booking_priority").alias("booking_priority"),
        F.col("details_submitted_at").alias("health_details_submitted_at"),
        F.coalesce(F.when(F.col("reason") != "", F.col("reason")), F.when(F.col("appointment_type") != "",
                   F.col("appointment_type")), F.lit("")).alias("reason"),
        "contact_info", "priority", "notes", "created_at")


def dashboard_rows(spark, sf) -> DataFrame:
    """Enriched appointments + triage, bucketed at the fixed clock."""
    ref, details = _ref(spark, sf), _details(spark, sf)  # one plan shared by risk and triage
    e = enriched_appointments(spark, sf, ref, details)
    t = patient_triage_table(spark, sf, ref, details)
    d = e.join(t, e["patient_email"] == t["triage_email"], "left").drop("triage_email")
    up = AN.upcoming_flag(F.col("scheduled_for"), F.col("status"), AS_OF)
    return d.withColumn("bucket", F.when(up, "upcoming").otherwise("past")).withColumn(
        "level_rank", AN.triage_rank(F.coalesce("triage_level", F.lit("")))).withColumn(
        "show_on_top", F.coalesce("show_on_top", F.lit(False)))


def q_users_with_details(spark, sf):
    return RC.users_with_details(VW.users(spark, sf), RC.latest_details(VW.submissions(spark, sf))).drop(
        "details_json")


def q_appointment_enriched(spark, sf):
    return enriched_appointments(spark, sf)


def q_leave_match(spark, sf):
    a = VW.appointments(spark, sf).filter(F.col("doctor_email").isNotNull())
    r = RC.leave_for(a, VW.doctor_leaves(spark, sf), "id", "doctor_email", "scheduled_for")
    return r.select("id", "doctor_email", "scheduled_for", "on_leave", "leave_id", "leave_start", "leave_end")


def q_emergency_available(spark, sf):
    return RC.emergency_available(VW.doctors_ref(spark, sf), VW.doctor_leaves(spark, sf), AS_OF).select(
        "doctor_id", "doctor_name")


def q_directory(spark, sf):
    return RC.directory(VW.users(spark, sf), VW.doctors_ref(spark, sf), VW.doctor_leaves(spark, sf),
                        RC.latest_details(VW.submissions(spark, sf)), AS_OF)


def booking_requests(spark, sf) -> DataFrame:
    a = VW.appointments(spark, sf)
    u = VW.users(spark, sf).select(F.col("email").alias("__u"), F.col("phone").alias("phone"))
    return a.join(u, a["patient_email"] == u["__u"], "left").select(
        F.col("id").alias("request_id"), "patient_email", "scheduled_for", "appointment_type", "doctor_email",
        F.when(F.col("reason") != "", F.col("reason")).alias("reason"), "notes", F.col("phone").alias("contact_info"))


def q_booking_admission(spark, sf):
    return RC.booking_admission(booking_requests(spark, sf), VW.users(spark, sf), VW.doctors_ref(spark, sf),
                                VW.doctor_leaves(spark, sf), F.lit(AS_OF).cast("timestamp"))


def q_cancel_admission(spark, sf):
    a = VW.appointments(spark, sf)
    req = a.select(F.col("id").alias("request_id"), "patient_email", F.col("id").alias("appointment_id"),
                   F.when(F.col("id") % 2 == 0, F.lit("Schedule conflict")).alias("cancel_reason"))
    return RC.cancel_admission(req, a, VW.users(spark, sf), AS_OF)


def q_status_updates(spark, sf):
    """The appointment table after the accepted cancellations."""
    done = q_cancel_admission(spark, sf).filter("accepted").select(
        F.col("appointment_id").alias("id"), "status", "notes", F.col("request_id").alias("update_id"))
    return RC.update_status(VW.appointments(spark, sf), done).select("id", "patient_email", "status", "notes")


def q_stored_cancellations(spark, sf):
    """J11 applied: the stored appointments, changed in the buckets of the accepted cancellations, read back."""
    a = VW.appointments(spark, sf)
    table = BucketedTable(spark, scratch_path(spark, "appointments"), "id", a.schema).create(a)
    done = q_cancel_admission(spark, sf).filter("accepted").select(
        F.col("appointment_id").alias("id"), "status", "notes", F.col("request_id").alias("update_id"))
    table.apply(done, RC.update_status)
    return table.read().select("id", "status", "notes")



def _events(spark, sf):
    return RC.record_changes(VW.submissions(spark, sf))


def q_record_changes(spark, sf):
    e = _events(spark, sf)
    return e.select("patient_email", "event_id", "prev_id", "changed_at",
                    _j(F.col("changes.field"), ", ").alias("changed_fields"),
                    F.size("changes").alias("n_changes"))


def q_history_topn(spark, sf):
    e = RC.history_top_n(_events(spark, sf), 20)
    return e.select("patient_email", "event_id", "changed_at", "rn", F.size("changes").alias("n_changes"))


def q_changes_exploded(spark, sf):
    return RC.change_lines(_events(spark, sf), 10, 20)


def patch_rows(spark, sf) -> DataFrame:
    """Clinical updates derived from the submissions, some fields nulled, and first
    updates of accounts that may have no document yet."""
    s = SC.parse_details(VW.submissions(spark, sf))
    bp = F.col("d.blood_pressure")
    from ..functions import vitals as V

    p = V.parse_bp(bp)
    i = F.col("id")
    none = F.lit(None)
    first = VW.users(spark, sf).filter((F.col("role") == "patient") & (F.col("id") % 7 == 0)).select(
        "email", F.lit(AS_OF).cast("timestamp").alias("submitted_at"), F.col("id"), F.lit(40).alias("p_age"),
        none.cast("string").alias("p_gender"), none.cast("string").alias("p_symptoms"),
        none.cast("double").alias("p_bmi"), none.cast("double").alias("p_glucose"),
        none.cast("string").alias("p_glucose_type"), none.cast("double").alias("p_systolic"),
        none.cast("double").alias("p_diastolic"), F.lit(170.0).alias("p_height_cm"), none.cast("double").alias("p_weight_kg"))
    return first.unionByName(s.select(
        "email", "submitted_at", "id",
        F.when(i % 2 == 0, F.col("d.age")).alias("p_age"),
        F.when(i % 4 != 0, F.col("d.gender")).alias("p_gender"),
        F.when(i % 5 != 0, F.col("d.symptoms")).alias("p_symptoms"),
        F.when(i % 2 == 1, F.col("d.bmi")).alias("p_bmi"),
        F.col("d.glucose").alias("p_glucose"),
        F.when(i % 6 == 3, F.lit("random")).alias("p_glucose_type"),
        p["systolic"].alias("p_systolic"), p["diastolic"].alias("p_diastolic"),
        F.when(i % 4 == 1, F.col("d.height_cm") + 1).alias("p_height_cm"),
        F.when(i % 3 == 1, F.col("d.weight_kg")).alias("p_weight_kg")))


def q_merge_patch(spark, sf):
    m = RC.merge_patch(_details(spark, sf), patch_rows(spark, sf), VW.users(spark, sf))
    return m.withColumn("changed_fields", _j(F.col("changed_fields"), ", "))


def q_doctor_appointments(spark, sf):
    a = VW.appointments(spark, sf).filter(F.col("doctor_email").isNotNull())
    return AN.rank_newest_first(a, "doctor_email").select("id", "doctor_email", "scheduled_for", "status",
                                                          "rank_in_key")


def q_dashboard_worklist(spark, sf):
    d = dashboard_rows(spark, sf)
    return d.select("id", "patient_email", "bucket", "triage_level", "show_on_top", "level_rank",
                    "predicted_risk_level", "scheduled_for").orderBy(
        "bucket", F.desc("show_on_top"), "level_rank", "scheduled_for", "id")


def q_dashboard_stats(spark, sf):
    d = dashboard_rows(spark, sf).filter(F.col("bucket") == "upcoming")
    lv = F.col("triage_level")
    return d.agg(F.count_if(lv == "Critical").alias("critical"), F.count_if(lv == "High").alias("high"),
                 F.count_if(lv == "Moderate").alias("moderate"), F.count_if(lv == "Low").alias("low"),
                 F.count_if(lv == "Needs vitals").alias("needs_vitals"))


def q_patient_worklist(spark, sf):
    return AN.patient_worklist(VW.appointments(spark, sf), AS_OF, 10)


def _upcoming(spark, sf):
    return dashboard_rows(spark, sf).filter(F.col("bucket") == "upcoming")


def q_doctor_kpis(spark, sf):
    return AN.doctor_kpis(_upcoming(spark, sf), AS_OF)


def q_risk_share(spark, sf):
    return AN.risk_share(AN.doctor_kpis(_upcoming(spark, sf), AS_OF))


def q_doctor_insights(spark, sf):
    # the scored upcoming list feeds three top-k lists: materialise it once in
    # the shared checkpoint folder instead of scoring it three times
    up = _upcoming(spark, sf).select("id", "patient_email", "scheduled_for", "doctor_email", "predicted_risk_level",
                                     "created_at").checkpoint(eager=True)
    return AN.doctor_insights(up, AS_OF)


def q_doctor_filtered(spark, sf):
    """A6 over the past view: high-risk rows of the last 30 days, newest first."""
    # Filters on the derived risk label would be pushed down by substituting the
    # whole scoring expression into scan predicates; the scored dashboard table
    # is materialised first (shared checkpoint folder), then filtered.
    d = dashboard_rows(spark, sf).select("id", "patient_email", "scheduled_for", "doctor_email",
                                         "predicted_risk_level", "bucket").checkpoint(eager=True)
    d = d.filter(F.col("bucket") == "past")
    return AN.filtered_for_doctor(d, AS_OF, risk="high", window="30d", past=True).select(
        "doctor_email", "id", "patient_email", "scheduled_for", "predicted_risk_level")


def q_date_window_counts(spark, sf):
    return AN.window_counts(VW.appointments(spark, sf), AS_OF)


def q_emergency_hours(spark, sf):
    a = VW.appointments(spark, sf)
    return a.select("id", "scheduled_for", F.date_format("scheduled_for", "HH:mm").alias("hhmm"),
                    AN.emergency_only_time(F.col("scheduled_for")).alias("emergency_only"))


def q_registration_uniqueness(spark, sf):
    u = VW.users(spark, sf)
    batch = u.filter(F.col("role") == "patient").withColumn(
        "full_name", F.trim(F.regexp_replace("full_name", "[^A-Za-z]+", " ")))
    store = u.filter(F.col("role") != "patient")
    return AC.registration_uniqueness(batch, store, "id")


def q_field_validation(spark, sf):
    v = AC.validate_users(VW.users(spark, sf))
    return v.select("id", "email", _j(F.col("errors")).alias("errors"), "valid")


def q_request_validation(spark, sf):
    v = AC.validate_requests(VW.score_requests(spark, sf))
    return v.select("request_id", _j(F.col("violations"), ", ").alias("violations"), "valid")


def _form_rows(spark, sf, form) -> DataFrame:
    """Rows of a form, some of them with values out of its limits."""
    if form == "health_details":
        d = SC.parse_details(VW.submissions(spark, sf)).select("id", "email", "d.*")
        i = F.col("id")
        return d.select(
            i.alias("request_id"), "email", (F.col("age") + F.when(i % 10 == 0, 60).otherwise(0)).alias("age"), "gender",
            F.when(i % 8 != 0, F.col("symptoms")).otherwise(F.lit("")).alias("symptoms"),
            (i % 120).alias("symptom_count"), "glucose", "blood_pressure",
            (F.col("height_cm") * F.when(i % 9 == 0, 0).otherwise(1)).alias("height_cm"),
            (F.col("weight_kg") * F.when(i % 7 == 0, 10).otherwise(1)).alias("weight_kg"), "bmi", "smoking_habit",
            F.when(i % 5 != 0, F.lit("none")).alias("alcohol_habit"), (i % 30).alias("average_sleep_hours"),
            F.repeat(F.lit("x"), (i % 2100).cast("int")).alias("medical_history"),
            F.lit("no").alias("family_history_major_chronic_disease"))
    if form == "record_update":
        p = patch_rows(spark, sf)
        return p.select(
            F.col("id").alias("request_id"), F.col("email").alias("patient_email"),
            F.when(F.col("id") % 6 != 0, F.lit("n1@example.com")).otherwise(F.lit("n")).alias("updated_by_email"),
            F.when(F.col("id") % 4 == 0, "admin").otherwise("nurse").alias("updated_by_role"),
            F.col("p_age").alias("age"), F.col("p_gender").alias("gender"), F.col("p_height_cm").alias("height_cm"),
            (F.col("p_weight_kg") - 60).alias("weight_kg"), F.col("p_bmi").alias("bmi"), F.col("p_glucose").alias("glucose"),
            F.col("p_glucose_type").alias("glucose_type"), F.col("p_systolic").alias("systolic_bp"),
            F.col("p_diastolic").alias("diastolic_bp"))
    if form == "booking":
        return booking_requests(spark, sf)
    if form == "cancel":
        a = VW.appointments(spark, sf)
        return a.select(F.col("id").alias("request_id"), "patient_email",
                        F.when(F.col("id") % 9 != 0, F.col("id")).otherwise(F.lit(0)).alias("appointment_id"),
                        F.col("notes").alias("cancel_reason"))
    lv = VW.doctor_leaves(spark, sf)
    text = lambda c, fmt: F.date_format(c, fmt)
    return lv.select(F.col("id").alias("request_id"), "doctor_email", text("start_at", "yyyy-MM-dd'T'HH:mm").alias("start_at"),
                     F.when(F.col("id") % 3 == 0, text("end_at", "yyyy-MM")).otherwise(text("end_at", "yyyy-MM-dd"))
                     .alias("end_at"), F.repeat(F.lit("r"), (F.col("id") % 300).cast("int")).alias("reason"))


def q_form_validation(spark, sf):
    """J36 for the five stored forms: one row per request."""
    out = None
    for form in AC.FORM_RULES:
        v = AC.validate_form(_form_rows(spark, sf, form), form).select(
            F.lit(form).alias("form"), "request_id", _j(F.col("violations"), ", ").alias("violations"), "valid")
        out = v if out is None else out.unionByName(v)
    return out


def q_integrity_audit(spark, sf):
    return AC.integrity_audit(VW.users(spark, sf), VW.appointments(spark, sf), VW.submissions(spark, sf),
                              VW.doctor_leaves(spark, sf))


def q_cascade_delete(spark, sf):
    u = VW.users(spark, sf)
    deleted = u.filter((F.col("role") == "patient") & (F.col("id") % 50 == 0))
    tables = {
        "health_details": (RC.latest_details(VW.submissions(spark, sf)), "email"),
        "appointments": (VW.appointments(spark, sf), "patient_email"),
        "health_details_submissions": (VW.submissions(spark, sf), "email"),
    }
    after = AC.cascade_delete(deleted, tables)
    before = AC.table_inventory({k: v[0] for k, v in tables.items()}).withColumnRenamed("row_count", "before_rows")
    aft = AC.table_inventory(after).withColumnRenamed("row_count", "after_rows")
    users_after = u.join(deleted.select("id", "role"), ["id", "role"], "left_anti")
    ub = AC.table_inventory({"users": u}).withColumnRenamed("row_count", "before_rows")
    ua = AC.table_inventory({"users": users_after}).withColumnRenamed("row_count", "after_rows")
    return before.join(aft, "table_name").unionByName(ub.join(ua, "table_name"))


def q_renumber_ids(spark, sf):
    return AC.renumber_ids(VW.users(spark, sf))


def q_next_ids(spark, sf):
    u = VW.users(spark, sf)
    per_role = u.groupBy(AC.safe_role(F.col("role")).alias("scope")).agg(
        (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))
    overall = u.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id")).select(F.lit("all").alias("scope"),
                                                                                   "next_id")
    leaves = VW.doctor_leaves(spark, sf).agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id")).select(
        F.lit("leave").alias("scope"), "next_id")
    return per_role.unionByName(overall).unionByName(leaves)


def q_seed_union(spark, sf):
    return AC.seed_union(VW.users(spark, sf), AC.seed_accounts(spark))


def legacy_files(spark, sf) -> list[DataFrame]:
    u = VW.users(spark, sf)
    ph = F.when(F.col("id") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("h"), F.col("id").cast("string")))
    base = u.select(F.col("id").alias("__row"), "full_name", "email", "phone", "role", ph.alias("password_hash"))
    return [
        base.filter((F.col("role") == "patient") & (F.col("__row") % 7 != 0)),
        base.filter(F.col("role") == "nurse"),
        base.filter(F.col("role") == "doctor"),
        base.withColumn("full_name", F.upper("full_name")).withColumn("role", F.upper("role")),
    ]


def q_bootstrap_import(spark, sf):
    return AC.bootstrap_import(legacy_files(spark, sf))


def q_table_inventory(spark, sf):
    subs = VW.submissions(spark, sf)
    return AC.table_inventory({
        "users": VW.users(spark, sf),
        "health_details": RC.latest_details(subs),
        "appointments": VW.appointments(spark, sf),
        "doctor_leaves": VW.doctor_leaves(spark, sf),
        "health_details_submissions": subs,
        "patient_record_history": RC.record_changes(subs),
        "doctors_ref": VW.doctors_ref(spark, sf),
    })


def q_truthy_count(spark, sf):
    return AC.truthy_count(VW.doctors_ref(spark, sf), "emergency_doctor", RC.TRUTHY)


RATE_WINDOW_SECONDS = 86400
RATE_LIMIT = 2


def q_rate_limit_breaches(spark, sf):
    r = RL.rate_limit_batch(VW.access_log(spark, sf), RATE_WINDOW_SECONDS, RATE_LIMIT)
    return r.select("event_id", "scope", "ip", "ts", "hits", "breach")


def registry_records():
    return {
        "users_with_details": q_users_with_details,
        "appointment_enriched": q_appointment_enriched,
        "leave_match": q_leave_match,
        "emergency_available": q_emergency_available,
        "directory": q_directory,
        "booking_admission": q_booking_admission,
        "cancel_admission": q_cancel_admission,
        "status_updates": q_status_updates,
        "stored_cancellations": q_stored_cancellations,
        "history_topn": q_history_topn,
        "record_changes": q_record_changes,
        "changes_exploded": q_changes_exploded,
        "merge_patch": q_merge_patch,
        "doctor_appointments": q_doctor_appointments,
        "dashboard_worklist": q_dashboard_worklist,
        "dashboard_stats": q_dashboard_stats,
        "patient_worklist": q_patient_worklist,
        "doctor_kpis": q_doctor_kpis,
        "risk_share": q_risk_share,
        "doctor_insights": q_doctor_insights,
        "date_window_counts": q_date_window_counts,
        "doctor_filtered": q_doctor_filtered,
        "emergency_hours": q_emergency_hours,
        "registration_uniqueness": q_registration_uniqueness,
        "field_validation": q_field_validation,
        "request_validation": q_request_validation,
        "form_validation": q_form_validation,
        "integrity_audit": q_integrity_audit,
        "cascade_delete": q_cascade_delete,
        "renumber_ids": q_renumber_ids,
        "next_ids": q_next_ids,
        "seed_union": q_seed_union,
        "bootstrap_import": q_bootstrap_import,
        "table_inventory": q_table_inventory,
        "truthy_count": q_truthy_count,
        "rate_limit_breaches": q_rate_limit_breaches,
    }
