"""Oracle SQL for the portal queries."""

from __future__ import annotations

from . import oracle_records as OR
from . import oracle_scoring as OS
from .fixture_sql import with_views
from .oracle import TOP_PAIR_CTE, clean_ctes, feature_ctes
from . import sqlparts as S


def _scoring_with() -> str:
    rq = "score_requests"
    return (f"WITH {OS._ref_prefix()},{OS.live_ctes(rq, 'request_id', True)},{OS.rule_model_cte()},"
            f"{OS.quick_ctes(rq, 'symptoms', 'request_id')},"
            "rs AS (SELECT request_id, model_group, CASE WHEN q_level = 'High' AND final_group IN ('Low', 'Moderate') "
            "THEN 'High' ELSE final_group END AS final_group, CASE WHEN q_level = 'High' AND final_group IN "
            "('Low', 'Moderate') THEN 'Urgent review recommended' ELSE final_booking END AS booking "
            "FROM fin2 JOIN qk USING (request_id))\n")


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    v = ("score_requests", "patients_raw")
    q["probability_bars"] = with_views(
        _scoring_with() + "SELECT request_id, label, pos, pct FROM (" + " UNION ALL ".join(
            f"SELECT request_id, '{lab}' AS label, {pos} AS pos, "
            f"CAST(greatest(0, least(100, floor(CASE WHEN model_group = '{lab}' THEN 1.0 ELSE 0.0 END * 100 + 0.5)))"
            f" AS INTEGER) AS pct FROM rs" for lab, pos in (("High", 2), ("Low", 0), ("Moderate", 1))) + ")", *v)
    kind = ("CASE WHEN coalesce(booking, '') = '' THEN '-' WHEN lower(final_group) IN ('critical', 'high') "
            "THEN 'Urgent appointment' WHEN lower(final_group) IN ('moderate', 'medium') THEN 'Priority appointment' "
            "ELSE 'Normal appointment' END")
    probs = ", ".join(f"CASE WHEN final_group = '{x}' THEN 1.0 ELSE 0.0 END AS prob_{x.lower()}"
                      for x in ("Low", "Moderate", "High", "Critical"))
    q["final_group_display"] = with_views(
        _scoring_with() + f"SELECT request_id, final_group, {kind} AS appointment_kind, {probs} FROM rs", *v)
    q["user_lookup"] = with_views(f"""
WITH r AS (SELECT id AS request_id, CASE WHEN id % 2 = 0 THEN upper(email) END AS email,
                  CASE WHEN id % 2 = 1 THEN phone END AS phone FROM users WHERE role = 'patient'),
be AS (SELECT lower(trim(email)) AS e, min_by(email, id) AS m FROM users GROUP BY 1),
bp AS (SELECT trim(coalesce(phone, '')) AS p, min_by(email, id) AS m FROM users
       WHERE {OR.phone_err('phone')} IS NULL GROUP BY 1),
j AS (SELECT r.request_id, be.m AS em, CASE WHEN {OR.phone_err('r.phone')} IS NULL THEN bp.m END AS pm
      FROM r LEFT JOIN be ON be.e = lower(trim(r.email)) LEFT JOIN bp ON bp.p = trim(r.phone))
SELECT request_id, coalesce(em, pm) AS matched_email,
       CASE WHEN em IS NOT NULL THEN 'email' WHEN pm IS NOT NULL THEN 'phone' END AS matched_by FROM j""", "users")
    q["leave_check"] = with_views(f"""
WITH {OR.DOCS_CTE}, {OR.VALID_LEAVES},
c AS (SELECT id, doctor_email, scheduled_for FROM appointments WHERE doctor_email IS NOT NULL),
b AS ({OR.best_leave('c', 'c.id', 'c.doctor_email', 'c.scheduled_for')}),
busy AS (SELECT DISTINCT c.id, l.doc FROM c JOIN vleaves l ON c.scheduled_for BETWEEN l.start_at AND l.end_at
         WHERE l.doc IN (SELECT lower(doctor_id) FROM docs WHERE emergency)),
cand AS (SELECT c.id, d.doctor_name, d.o
         FROM c CROSS JOIN (SELECT * FROM docs WHERE emergency) d
         WHERE NOT EXISTS (SELECT 1 FROM busy x WHERE x.id = c.id AND x.doc = lower(d.doctor_id))),
names AS (SELECT id, string_agg(doctor_name, ', ' ORDER BY o) AS nm, count(*) AS free FROM cand GROUP BY id)
SELECT c.id, b.leave_id IS NOT NULL AS on_leave, b.leave_id, b.leave_start, b.leave_end,
       coalesce(n.nm, '') AS emergency_doctors,
       coalesce(n.free, 0) AS emergency_available,
       CASE WHEN b.leave_id IS NOT NULL THEN 'Doctor is on leave for the selected date.'
            ELSE 'Doctor is available.' END AS message
FROM c LEFT JOIN b ON b.k = c.id LEFT JOIN names n ON n.id = c.id""",
        "appointments", "doctors_ref", "doctor_leaves")
    q["doctor_leaves_list"] = with_views(
        "SELECT id, doctor_email, start_at, end_at, row_number() OVER (PARTITION BY doctor_email "
        "ORDER BY start_at DESC, id DESC) AS rank_in_doctor FROM doctor_leaves", "doctor_leaves")
    q["leave_admission"] = with_views("""
WITH r AS (SELECT id AS request_id, doctor_email,
                  CASE WHEN id % 11 = 0 THEN 's0@example.com' ELSE doctor_email END AS requester_email,
                  CASE WHEN id % 7 = 0 THEN end_at ELSE start_at END AS start_at,
                  CASE WHEN id % 7 = 0 THEN start_at ELSE end_at END AS end_at FROM doctor_leaves),
d AS (SELECT *, CASE WHEN lower(trim(requester_email)) <> lower(trim(doctor_email))
                     THEN 'Doctors can only update their own leave calendar.'
                     WHEN end_at < start_at THEN 'Leave end time must be after start time.' END AS why FROM r)
SELECT request_id, why IS NULL AS accepted, why AS reject_reason,
       CASE WHEN why IS NULL THEN (SELECT coalesce(max(id), 0) FROM doctor_leaves)
            + row_number() OVER (PARTITION BY why IS NULL ORDER BY request_id, doctor_email, start_at, end_at) END
         AS new_leave_id,
       lower(trim(doctor_email)) AS doctor_email, start_at, end_at
FROM d""", "doctor_leaves")
    q["protected_fold"] = with_views("""
WITH f AS (SELECT lower(trim(email)) AS email, submitted_at, id, CASE WHEN id % 4 = 0 THEN 'clinical_update' ELSE 'patient_form' END AS source,
                  TRY_CAST(json_extract(payload_json, '$.glucose') AS DOUBLE) AS glucose,
                  json_extract_string(payload_json, '$.blood_pressure') AS blood_pressure FROM submissions)
SELECT email, submitted_at, id, source,
  last_value(CASE WHEN source = 'clinical_update' THEN glucose END IGNORE NULLS) OVER w AS stored_glucose,
  last_value(CASE WHEN source = 'clinical_update' THEN blood_pressure END IGNORE NULLS) OVER w AS stored_blood_pressure
FROM f WINDOW w AS (PARTITION BY email ORDER BY submitted_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "submissions")
    q["patient_directory"] = with_views(
        f"SELECT id, full_name, email FROM users WHERE {OR.safe_role('role')} = 'patient' AND "
        "(contains(lower(coalesce(full_name, '')), '000001') OR contains(lower(coalesce(email, '')), '000001'))",
        "users")
    base = "strftime(scheduled_for, '%Y-%m-%dT%H:%M:%S')"
    shifted = "strftime(scheduled_for + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S')"
    q["parse_times"] = with_views(
        f"WITH t AS (SELECT id, CASE WHEN id % 17 = 0 THEN 'not a time' WHEN id % 19 = 0 THEN '12:30' "
        f"WHEN id % 23 = 0 THEN '2024-01' WHEN id % 29 = 0 THEN '2024' WHEN id % 31 = 0 THEN '2024-01-05' WHEN id % 3 = 0 THEN {base} || 'Z' "
        f"WHEN id % 3 = 1 THEN {shifted} || '+05:30' ELSE {base} END AS text FROM appointments) "
        "SELECT id, text, CASE WHEN regexp_matches(trim(text), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') "
        "THEN CAST(TRY_CAST(trim(text) AS TIMESTAMPTZ) AS TIMESTAMP) END AS parsed FROM t", "appointments")
    RT = f"WITH {OR.risk_and_triage_prefix()},{OR.DASH_CTE}\n"
    q["nurse_search"] = with_views(
        RT + "SELECT id, patient_email, patient_name, triage_level, scheduled_for FROM dash WHERE bucket = 'upcoming' "
        "AND (contains(lower(coalesce(patient_name, '')), 'c1') OR contains(lower(coalesce(patient_email, '')), 'c1')) "
        "ORDER BY show_on_top DESC, level_rank, scheduled_for, id LIMIT 12",
        "appointments", "users", "submissions", "patients_raw")
    q["nurse_search_booked"] = with_views(
        RT + "SELECT id, patient_email, patient_name, triage_level, scheduled_for FROM dash WHERE bucket = 'past' "
        "AND (contains(lower(coalesce(patient_name, '')), 'c1') OR contains(lower(coalesce(patient_email, '')), 'c1')) "
        "ORDER BY scheduled_for, id LIMIT 16", "appointments", "users", "submissions", "patients_raw")
    q["nurse_search_patients"] = with_views(
        f"SELECT id, full_name, email AS patient_email FROM users WHERE {OR.safe_role('role')} = 'patient' AND "
        "(contains(lower(coalesce(full_name, '')), 'c1') OR contains(lower(coalesce(email, '')), 'c1')) "
        "ORDER BY lower(trim(full_name)), id LIMIT 12", "users")
    q["file_round_trip"] = with_views(
        "SELECT f.form, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(length(email) + length(full_name) + "
        "length(role)) AS BIGINT) AS text_length, count(*) FILTER (coalesce(phone, '') <> '') AS phones FROM users, "
        "(VALUES ('typed_csv'), ('csv_rows'), ('json_array'), ('users_csv'), ('export')) f(form) GROUP BY f.form", "users")
    q["doctor_choices"] = with_views(
        f"WITH {OR.DOCS_CTE}, {OR.VALID_LEAVES}, du AS (SELECT * FROM users WHERE role = 'doctor'), "
        f"b AS ({OR.best_leave('du', 'lower(trim(du.email))', 'du.email', OR.AS_OF)})\n"
        "SELECT du.email, du.full_name, coalesce(d.emergency, false) AS emergency_doctor, "
        "b.leave_id IS NOT NULL AS on_leave, coalesce(d.specialization, '') AS specialization "
        "FROM du LEFT JOIN docs d ON lower(d.doctor_id) = lower(trim(du.email)) "
        "LEFT JOIN b ON b.k = lower(trim(du.email))", "users", "doctors_ref", "doctor_leaves")
    q["patient_recent"] = with_views(
        "SELECT patient_email, rn, id, scheduled_for FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "
        "patient_email ORDER BY scheduled_for DESC, id DESC) AS INTEGER) AS rn FROM appointments) WHERE rn <= 10",
        "appointments")
    FB = f"WITH {clean_ctes('patients_raw')},{feature_ctes()}\n"
    q["target_distribution"] = with_views(
        FB + "SELECT Risk_Factor_Group AS label, count(*) AS n FROM featg WHERE Risk_Factor_Group IS NOT NULL "
        "GROUP BY 1", "patients_raw")
    lvl = ("CASE WHEN Age IS NULL OR Symptom_Count IS NULL THEN NULL ELSE CASE WHEN (CASE WHEN Age > 60 THEN 2 "
           "WHEN Age > 40 THEN 1 ELSE 0 END + CASE WHEN Symptom_Count >= 6 THEN 2 WHEN Symptom_Count >= 3 THEN 1 "
           "ELSE 0 END) <= 2 THEN 'Low' WHEN (CASE WHEN Age > 60 THEN 2 WHEN Age > 40 THEN 1 ELSE 0 END + "
           "CASE WHEN Symptom_Count >= 6 THEN 2 WHEN Symptom_Count >= 3 THEN 1 ELSE 0 END) <= 4 THEN 'Medium' "
           "ELSE 'High' END END")
    q["report_facts"] = with_views(
        FB.rstrip("\n") + f", m AS (SELECT {lvl} AS lvl FROM featg), k AS (SELECT lvl, count(*) AS n FROM m "
        "WHERE lvl IS NOT NULL GROUP BY lvl), t AS (SELECT CAST(sum(round_even(n * 0.2, 0)) AS BIGINT) AS test_rows "
        "FROM k) SELECT (SELECT count(*) FROM featg) AS feature_rows, (SELECT count(*) FROM m WHERE lvl IS NOT NULL) "
        "AS model_rows, (SELECT count(*) FROM m WHERE lvl IS NULL) AS dropped_rows, test_rows, "
        "(SELECT count(*) FROM m WHERE lvl IS NOT NULL) - test_rows AS train_rows FROM t", "patients_raw")

    def cnt(pat):
        s = "trim(coalesce(json_extract_string(payload_json, '$.symptoms'), ''))"
        return (f"CAST(CASE WHEN {s} = '' THEN 0 ELSE len(list_filter(list_transform(string_split_regex({s}, "
                f"'{pat}'), lambda x: trim(x)), lambda x: x <> '')) END AS INTEGER)")

    q["form_symptom_counts"] = with_views(
        f"SELECT id, {cnt('[,\\n]')} AS count_comma_newline, {cnt(',')} AS count_comma FROM submissions",
        "submissions")
    q["pair_columns"] = with_views(
        f"WITH {clean_ctes('patients_raw')},{feature_ctes()},{TOP_PAIR_CTE}\n"
        f"SELECT 'PAIR_' || {S.safe('first_symptom')} || '_' || {S.safe('second_symptom')} AS column_name, "
        "first_symptom, second_symptom FROM top_pair", "patients_raw")
    q["stream_scoring"] = with_views(
        f"WITH {OS.patient_risk_prefix(per_submission=True)}\n"
        "SELECT email, sub_id AS id, sub_at AS submitted_at, risk_level, risk_source, risk_booking_priority "
        "FROM prisk", "submissions", "patients_raw")
    q["feature_report"] = with_views(
        f"WITH {clean_ctes('patients_raw')},{feature_ctes()},{TOP_PAIR_CTE},"
        + __import__("carelake.plans.oracle", fromlist=["TOP_SYM_CTE"]).TOP_SYM_CTE.lstrip()
        + "\nSELECT (SELECT count(*) FROM clean) AS input_rows, (SELECT count(*) FROM featg) AS output_rows, "
        "CAST(40 + (SELECT count(*) FROM top_sym) + (SELECT count(*) FROM top_pair) AS INTEGER) AS total_columns",
        "patients_raw")
    return q
