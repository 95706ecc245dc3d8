"""Oracle SQL for the clinic-table queries (J-, A-, S-series, T1 twin)."""

from __future__ import annotations

import re

from . import oracle_scoring as OS
from .fixture_sql import with_views

# The tracked fields in audit order, written out for the SQL side.
TRACKED_FIELDS = [
    "age", "gender", "symptoms", "symptom_count", "height_cm", "weight_kg", "bmi", "smoking_habit", "alcohol_habit",
    "average_sleep_hours", "medical_history", "family_history_major_chronic_disease", "glucose", "glucose_type",
    "blood_pressure",
]
NUMERIC_FIELDS = ("age", "symptom_count", "height_cm", "weight_kg", "bmi", "average_sleep_hours", "glucose")

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"
AS_OF_DATE = "CAST(DATE '1998-06-01' AS TIMESTAMP)"

_CTE_NAMES = ["lv0", "lv1", "lv2", "lv", "lvc", "qk0", "qk1", "qk2", "qk", "nt0", "nt1", "nt1q", "nt2", "nt", "rm",
              "fin", "fin2", "det", "din", "pr", "pr2", "prisk", "latest"]


def prefixed(sql: str, p: str, keep: tuple[str, ...] = ("latest",)) -> str:
    names = [n for n in _CTE_NAMES if n not in keep]
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: p + m.group(1), sql)


def triage_ctes(p: str = "t_") -> str:
    """Per-patient nurse triage (N10) as CTE ``{p}nt`` keyed by email (needs ref + latest)."""
    body = (f"{OS.details_inputs_cte(True)},{OS.live_ctes('din', 'email', True)},"
            f"{OS.quick_ctes('din', 'CAST(symptoms AS VARCHAR)', 'email')},{OS.nurse_sql('din', 'email')}")
    return prefixed(body, p)


def risk_and_triage_prefix() -> str:
    return f"{OS.patient_risk_prefix()},{triage_ctes()}"


def phone_err(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return (f"(CASE WHEN {t} = '' THEN 'Phone number must be exactly 10 digits.' "
            f"WHEN NOT regexp_matches({t}, '^\\d+$') THEN 'Phone number must contain digits only (0-9).' "
            f"WHEN NOT regexp_matches({t}, '^\\d{{10}}$') THEN 'Phone number must be exactly 10 digits.' END)")


def email_err(x: str) -> str:
    e = f"lower(trim(coalesce({x}, '')))"
    return (f"(CASE WHEN {e} = '' OR length({e}) > 254 OR NOT regexp_matches({e}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') "
            f"THEN 'Invalid email format.' END)")


def name_err(x: str) -> str:
    n = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    return (f"(CASE WHEN length({n}) < 2 OR length({n}) > 100 THEN 'Full name must be 2-100 characters long.' "
            f"WHEN NOT regexp_matches({n}, '^[A-Za-z]+(?: [A-Za-z]+)*$') "
            f"THEN 'Full name must contain only letters and spaces.' END)")


def role_err(x: str) -> str:
    return (f"(CASE WHEN lower(trim(coalesce({x}, ''))) NOT IN ('patient', 'nurse', 'doctor') "
            f"THEN 'Invalid role selected.' END)")


def safe_role(x: str) -> str:
    r = f"lower(trim(coalesce({x}, '')))"
    return f"(CASE WHEN {r} IN ('patient', 'nurse', 'doctor') THEN {r} ELSE 'patient' END)"


def norm_risk(x: str) -> str:
    s = f"lower(coalesce({x}, ''))"
    return (f"(CASE WHEN contains({s}, 'high') THEN 'high' WHEN contains({s}, 'medium') OR contains({s}, 'moderate') "
            f"THEN 'medium' WHEN contains({s}, 'low') THEN 'low' ELSE 'unknown' END)")


DOCS_CTE = """
docs AS (
  SELECT trim(doctor_id) AS doctor_id, coalesce(nullif(trim(doctor_name), ''), trim(doctor_id)) AS doctor_name,
         trim(coalesce(specialization, '')) AS specialization, trim(coalesce(available_time, '')) AS available_time,
         lower(trim(coalesce(emergency_doctor, ''))) IN ('yes', 'true', '1', 'y') AS emergency,
         row_number() OVER (ORDER BY seq, doctor_id) AS o
  FROM doctors_ref WHERE trim(doctor_id) <> '')"""

VALID_LEAVES = """
vleaves AS (SELECT id, lower(trim(doctor_email)) AS doc, start_at, end_at FROM doctor_leaves
            WHERE start_at IS NOT NULL AND end_at IS NOT NULL AND end_at >= start_at)"""


def best_leave(src: str, key: str, doc: str, when: str) -> str:
    return f"""
SELECT {key} AS k, max_by(l.id, (l.start_at, l.id)) AS leave_id, max_by(l.start_at, (l.start_at, l.id)) AS leave_start,
       max_by(l.end_at, (l.start_at, l.id)) AS leave_end
FROM {src} JOIN vleaves l ON l.doc = lower(trim({doc})) AND {when} BETWEEN l.start_at AND l.end_at
GROUP BY {key}"""


DASH_CTE = f"""
dash AS (
  SELECT a.id, a.patient_email, coalesce(u.full_name, a.patient_email) AS patient_name, a.scheduled_for,
         coalesce(a.status, 'Pending') AS status, a.doctor_email, a.created_at,
         p.risk_level AS predicted_risk_level, t.level AS triage_level, coalesce(t.show_on_top, false) AS show_on_top,
         CASE WHEN a.scheduled_for >= {AS_OF} AND coalesce(a.status, 'Pending') IN ('Pending', 'Confirmed')
              THEN 'upcoming' ELSE 'past' END AS bucket,
         CASE coalesce(t.level, '') WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 3
              WHEN 'Needs vitals' THEN 4 ELSE 9 END AS level_rank
  FROM appointments a LEFT JOIN prisk p ON p.email = a.patient_email LEFT JOIN t_nt t ON t.email = a.patient_email
  LEFT JOIN users u ON u.email = a.patient_email),
up AS (SELECT * FROM dash WHERE bucket = 'upcoming' AND doctor_email IS NOT NULL AND doctor_email <> '')"""


def _fwd(ts, days):
    return f"({ts} >= {AS_OF_DATE} AND {ts} < {AS_OF_DATE} + INTERVAL {days} DAY)"


def _past(ts, days):
    end = f"({AS_OF_DATE} + INTERVAL 1 DAY)"
    return f"({ts} >= {end} - INTERVAL {days} DAY AND {ts} < {end})"


def _audit(field: str, src: str) -> str:
    if field in NUMERIC_FIELDS:
        return f"CAST(TRY_CAST(json_extract({src}, '$.{field}') AS DOUBLE) AS VARCHAR)"
    return f"nullif(trim(json_extract_string({src}, '$.{field}')), '')"


def _disp(v: str, field: str) -> str:
    if field in NUMERIC_FIELDS:
        x = f"TRY_CAST({v} AS DOUBLE)"
        return (f"(CASE WHEN {v} IS NULL THEN '-' WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) "
                f"ELSE {v} END)")
    return f"(CASE WHEN {v} IS NULL OR {v} = '' THEN '-' ELSE {v} END)"


def changes_cte() -> str:
    items = []
    for f in TRACKED_FIELDS:
        old = f"CASE WHEN prev_json IS NULL THEN NULL ELSE {_audit(f, 'prev_json')} END"
        new = _audit(f, "payload_json")
        items.append(f"CASE WHEN ({old}) IS DISTINCT FROM ({new}) THEN {{'field': '{f}', 'from': {old}, 'to': {new}}} END")
    lst = "[" + ", ".join(items) + "]"
    return f"""
sub0 AS (
  SELECT * REPLACE (lower(trim(email)) AS email),
         lag(payload_json) OVER (PARTITION BY lower(trim(email)) ORDER BY submitted_at, id) AS prev_json,
         lag(id) OVER (PARTITION BY lower(trim(email)) ORDER BY submitted_at, id) AS prev_id
  FROM submissions WHERE trim(email) <> ''),
ev0 AS (SELECT email AS patient_email, id AS event_id, prev_id, submitted_at AS changed_at, payload_json, prev_json,
               list_filter({lst}, lambda c: c IS NOT NULL) AS ch FROM sub0),
ev AS (SELECT * FROM ev0 WHERE len(ch) > 0)"""


_SNAP_TYPES = {"age": "INTEGER", "symptom_count": "INTEGER", "height_cm": "DOUBLE", "weight_kg": "DOUBLE",
               "bmi": "DOUBLE", "average_sleep_hours": "DOUBLE", "glucose": "DOUBLE"}


def _snapshot_json(src: str) -> str:
    """J19 snapshot as the JSON text Spark's to_json writes for a string map."""
    items = []
    for f in TRACKED_FIELDS:
        if f in _SNAP_TYPES:
            v = f"CAST(TRY_CAST(json_extract({src}, '$.{f}') AS {_SNAP_TYPES[f]}) AS VARCHAR)"
        else:
            v = f"json_extract_string({src}, '$.{f}')"
        items.append(f"CASE WHEN {v} IS NOT NULL AND {v} <> '' THEN '\"{f}\":\"' || {v} || '\"' END")
    return "('{' || array_to_string(list_filter([" + ", ".join(items) + "]::VARCHAR[], lambda x: x IS NOT NULL), ',') || '}')"


def _changes_json() -> str:
    item = ("'{\"field\":\"' || c.field || '\"' || CASE WHEN c.\"from\" IS NOT NULL THEN ',\"from\":\"' || c.\"from\" "
            "|| '\"' ELSE '' END || CASE WHEN c.\"to\" IS NOT NULL THEN ',\"to\":\"' || c.\"to\" || '\"' ELSE '' END || '}'")
    return f"('[' || array_to_string(list_transform(ch, lambda c: {item}), ',') || ']')"


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    L = OS.LATEST_CTE
    q["users_with_details"] = with_views(
        f"WITH {L} SELECT u.id, u.full_name, u.email, coalesce(u.phone, '') AS phone, u.role, "
        "l.email IS NOT NULL AS health_details_completed, l.submitted_at AS details_submitted_at "
        "FROM users u LEFT JOIN latest l ON l.email = u.email", "users", "submissions")
    q["appointment_enriched"] = with_views(
        f"WITH {OS.patient_risk_prefix()}\n"
        "SELECT a.id, a.patient_email, coalesce(u.full_name, a.patient_email) AS patient_name, a.scheduled_for, "
        "coalesce(a.status, 'Pending') AS status, a.appointment_type, a.doctor_email, "
        "p.risk_level AS predicted_risk_level, p.risk_source AS predicted_risk_source, "
        "p.risk_booking_priority AS booking_priority, l.submitted_at AS health_details_submitted_at, "
        "coalesce(nullif(a.reason, ''), nullif(a.appointment_type, ''), '') AS reason, "
        "a.contact_info, a.priority, a.notes, a.created_at "
        "FROM appointments a LEFT JOIN users u ON u.email = a.patient_email "
        "LEFT JOIN prisk p ON p.email = a.patient_email LEFT JOIN latest l ON l.email = a.patient_email",
        "appointments", "users", "submissions", "patients_raw")
    q["leave_match"] = with_views(
        f"WITH {VALID_LEAVES}, b AS ({best_leave('appointments a', 'a.id', 'a.doctor_email', 'a.scheduled_for')})\n"
        "SELECT a.id, a.doctor_email, a.scheduled_for, b.leave_id IS NOT NULL AS on_leave, b.leave_id, "
        "b.leave_start, b.leave_end FROM appointments a LEFT JOIN b ON b.k = a.id WHERE a.doctor_email IS NOT NULL",
        "appointments", "doctor_leaves")
    q["emergency_available"] = with_views(
        f"WITH {DOCS_CTE}, {VALID_LEAVES}\n"
        "SELECT doctor_id, doctor_name FROM docs WHERE emergency AND lower(doctor_id) NOT IN "
        f"(SELECT doc FROM vleaves WHERE {AS_OF} BETWEEN start_at AND end_at)", "doctors_ref", "doctor_leaves")
    q["directory"] = with_views(
        f"WITH {DOCS_CTE}, {VALID_LEAVES}, {L}, du AS (SELECT * FROM users WHERE role = 'doctor'), "
        f"b AS ({best_leave('du', 'lower(trim(du.email))', 'du.email', AS_OF)})\n"
        "SELECT du.full_name, du.email, du.role, l.email IS NOT NULL AS health_details_completed, "
        "coalesce(d.specialization, '') AS specialization, coalesce(d.available_time, '') AS available_time, "
        "coalesce(d.emergency, false) AS emergency_doctor, b.leave_id IS NOT NULL AS on_leave, "
        "b.leave_id IS NULL AS available, b.leave_id "
        "FROM du LEFT JOIN docs d ON lower(d.doctor_id) = lower(trim(du.email)) "
        "LEFT JOIN b ON b.k = lower(trim(du.email)) LEFT JOIN latest l ON l.email = du.email",
        "users", "doctors_ref", "doctor_leaves", "submissions")
    q["booking_admission"] = with_views(f"""
WITH {DOCS_CTE}, {VALID_LEAVES},
req AS (SELECT a.id AS request_id, a.patient_email, a.scheduled_for, a.appointment_type, a.doctor_email,
               nullif(a.reason, '') AS reason, a.notes, u.phone AS contact_info
        FROM appointments a LEFT JOIN users u ON u.email = a.patient_email),
b AS ({best_leave('req r', 'r.request_id', 'r.doctor_email', 'r.scheduled_for')}),
onl AS (SELECT r.* FROM req r JOIN b ON b.k = r.request_id),
busy AS (SELECT DISTINCT r.request_id, l.doc FROM onl r JOIN vleaves l ON r.scheduled_for BETWEEN l.start_at AND l.end_at
         WHERE l.doc IN (SELECT lower(doctor_id) FROM docs WHERE emergency)),
cand AS (SELECT r.request_id, d.doctor_name, d.o,
                row_number() OVER (PARTITION BY r.request_id ORDER BY d.o) AS rn
         FROM onl r CROSS JOIN (SELECT * FROM docs WHERE emergency) d
         WHERE NOT EXISTS (SELECT 1 FROM busy x WHERE x.request_id = r.request_id AND x.doc = lower(d.doctor_id))),
names AS (SELECT request_id, string_agg(doctor_name, ', ' ORDER BY o) AS nm FROM cand WHERE rn <= 3 GROUP BY request_id),
dec AS (
  SELECT r.*, CASE
    WHEN u.role IS NULL OR u.role <> 'patient' THEN 'Patient account not found.'
    WHEN r.doctor_email IS NOT NULL AND b.leave_id IS NOT NULL THEN 'Selected doctor is on leave for that date.'
         || CASE WHEN coalesce(n.nm, '') <> '' THEN ' Emergency doctors: ' || n.nm || '.' ELSE '' END
    ELSE {phone_err('r.contact_info')} END AS why
  FROM req r LEFT JOIN users u ON lower(trim(u.email)) = lower(trim(r.patient_email))
  LEFT JOIN b ON b.k = r.request_id LEFT JOIN names n ON n.request_id = r.request_id)
SELECT request_id, why IS NULL AS accepted, why AS reject_reason,
       CASE WHEN why IS NULL THEN 'Pending' END AS status,
       CASE WHEN why IS NULL THEN trim(coalesce(reason, appointment_type)) END AS reason,
       CASE WHEN why IS NULL THEN trim(contact_info) END AS contact_info,
       CASE WHEN why IS NULL THEN lower(trim(doctor_email)) END AS doctor_email,
       CASE WHEN why IS NULL THEN lower(trim(patient_email)) END AS patient_email,
       CASE WHEN why IS NULL THEN scheduled_for END AS scheduled_for,
       CASE WHEN why IS NULL THEN trim(appointment_type) END AS appointment_type,
       CAST(NULL AS VARCHAR) AS priority,
       CASE WHEN why IS NULL AND notes <> '' THEN trim(notes) END AS notes,
       CASE WHEN why IS NULL THEN {AS_OF} END AS created_at
FROM dec""", "appointments", "users", "doctors_ref", "doctor_leaves")
    cancelled = f"""dec AS (
  SELECT a.id, a.patient_email, a.status, a.notes AS stored, CASE
    WHEN u.role IS NULL OR u.role <> 'patient' THEN 'Patient account not found.'
    WHEN lower(coalesce(a.status, 'Pending')) IN ('cancelled', 'canceled', 'completed')
      THEN 'This appointment cannot be cancelled.'
    WHEN a.scheduled_for < {AS_OF} THEN 'Past appointments cannot be cancelled.' END AS why
  FROM appointments a LEFT JOIN users u ON lower(trim(u.email)) = lower(trim(a.patient_email))),
can AS (
  SELECT *, CASE WHEN why IS NULL THEN 'Cancelled' ELSE status END AS new_status,
         CASE WHEN why IS NULL AND id % 2 = 0 THEN left(concat_ws(chr(10), nullif(trim(stored), ''),
              'Cancelled: Schedule conflict'), 1000) ELSE stored END AS new_notes FROM dec)"""
    q["cancel_admission"] = with_views(f"""
WITH {cancelled}
SELECT id AS request_id, id AS appointment_id, why IS NULL AS accepted, why AS reject_reason,
       new_status AS status, new_notes AS notes FROM can""", "appointments", "users")
    q["status_updates"] = with_views(f"""
WITH {cancelled}
SELECT id, patient_email, new_status AS status, new_notes AS notes FROM can""", "appointments", "users")
    ev = changes_cte()
    q["stored_cancellations"] = f"SELECT id, status, notes FROM ({q['status_updates']}) AS s"
    q["record_changes"] = with_views(
        f"WITH {ev} SELECT patient_email, event_id, prev_id, changed_at, "
        "array_to_string(list_transform(ch, lambda c: c.field), ', ') AS changed_fields, "
        "CAST(len(ch) AS INTEGER) AS n_changes FROM ev", "submissions")
    q["history_rows"] = with_views(
        f"WITH {ev} SELECT patient_email, event_id, changed_at, patient_email AS changed_by_email, "
        "'patient' AS changed_by_role, 'patient_form' AS source, "
        f"{_changes_json()} AS changes_json, CASE WHEN prev_json IS NULL THEN '{{}}' ELSE "
        f"{_snapshot_json('prev_json')} END AS before_json, {_snapshot_json('payload_json')} AS after_json FROM ev",
        "submissions")
    q["history_topn"] = with_views(
        f"WITH {ev}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY patient_email ORDER BY changed_at DESC, "
        "event_id DESC) AS INTEGER) AS rn FROM ev) SELECT patient_email, event_id, changed_at, rn, "
        "CAST(len(ch) AS INTEGER) AS n_changes FROM r WHERE rn <= 20", "submissions")
    disp = "CASE c.field " + " ".join(
        f"WHEN '{f}' THEN {_disp('c.from', f)} || ' -> ' || {_disp('c.to', f)}" for f in TRACKED_FIELDS) + " END"
    q["changes_exploded"] = with_views(
        f"WITH {ev}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY patient_email ORDER BY changed_at DESC, "
        "event_id DESC) AS INTEGER) AS rn FROM ev), r10 AS (SELECT * FROM r WHERE rn <= 10), "
        "x AS (SELECT patient_email, event_id, rn, unnest(range(1, least(len(ch), 20) + 1)) AS pos, ch FROM r10), "
        "y AS (SELECT patient_email, event_id, rn, CAST(pos AS INTEGER) AS pos, ch[pos] AS c FROM x) "
        f"SELECT patient_email, event_id, rn, pos, '  - ' || c.field || ': ' || ({disp}) AS line FROM y",
        "submissions")
    q["merge_patch"] = with_views(merge_patch_sql(), "submissions", "users")
    q["doctor_appointments"] = with_views(
        "SELECT id, doctor_email, scheduled_for, status, row_number() OVER (PARTITION BY doctor_email "
        "ORDER BY scheduled_for DESC, id DESC) AS rank_in_key FROM appointments WHERE doctor_email IS NOT NULL",
        "appointments")
    RT = f"WITH {risk_and_triage_prefix()},{DASH_CTE}\n"
    views_rt = ("appointments", "users", "submissions", "patients_raw")
    q["dashboard_worklist"] = with_views(
        RT + "SELECT id, patient_email, bucket, triage_level, show_on_top, level_rank, predicted_risk_level, "
        "scheduled_for FROM dash", *views_rt)
    q["dashboard_stats"] = with_views(
        RT + "SELECT count(*) FILTER (WHERE triage_level = 'Critical') AS critical, "
        "count(*) FILTER (WHERE triage_level = 'High') AS high, "
        "count(*) FILTER (WHERE triage_level = 'Moderate') AS moderate, "
        "count(*) FILTER (WHERE triage_level = 'Low') AS low, "
        "count(*) FILTER (WHERE triage_level = 'Needs vitals') AS needs_vitals FROM dash WHERE bucket = 'upcoming'",
        *views_rt)
    nr = norm_risk("predicted_risk_level")
    kpi = (f"SELECT lower(doctor_email) AS doctor_email, "
           "count(DISTINCT CASE WHEN patient_email <> '' THEN lower(patient_email) END) AS patients, "
           f"count(*) AS appointments, count(*) FILTER (WHERE {nr} = 'high') AS high, "
           f"count(*) FILTER (WHERE {nr} = 'medium') AS medium, count(*) FILTER (WHERE {nr} = 'low') AS low, "
           f"count(*) FILTER (WHERE {_fwd('scheduled_for', 1)}) AS today FROM up GROUP BY lower(doctor_email)")
    q["doctor_kpis"] = with_views(RT + kpi, *views_rt)
    pct = "CAST(CASE WHEN appointments > 0 THEN floor({c} / appointments * 100 + 0.5) ELSE 0 END AS INTEGER)"
    hd = "CASE WHEN appointments > 0 THEN high / appointments * 360 ELSE 0.0 END"
    md = "CASE WHEN appointments > 0 THEN medium / appointments * 360 ELSE 0.0 END"
    q["risk_share"] = with_views(
        RT.rstrip("\n") + f", k AS ({kpi})\nSELECT doctor_email, appointments AS total, {pct.format(c='high')} AS high_pct, "
        f"{pct.format(c='medium')} AS medium_pct, {pct.format(c='low')} AS low_pct, round({hd}, 4) AS high_deg, "
        f"round({md}, 4) AS medium_deg, round(CASE WHEN appointments > 0 THEN greatest(0.0, 360 - ({hd}) - ({md})) "
        "ELSE 0.0 END, 4) AS low_deg FROM k", *views_rt)
    q["doctor_insights"] = with_views(
        RT.rstrip("\n") + f""",
u2 AS (SELECT lower(doctor_email) AS doctor_email, id, patient_email, scheduled_for, created_at, {nr} AS r,
              {_fwd('scheduled_for', 1)} AS is_today FROM up),
h AS (SELECT *, row_number() OVER (PARTITION BY doctor_email ORDER BY scheduled_for, id) AS rn FROM u2 WHERE r = 'high'),
t AS (SELECT *, row_number() OVER (PARTITION BY doctor_email ORDER BY scheduled_for, id) AS rn FROM u2 WHERE is_today),
c AS (SELECT *, row_number() OVER (PARTITION BY doctor_email ORDER BY coalesce(created_at, scheduled_for) DESC, id DESC)
      AS rn FROM u2)
SELECT doctor_email, 'high' AS list, CAST(rn AS INTEGER) AS rn, id, patient_email, scheduled_for FROM h WHERE rn <= 5
UNION ALL SELECT doctor_email, 'today', CAST(rn AS INTEGER), id, patient_email, scheduled_for FROM t WHERE rn <= 5
UNION ALL SELECT doctor_email, 'recent', CAST(rn AS INTEGER), id, patient_email, scheduled_for FROM c WHERE rn <= 6""",
        *views_rt)
    q["doctor_filtered"] = with_views(
        RT + f"SELECT lower(doctor_email) AS doctor_email, id, patient_email, scheduled_for, predicted_risk_level "
        f"FROM dash WHERE bucket = 'past' AND doctor_email IS NOT NULL AND doctor_email <> '' AND {nr} = 'high' "
        f"AND {_past('scheduled_for', 30)}", *views_rt)
    wc = ", ".join(f"count(*) FILTER (WHERE {_fwd('scheduled_for', d)}) AS next_{k}, "
                   f"count(*) FILTER (WHERE {_past('scheduled_for', d)}) AS past_{k}"
                   for k, d in (("today", 1), ("7d", 7), ("30d", 30)))
    q["patient_worklist"] = with_views(f"""
WITH b AS (SELECT *, CASE WHEN scheduled_for >= {AS_OF} AND (status IN ('Pending', 'Confirmed') OR status IS NULL
                                                          OR status = '') THEN 'upcoming' ELSE 'past' END AS bucket
           FROM appointments),
r AS (SELECT *, CAST(CASE WHEN bucket = 'upcoming'
                          THEN row_number() OVER (PARTITION BY patient_email, bucket ORDER BY scheduled_for, id)
                          ELSE row_number() OVER (PARTITION BY patient_email, bucket ORDER BY scheduled_for DESC, id DESC)
                     END AS INTEGER) AS rn FROM b)
SELECT patient_email, bucket, rn, id, scheduled_for, status FROM r WHERE rn <= 10""", "appointments")
    q["date_window_counts"] = with_views(
        f"SELECT lower(doctor_email) AS doctor_email, count(*) AS all_count, {wc} FROM appointments "
        "WHERE doctor_email IS NOT NULL AND doctor_email <> '' GROUP BY lower(doctor_email)", "appointments")
    q["emergency_hours"] = with_views(
        "SELECT id, scheduled_for, strftime(scheduled_for, '%H:%M') AS hhmm, "
        "(strftime(scheduled_for, '%H:%M') >= '22:00' OR strftime(scheduled_for, '%H:%M') < '06:00') "
        "AS emergency_only FROM appointments", "appointments")
    q["registration_uniqueness"] = with_views(f"""
WITH b0 AS (SELECT id, trim(regexp_replace(full_name, '[^A-Za-z]+', ' ', 'g')) AS full_name, email, phone, role
            FROM users WHERE role = 'patient'),
b AS (SELECT *, lower(trim(email)) AS e, trim(coalesce(phone, '')) AS p,
             coalesce({name_err('full_name')}, {email_err('email')}, {phone_err('phone')}, {role_err('role')}) AS fmt
      FROM b0),
fe AS (SELECT e, min(id) AS first_e FROM b WHERE fmt IS NULL GROUP BY e),
fp AS (SELECT p, min(id) AS first_p FROM b WHERE fmt IS NULL GROUP BY p),
se AS (SELECT DISTINCT lower(trim(email)) AS e FROM users WHERE role <> 'patient'),
sp AS (SELECT DISTINCT trim(phone) AS p FROM users WHERE role <> 'patient' AND phone IS NOT NULL AND phone <> ''),
r AS (
  SELECT b.id, b.e, b.p, coalesce(b.fmt,
      CASE WHEN se.e IS NOT NULL OR fe.first_e < b.id THEN 'An account with this email already exists.' END,
      CASE WHEN sp.p IS NOT NULL OR fp.first_p < b.id THEN 'An account with this phone number already exists.' END)
    AS why
  FROM b LEFT JOIN fe ON fe.e = b.e LEFT JOIN fp ON fp.p = b.p LEFT JOIN se ON se.e = b.e LEFT JOIN sp ON sp.p = b.p)
SELECT id, e AS email, p AS phone, why IS NULL AS accepted, why AS reject_reason FROM r""", "users")
    errs = (f"list_filter([{name_err('full_name')}, {email_err('email')}, {phone_err('phone')}, "
            f"{role_err('role')}]::VARCHAR[], lambda v: v IS NOT NULL)")
    q["field_validation"] = with_views(
        f"SELECT id, email, array_to_string({errs}, ' | ') AS errors, len({errs}) = 0 AS valid FROM users", "users")
    viol = ("list_filter([CASE WHEN age IS NULL OR age < 0 OR age > 120 THEN 'age' END, "
            "CASE WHEN glucose IS NULL OR glucose < 0 THEN 'glucose' END, "
            "CASE WHEN systolic_bp IS NULL OR systolic_bp < 0 THEN 'systolic_bp' END, "
            "CASE WHEN diastolic_bp IS NULL OR diastolic_bp < 0 THEN 'diastolic_bp' END, "
            "CASE WHEN bmi IS NULL OR bmi < 0 THEN 'bmi' END, "
            "CASE WHEN NOT coalesce(glucose_type IN ('fasting', 'random'), false) THEN 'glucose_type' END, "
            "CASE WHEN gender IS NULL THEN 'gender' END, "
            "CASE WHEN symptoms IS NULL THEN 'symptoms' END]::VARCHAR[], lambda v: v IS NOT NULL)")
    q["request_validation"] = with_views(
        f"SELECT request_id, array_to_string({viol}, ', ') AS violations, len({viol}) = 0 AS valid "
        "FROM score_requests", "score_requests")
    pu = merge_patch_sql().split("a AS (SELECT email,")[0].rstrip().rstrip(",")
    j = lambda f: f"TRY_CAST(json_extract(payload_json, '$.{f}') AS DOUBLE)"
    t = lambda f: f"json_extract_string(payload_json, '$.{f}')"
    forms = {
        "health_details": ("submissions", "id", [
            ("email", "NOT length(email) BETWEEN 5 AND 254"),
            ("age", f"coalesce({j('age')} + CASE WHEN id % 10 = 0 THEN 60 ELSE 0 END NOT BETWEEN 0 AND 120, true)"),
            ("gender", f"coalesce(length({t('gender')}) NOT BETWEEN 1 AND 50, true)"),
            ("symptoms", f"id % 8 = 0 OR coalesce(length({t('symptoms')}) NOT BETWEEN 1 AND 1000, true)"),
            ("symptom_count", "id % 120 > 100"), ("glucose", f"{j('glucose')} < 0"),
            ("blood_pressure", f"length({t('blood_pressure')}) > 30"),
            ("height_cm", f"id % 9 = 0 OR coalesce({j('height_cm')} <= 0 OR {j('height_cm')} > 300, true)"),
            ("weight_kg", f"coalesce({j('weight_kg')} * CASE WHEN id % 7 = 0 THEN 10 ELSE 1 END NOT BETWEEN 0.001 AND 500, true)"),
            ("bmi", f"coalesce({j('bmi')} <= 0 OR {j('bmi')} > 100, true)"),
            ("smoking_habit", f"coalesce(length({t('smoking_habit')}) NOT BETWEEN 1 AND 50, true)"),
            ("alcohol_habit", "id % 5 = 0"), ("average_sleep_hours", "id % 30 > 24"),
            ("medical_history", "id % 2100 > 2000")]),
        "record_update": ("p", "id", [
            ("patient_email", "length(email) NOT BETWEEN 5 AND 254"), ("updated_by_email", "id % 6 = 0"),
            ("age", "age NOT BETWEEN 0 AND 120"), ("gender", "length(gender) > 50"),
            ("height_cm", "height_cm <= 0 OR height_cm > 300"), ("weight_kg", "weight_kg - 60 <= 0 OR weight_kg - 60 > 500"),
            ("bmi", "bmi <= 0 OR bmi > 100"), ("glucose", "glucose < 0"), ("updated_by_role", "id % 4 = 0")]),
        "booking": ("(SELECT a.*, u.phone FROM appointments a LEFT JOIN users u ON u.email = a.patient_email)", "id", [
            ("patient_email", "length(patient_email) NOT BETWEEN 5 AND 254"),
            ("appointment_type", "length(appointment_type) NOT BETWEEN 2 AND 100"),
            ("contact_info", "phone IS NULL"), ("reason", "reason <> '' AND length(reason) NOT BETWEEN 2 AND 200"),
            ("notes", "length(notes) > 1000")]),
        "cancel": ("appointments", "id", [("appointment_id", "id % 9 = 0"), ("cancel_reason", "length(notes) > 200")]),
        "leave": ("doctor_leaves", "id", [("end_at", "id % 3 = 0"), ("reason", "id % 300 > 200")]),
    }
    parts = []
    for form, (src, key, checks) in forms.items():
        v = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in checks) + (
            "]::VARCHAR[], lambda v: v IS NOT NULL)")
        parts.append(f"SELECT '{form}' AS form, {key} AS request_id, array_to_string({v}, ', ') AS violations, "
                     f"len({v}) = 0 AS valid FROM {src}")
    q["form_validation"] = with_views(pu + "\n" + "\nUNION ALL ".join(parts), "submissions", "users", "appointments",
                                      "doctor_leaves")
    q["integrity_audit"] = with_views("""
WITH ue AS (SELECT DISTINCT lower(trim(email)) AS e FROM users),
dp AS (SELECT trim(phone) AS k, count(*) AS c FROM users WHERE phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT 'orphan_appointments' AS check_name, count(*) AS n FROM appointments
  WHERE lower(trim(patient_email)) NOT IN (SELECT e FROM ue)
UNION ALL SELECT 'orphan_submissions', count(*) FROM submissions WHERE lower(trim(email)) NOT IN (SELECT e FROM ue)
UNION ALL SELECT 'duplicate_emails', count(*) FROM (SELECT lower(trim(email)) FROM users GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_phones', count(*) FROM dp
UNION ALL SELECT 'rows_in_duplicate_phones', CAST(coalesce(sum(c), 0) AS BIGINT) FROM dp
UNION ALL SELECT 'bad_roles', count(*) FROM users WHERE NOT coalesce(role IN ('patient', 'nurse', 'doctor'), false)
UNION ALL SELECT 'leave_end_before_start', count(*) FROM doctor_leaves WHERE end_at < start_at""",
        "users", "appointments", "submissions", "doctor_leaves")
    q["cascade_delete"] = with_views(f"""
WITH {L}, del AS (SELECT DISTINCT lower(trim(email)) AS e FROM users WHERE role = 'patient' AND id % 50 = 0)
SELECT 'health_details' AS table_name, (SELECT count(*) FROM latest) AS before_rows,
       (SELECT count(*) FROM latest WHERE lower(trim(email)) NOT IN (SELECT e FROM del)) AS after_rows
UNION ALL SELECT 'appointments', (SELECT count(*) FROM appointments),
       (SELECT count(*) FROM appointments WHERE lower(trim(patient_email)) NOT IN (SELECT e FROM del))
UNION ALL SELECT 'health_details_submissions', (SELECT count(*) FROM submissions),
       (SELECT count(*) FROM submissions WHERE lower(trim(email)) NOT IN (SELECT e FROM del))
UNION ALL SELECT 'users', (SELECT count(*) FROM users),
       (SELECT count(*) FROM users WHERE NOT (role = 'patient' AND id % 50 = 0))""",
        "users", "appointments", "submissions")
    q["renumber_ids"] = with_views(f"""
WITH r AS (SELECT email, {safe_role('role')} AS role, id AS old_id,
                  row_number() OVER (PARTITION BY {safe_role('role')}
                                     ORDER BY coalesce(id, 1000000000), lower(trim(email))) AS new_id FROM users)
SELECT email, role, old_id, new_id, old_id IS DISTINCT FROM new_id AS changed FROM r""", "users")
    q["next_ids"] = with_views(f"""
SELECT {safe_role('role')} AS scope, coalesce(max(id), 0) + 1 AS next_id FROM users GROUP BY 1
UNION ALL SELECT 'all', coalesce(max(id), 0) + 1 FROM users
UNION ALL SELECT 'leave', coalesce(max(id), 0) + 1 FROM doctor_leaves""", "users", "doctor_leaves")
    q["seed_union"] = with_views("""
WITH u AS (SELECT id, full_name, lower(trim(email)) AS email, role, 'existing' AS source FROM users),
s AS (SELECT * FROM (VALUES (1::BIGINT, 'Patient Demo', 'patient@example.com', 'patient'),
                            (2::BIGINT, 'Nurse Demo', 'nurse@example.com', 'nurse'),
                            (3::BIGINT, 'Doctor Demo', 'doctor@example.com', 'doctor')) t(id, full_name, email, role))
SELECT * FROM u UNION ALL
SELECT id, full_name, email, role, 'seed' FROM s WHERE email NOT IN (SELECT email FROM u)""", "users")
    q["bootstrap_import"] = with_views(f"""
WITH base AS (SELECT id AS rw, full_name, email, phone, role,
                     CASE WHEN id % 13 = 0 THEN '' ELSE 'h' || CAST(id AS VARCHAR) END AS password_hash FROM users),
f AS (
  SELECT 0 AS fi, * FROM base WHERE role = 'patient' AND rw % 7 <> 0
  UNION ALL SELECT 1, * FROM base WHERE role = 'nurse'
  UNION ALL SELECT 2, * FROM base WHERE role = 'doctor'
  UNION ALL SELECT 3, rw, upper(full_name), email, phone, upper(role), password_hash FROM base),
g AS (SELECT lower(trim(coalesce(email, ''))) AS e, min_by(fi, (fi, rw)) AS fi, min_by(rw, (fi, rw)) AS rw,
             min_by(full_name, (fi, rw)) AS full_name, min_by(phone, (fi, rw)) AS phone,
             min_by(role, (fi, rw)) AS role, min_by(password_hash, (fi, rw)) AS ph
      FROM f WHERE lower(trim(coalesce(email, ''))) <> '' GROUP BY 1)
SELECT e AS email, trim(coalesce(nullif(trim(full_name), ''), e)) AS full_name, trim(coalesce(phone, '')) AS phone,
       {safe_role('role')} AS role, fi AS source_file, rw AS source_row
FROM g WHERE trim(coalesce(ph, '')) <> ''""", "users")
    q["table_inventory"] = with_views(f"""
WITH {L}, {ev}
SELECT 'users' AS table_name, count(*) AS row_count FROM users
UNION ALL SELECT 'health_details', count(*) FROM latest
UNION ALL SELECT 'appointments', count(*) FROM appointments
UNION ALL SELECT 'doctor_leaves', count(*) FROM doctor_leaves
UNION ALL SELECT 'health_details_submissions', count(*) FROM submissions
UNION ALL SELECT 'patient_record_history', count(*) FROM ev
UNION ALL SELECT 'doctors_ref', count(*) FROM doctors_ref""",
        "users", "submissions", "appointments", "doctor_leaves", "doctors_ref")
    q["truthy_count"] = with_views(
        "SELECT 'emergency_doctor' AS column_name, count(*) FILTER (WHERE lower(trim(emergency_doctor)) IN "
        "('yes', 'true', '1', 'y')) AS n FROM doctors_ref", "doctors_ref")
    q["rate_limit_breaches"] = with_views(
        "WITH h AS (SELECT event_id, scope, ip, ts, count(*) OVER (PARTITION BY scope, ip ORDER BY ts "
        "RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS hits FROM access_log) "
        "SELECT event_id, scope, ip, ts, hits, hits > 2 AS breach FROM h", "access_log")
    return q


def merge_patch_sql() -> str:
    s, d = OS.bp_parse("json_extract_string(payload_json, '$.blood_pressure')")
    sym = "trim(json_extract_string(payload_json, '$.symptoms'))"
    cnt = (f"len(list_filter(list_transform(string_split_regex({sym}, '[,;|\\n]+'), lambda x: trim(x)), "
           "lambda x: x <> ''))")
    fields = {
        "age": "CASE WHEN id % 2 = 0 THEN TRY_CAST(json_extract(payload_json, '$.age') AS INTEGER) END",
        "gender": "CASE WHEN id % 4 <> 0 THEN nullif(trim(json_extract_string(payload_json, '$.gender')), '') END",
        "symptoms": f"CASE WHEN id % 5 <> 0 THEN {sym} END",
        "symptom_count": f"CASE WHEN id % 5 <> 0 AND {sym} IS NOT NULL THEN CAST({cnt} AS INTEGER) END",
        "bmi": "CASE WHEN id % 2 = 1 THEN TRY_CAST(json_extract(payload_json, '$.bmi') AS DOUBLE) END",
        "height_cm": "CASE WHEN id % 4 = 1 THEN TRY_CAST(json_extract(payload_json, '$.height_cm') AS DOUBLE) + 1 END",
        "weight_kg": "CASE WHEN id % 3 = 1 THEN TRY_CAST(json_extract(payload_json, '$.weight_kg') AS DOUBLE) END",
        "glucose": "TRY_CAST(json_extract(payload_json, '$.glucose') AS DOUBLE)",
        "glucose_type": "CASE WHEN id % 6 = 3 THEN 'random' END",
        "blood_pressure": (f"CASE WHEN ({s}) IS NOT NULL AND ({d}) IS NOT NULL THEN "
                           f"CAST(CAST(round_even({s}, 0) AS BIGINT) AS VARCHAR) || '/' || "
                           f"CAST(CAST(round_even({d}, 0) AS BIGINT) AS VARCHAR) END"),
    }
    pcols = ", ".join(f"{v} AS {k}" for k, v in fields.items())
    aggs = ", ".join(f"max_by({k}, (submitted_at, id)) FILTER (WHERE {k} IS NOT NULL) AS p_{k}" for k in fields)
    text = ("gender", "symptoms", "smoking_habit", "alcohol_habit", "medical_history",
            "family_history_major_chronic_disease", "glucose_type", "blood_pressure")
    whole = ("age", "symptom_count")
    cur = {}
    for f in TRACKED_FIELDS:
        if f in text:
            cur[f] = f"json_extract_string(l.payload_json, '$.{f}')"
        else:
            cur[f] = f"TRY_CAST(json_extract(l.payload_json, '$.{f}') AS {'INTEGER' if f in whole else 'DOUBLE'})"
    merged = ", ".join((f"coalesce(a.p_{k}, {v})" if k in fields else v) + f" AS {k}" for k, v in cur.items())
    olds = ", ".join(f"{v} AS o_{k}" for k, v in cur.items())
    audit = lambda k, c: f"nullif(trim({c}), '')" if k in text else f"CAST({c} AS DOUBLE)"
    changed = ("list_filter([" + ", ".join(
        f"CASE WHEN {audit(k, k)} IS DISTINCT FROM {audit(k, 'o_' + k)} THEN '{k}' END" for k in cur)
        + "]::VARCHAR[], lambda v: v IS NOT NULL)")
    first = {k: "NULL" for k in fields} | {"age": "40", "height_cm": "170.0"}
    fcols = ", ".join(f"{v} AS {k}" for k, v in first.items())
    return f"""
WITH {OS.LATEST_CTE},
p AS (SELECT lower(trim(email)) AS email, submitted_at, id, {pcols} FROM submissions
      UNION ALL SELECT email, {AS_OF}, id, {fcols} FROM users WHERE role = 'patient' AND id % 7 = 0),
a AS (SELECT email, {aggs}, min(submitted_at) AS first_at, max(submitted_at) AS updated_at FROM p
      WHERE email IN (SELECT lower(trim(email)) FROM users) GROUP BY email),
m AS (SELECT a.email, {merged}, {olds}, a.first_at, a.updated_at FROM a LEFT JOIN latest l ON a.email = l.email)
SELECT email, {", ".join(cur)}, strftime(first_at, '%Y-%m-%dT%H:%M:%S') AS submitted_at, updated_at,
       array_to_string({changed}, ', ') AS changed_fields FROM m"""
