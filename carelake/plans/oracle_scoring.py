"""Oracle SQL for the scoring rules, keyword triage and stored-document risk."""

from __future__ import annotations

from . import sqlparts as S
from .fixture_sql import with_views
from .oracle import clean_ctes, feature_ctes

# The keyword lists of the rules, written out for the SQL side.
HIGH_KEYWORDS = [
    "chest pain", "difficulty breathing", "unconsciousness", "unconscious", "severe bleeding", "seizure",
    "seizures", "slurred speech", "confusion", "bluish lips", "bluish face", "blue lips", "blue face",
    "severe head injury", "head injury", "uncontrolled vomiting", "sudden weakness", "one side weakness",
    "weakness one side", "stroke",
]
MEDIUM_KEYWORDS = [
    "moderate fever", "persistent cough", "shortness of breath", "dehydration", "abdominal pain", "dizziness",
    "extreme fatigue", "fatigue (extreme)", "swelling", "rash with fever", "frequent vomiting",
    "painful urination",
]
LOW_KEYWORDS = [
    "mild fever", "runny nose", "sore throat", "mild cough", "headache", "body aches", "mild fatigue", "sneezing",
    "slight nausea", "minor cuts", "bruises", "minor cuts/bruises",
]
STOP_LIST = "['in', 'on', 'of', 'the', 'a', 'an', 'and', 'with', 'to', 'for', 'at']"


def tokens_quick(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[,;|\\n]+'), "
            f"lambda p: lower(trim(p))), lambda p: p <> '')")


def tokens_nurse(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[,;|\\n]+'), "
            f"lambda p: lower({S.ws('p')})), lambda p: p <> '')")


def has_any(tokens: str, kw: str) -> str:
    words = f"list_filter(regexp_extract_all('{kw}', '[a-z0-9]+'), lambda w: NOT list_contains({STOP_LIST}, w))"
    cond = f"(contains(t, '{kw}') OR list_has_all(regexp_extract_all(t, '[a-z0-9]+'), {words}))"
    return f"(len(list_filter({tokens}, lambda t: t <> '' AND {cond})) > 0)"


def _lst(items):
    return "[" + ", ".join(items) + "]::VARCHAR[]"


def quick_ctes(src: str, text_col: str, key_cols: str) -> str:
    """CTEs qk1 (flags) and qk (matched lists, level, score, triggers) over ``src``."""
    tk = tokens_quick(text_col)
    flags = []
    for i, kw in enumerate(HIGH_KEYWORDS):
        flags.append(f"{has_any('tk', kw)} AS h{i}")
    for i, kw in enumerate(MEDIUM_KEYWORDS):
        flags.append(f"{has_any('tk', kw)} AS m{i}")
    for i, kw in enumerate(LOW_KEYWORDS):
        flags.append(f"{has_any('tk', kw)} AS l{i}")
    extra = {
        "fever": "fever", "fever_h1": "high fever", "fever_h2": "very high", "fever_h3": "persistent fever",
        "fever_mod": "moderate fever", "fever_mild": "mild fever", "cough_p": "persistent cough",
        "cough_m": "mild cough", "vom_u": "uncontrolled vomiting", "vom_f": "frequent vomiting", "vom": "vomiting",
    }
    for name, kw in extra.items():
        flags.append(f"{has_any('tk', kw)} AS x_{name}")
    hi = _lst([f"CASE WHEN h{i} THEN '{k}' END" for i, k in enumerate(HIGH_KEYWORDS)])
    me = _lst([f"CASE WHEN m{i} THEN '{k}' END" for i, k in enumerate(MEDIUM_KEYWORDS)])
    lo = _lst([f"CASE WHEN l{i} THEN '{k}' END" for i, k in enumerate(LOW_KEYWORDS)])
    fh = "(x_fever_h1 OR x_fever_h2 OR x_fever_h3)"
    return f"""
qk0 AS (SELECT {key_cols}, {text_col} AS qtext, {tk} AS tk FROM {src}),
qk1 AS (SELECT {key_cols}, qtext, tk, {', '.join(flags)} FROM qk0),
qk2 AS (
  SELECT {key_cols}, qtext, tk,
    list_concat(list_filter({hi}, lambda v: v IS NOT NULL),
      CASE WHEN x_fever AND {fh} THEN ['high fever'] ELSE []::VARCHAR[] END,
      CASE WHEN x_vom_u THEN ['uncontrolled vomiting'] ELSE []::VARCHAR[] END) AS mh,
    list_concat(list_filter({me}, lambda v: v IS NOT NULL),
      CASE WHEN x_fever AND NOT {fh} AND x_fever_mod THEN ['moderate fever'] ELSE []::VARCHAR[] END,
      CASE WHEN x_fever AND NOT {fh} AND NOT x_fever_mod AND NOT x_fever_mild THEN ['fever'] ELSE []::VARCHAR[] END,
      CASE WHEN x_cough_p THEN ['persistent cough'] ELSE []::VARCHAR[] END,
      CASE WHEN NOT x_vom_u AND (x_vom_f OR x_vom) THEN ['frequent vomiting'] ELSE []::VARCHAR[] END) AS mm,
    list_concat(list_filter({lo}, lambda v: v IS NOT NULL),
      CASE WHEN x_fever AND NOT {fh} AND NOT x_fever_mod AND x_fever_mild THEN ['mild fever'] ELSE []::VARCHAR[] END,
      CASE WHEN NOT x_cough_p AND x_cough_m THEN ['mild cough'] ELSE []::VARCHAR[] END) AS ml
  FROM qk1),
qk AS (
  SELECT {key_cols}, qtext, mh, mm, ml,
    CASE WHEN len(mh) > 0 THEN 'High' WHEN len(mm) > 0 THEN 'Medium' ELSE 'Low' END AS q_level,
    CAST(3 * len(list_distinct(mh)) + len(list_distinct(mm)) AS INTEGER) AS q_score,
    list_concat(CASE WHEN len(mh) > 0 THEN ['Matched emergency warning sign symptom(s).']
                     WHEN len(mm) > 0 THEN ['Matched symptoms needing medical attention soon.']
                     WHEN len(ml) > 0 THEN ['Matched mild/self-care symptoms.'] ELSE []::VARCHAR[] END,
                {S.distinct_keep_order('list_concat(mh, mm, ml)')})[1:10] AS q_triggers
  FROM qk2)"""


def live_ctes(src: str, key: str, ref: bool) -> str:
    """CTE lv: live features + clinical assessment for inputs in ``src``.

    Needs age, gender, symptoms, glucose, glucose_type, systolic_bp, diastolic_bp, bmi.
    """
    s, d, g, b = "systolic_bp", "diastolic_bp", "glucose", "bmi"
    t = S.norm("glucose_type", True)
    join = ""
    freq = "0 AS ref_symptom_freq, 0 AS ref_age_freq, 0 AS ref_gender_freq"
    if ref:
        freq = ("coalesce(rs.n, 0) AS ref_symptom_freq, coalesce(ra.n, 0) AS ref_age_freq, "
                "coalesce(rg.n, 0) AS ref_gender_freq")
        join = ("LEFT JOIN ref_sym rs ON rs.sym = lv1.std_symptoms "
                "LEFT JOIN ref_age ra ON ra.ag = lv1.f_age_group AND ra.sym = lv1.std_symptoms "
                "LEFT JOIN ref_gender rg ON rg.gd = lv1.std_gender AND rg.sym = lv1.std_symptoms")
    return f"""
lv0 AS (
  SELECT *, {S.gender('gender')} AS std_gender, {S.std_symptoms('symptoms')} AS std_symptoms,
         {t} AS gtype FROM {src}),
lv1 AS (
  SELECT *, {S.split_std('std_symptoms')} AS lst, {S.age_group('age', live=True)} AS f_age_group,
    {S.bp_case(s, d, S.BP_CLIN)} AS bp_clin, {S.bp_case(s, d, S.BP_LEGACY)} AS bp_legacy,
    {S.bp_case(s, d, S.BP_POINTS)} AS bp_points, {S.bp_case(s, d, S.BP_URGENT)} AS bp_urgent,
    {S.bp_case(s, d, S.BP_ALERT)} AS bp_alert,
    {S.glu_case(g, 'gtype', S.GLU_CLIN)} AS glu_clin, {S.glu_case(g, 'gtype', S.GLU_LEGACY)} AS glu_legacy,
    {S.glu_case(g, 'gtype', S.GLU_POINTS)} AS glu_points, {S.glu_case(g, 'gtype', S.GLU_URGENT)} AS glu_urgent,
    {S.glu_case(g, 'gtype', S.GLU_ALERT)} AS glu_alert,
    {S.bmi_clin(b)} AS bmi_clin, {S.bmi_cat(b)} AS bmi_legacy, {S.bmi_points(b)} AS bmi_points,
    {S.bmi_alert(b)} AS bmi_alert
  FROM lv0),
lv2 AS (
  SELECT lv1.*, CAST(len(lst) AS INTEGER) AS f_symptom_count, CAST(len(list_distinct(lst)) AS INTEGER) AS f_unique,
    {freq}
  FROM lv1 {join}),
lv AS (
  SELECT *, {S.sym_points('f_symptom_count')} AS sym_points,
    CAST(bp_points + glu_points + bmi_points + {S.sym_points('f_symptom_count')} AS INTEGER) AS clinical_score,
    (bp_urgent OR glu_urgent) AS urgent,
    list_concat(bp_alert, glu_alert, bmi_alert) AS clinical_alerts,
    CAST({S.score2('bmi_legacy')} + {S.score2('glu_legacy')} + {S.score2('bp_legacy')} AS INTEGER) AS vital_sev,
    CAST({S.sym_score(S.load_group('f_symptom_count'))} AS INTEGER) AS sym_sev,
    CAST(ref_symptom_freq >= 3 AS INTEGER) AS rep_pattern,
    CAST(ref_age_freq >= 2 OR ref_gender_freq >= 2 AS INTEGER) AS rec_pattern
  FROM lv2),
lvc AS (
  SELECT *, CASE WHEN urgent THEN 'Critical' WHEN clinical_score >= 6 THEN 'High'
                 WHEN clinical_score >= 3 THEN 'Moderate' ELSE 'Low' END AS clinical_group,
    CASE WHEN urgent THEN 'Immediate emergency review recommended'
         WHEN clinical_score >= 6 THEN 'Urgent clinical review recommended'
         WHEN clinical_score >= 3 THEN 'Priority follow-up recommended'
         ELSE 'Standard scheduling is acceptable' END AS clinical_booking,
    CAST(rep_pattern + rec_pattern AS INTEGER) AS hist_score
  FROM lv)"""


REF_CTES = f"""
ref_base AS (SELECT {S.std_symptoms('Symptoms')} AS sym, Age_Group AS ag, Gender AS gd FROM featg),
ref_sym AS (SELECT sym, CAST(count(*) AS INTEGER) AS n FROM ref_base GROUP BY sym),
ref_age AS (SELECT ag, sym, CAST(count(*) AS INTEGER) AS n FROM ref_base GROUP BY ag, sym),
ref_gender AS (SELECT gd, sym, CAST(count(*) AS INTEGER) AS n FROM ref_base GROUP BY gd, sym)"""


def _ref_prefix() -> str:
    return f"{clean_ctes('patients_raw')},{feature_ctes()},{REF_CTES}"


RANK = "(CASE {x} WHEN 'Low' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'High' THEN 2 WHEN 'Critical' THEN 3 END)"


def rule_model_cte(src: str = "lvc") -> str:
    score = ("CAST(age >= 60 AS INTEGER) + CAST(age <= 12 AS INTEGER) + CAST(f_symptom_count >= 4 AS INTEGER) "
             "+ CAST(glucose >= 126 AS INTEGER) + CAST(diastolic_bp >= 90 AS INTEGER) + CAST(bmi >= 30 AS INTEGER) "
             "+ CAST(vital_sev >= 4 AS INTEGER)")
    return f"""
rm AS (SELECT *, {S.risk_group(score)} AS model_group FROM {src}),
fin AS (
  SELECT *, CASE WHEN {RANK.format(x='model_group')} >= {RANK.format(x='clinical_group')} THEN model_group
                 ELSE clinical_group END AS final_group FROM rm),
fin2 AS (
  SELECT *, CASE WHEN urgent THEN 'Immediate emergency review recommended'
                 WHEN final_group = 'High' THEN 'Urgent review recommended'
                 WHEN final_group = 'Moderate' THEN 'Priority follow-up recommended'
                 ELSE 'Standard scheduling is acceptable' END AS final_booking FROM fin)"""


DETAILS_COLS = """
  TRY_CAST(json_extract(payload_json, '$.age') AS INTEGER) AS d_age,
  json_extract_string(payload_json, '$.gender') AS d_gender,
  json_extract_string(payload_json, '$.symptoms') AS d_symptoms,
  TRY_CAST(json_extract(payload_json, '$.glucose') AS DOUBLE) AS d_glucose,
  json_extract_string(payload_json, '$.glucose_type') AS d_glucose_type,
  json_extract_string(payload_json, '$.blood_pressure') AS d_bp,
  TRY_CAST(json_extract(payload_json, '$.bmi') AS DOUBLE) AS d_bmi"""

LATEST_CTE = """
latest AS (
  SELECT lower(trim(email)) AS email, max_by(id, (submitted_at, id)) AS id, max(submitted_at) AS submitted_at,
         max_by(payload_json, (submitted_at, id)) AS payload_json
  FROM submissions WHERE trim(email) <> '' GROUP BY lower(trim(email)))"""


def bp_parse(text: str):
    nums = f"regexp_extract_all(coalesce({text}, ''), '\\d+(?:\\.\\d+)?')"
    s = f"TRY_CAST({nums}[1] AS DOUBLE)"
    d = f"TRY_CAST({nums}[2] AS DOUBLE)"
    ok = f"(len({nums}) >= 2 AND {s} > 0 AND {d} > 0)"
    return f"(CASE WHEN {ok} THEN {s} END)", f"(CASE WHEN {ok} THEN {d} END)"


def details_inputs_cte(nurse: bool) -> str:
    s, d = bp_parse("d_bp")
    if nurse:
        age, gt = "coalesce(d_age, 0)", "coalesce(nullif(d_glucose_type, ''), 'fasting')"
    else:
        age, gt = "d_age", "'fasting'"
    return f"""
det AS (SELECT email, id, submitted_at, payload_json, {DETAILS_COLS} FROM latest),
din AS (
  SELECT email, id AS sub_id, submitted_at AS sub_at, d_symptoms, {age} AS age, coalesce(nullif(d_gender, ''), 'Other') AS gender,
         coalesce(d_symptoms, '') AS symptoms, d_glucose AS glucose, {gt} AS glucose_type,
         {s} AS systolic_bp, {d} AS diastolic_bp, d_bmi AS bmi
  FROM det)"""


def _j(x, sep=" | "):
    return f"array_to_string({x}, '{sep}')"


def nurse_sql(src: str, key: str) -> str:
    """CTEs producing ``nt`` (nurse triage) over inputs in ``src``."""
    tk = tokens_nurse("symptoms")

    def has(p):
        return has_any("ntk", p)

    s, dd, g, b = "systolic_bp", "diastolic_bp", "glucose", "bmi"
    errors = _lst([
        "CASE WHEN age <= 0 OR age > 120 THEN 'Invalid age (must be 1-120).' END",
        f"CASE WHEN {s} IS NULL OR {dd} IS NULL THEN 'Blood pressure is missing.' END",
        f"CASE WHEN {s} IS NOT NULL AND {dd} IS NOT NULL AND ({s} < 50 OR {s} > 250) "
        "THEN 'Invalid systolic BP (must be 50-250).' END",
        f"CASE WHEN {s} IS NOT NULL AND {dd} IS NOT NULL AND ({dd} < 30 OR {dd} > 150) "
        "THEN 'Invalid diastolic BP (must be 30-150).' END",
        f"CASE WHEN {g} IS NULL THEN 'Glucose is missing.' END",
        f"CASE WHEN {g} <= 0 THEN 'Invalid glucose (must be > 0).' END",
        f"CASE WHEN {g} > 1200 THEN 'Invalid glucose (value too high).' END",
        f"CASE WHEN {b} IS NULL THEN 'BMI is missing.' END",
        f"CASE WHEN {b} <= 10 OR {b} > 60 THEN 'Invalid BMI (must be 10-60).' END",
    ])
    sym_alerts = _lst([
        f"CASE WHEN {has('unconscious')} OR {has('unconsciousness')} THEN 'Critical condition: unconscious.' END",
        f"CASE WHEN {has('chest pain')} AND {has('shortness of breath')} "
        "THEN 'Possible heart attack: chest pain + shortness of breath.' END",
        "CASE WHEN len(ntk) >= 5 THEN 'Severe symptom load (5+ symptoms).' END",
    ])
    vital_alerts = _lst([
        f"CASE WHEN {s} > 180 OR {dd} > 120 THEN 'Hypertensive crisis (BP > 180/120).' END",
        f"CASE WHEN {g} < 54 THEN 'Severe hypoglycemia (glucose < 54 mg/dL).' END",
        f"CASE WHEN {g} > 300 THEN 'Severe hyperglycemia (glucose > 300 mg/dL).' END",
    ])
    stage = "bp_clin IN ('Stage 1 Hypertension', 'Stage 2 Hypertension', 'Severe Hypertension')"
    return f"""
nt0 AS (
  SELECT *, {tk} AS ntk FROM {src}),
nt1 AS (
  SELECT *, list_filter({errors}, lambda v: v IS NOT NULL) AS verr,
    list_filter({sym_alerts}, lambda v: v IS NOT NULL) AS salerts,
    list_filter({vital_alerts}, lambda v: v IS NOT NULL) AS valerts,
    ({has('fever')} AND {has('cough')}) AS infection, {has('headache')} AS hh, {has('fatigue')} AS hf,
    {has('fever')} AS hfev
  FROM nt0),
nt1q AS (SELECT nt1.*, qk.q_level = 'High' AS kw_high FROM nt1 JOIN qk USING ({key})),
nt2 AS (
  SELECT *, len(verr) = 0 AS valid,
    CASE WHEN len(verr) = 0 THEN
      CASE WHEN len(list_concat(salerts, valerts)) > 0 THEN 'Critical'
           WHEN bp_clin IN ('Stage 2 Hypertension', 'Severe Hypertension') OR glu_clin = 'Diabetes Range'
                OR kw_high THEN 'High'
           ELSE clinical_group END
    ELSE CASE WHEN len(salerts) > 0 THEN 'Critical' WHEN kw_high THEN 'High' ELSE 'Needs vitals' END
    END AS level
  FROM nt1q JOIN lvc USING ({key})),
nt AS (
  SELECT {key}, valid, verr, level,
    CASE WHEN valid THEN list_concat(salerts, valerts) ELSE salerts END AS ealerts,
    CASE WHEN valid THEN list_sort(list_distinct(list_filter(
        [CASE WHEN infection THEN 'Infection suspected' END,
         CASE WHEN hh AND {stage} THEN 'Hypertension-related' END,
         CASE WHEN hf AND glu_clin = 'Diabetes Range' THEN 'Diabetes-related' END,
         CASE WHEN len(ntk) >= 4 THEN 'Multi-system issue' END]::VARCHAR[], lambda v: v IS NOT NULL)))
      ELSE list_filter([CASE WHEN infection THEN 'Infection suspected' END]::VARCHAR[], lambda v: v IS NOT NULL)
    END AS ntags,
    CASE WHEN valid THEN list_filter(
        [CASE WHEN {g} < 70 THEN 'If confirmed low glucose, provide fast-acting carbohydrate per protocol and recheck.' END,
         CASE WHEN hfev THEN 'Supportive care and temperature monitoring per protocol.' END,
         CASE WHEN {stage} THEN 'Recheck BP after rest using correct cuff size and positioning.' END]::VARCHAR[],
        lambda v: v IS NOT NULL)
      ELSE ['Confirm vitals using correct equipment and technique.',
            'If the patient looks unwell or symptoms are worrying, escalate per clinic protocol.'] END AS sugg,
    CASE WHEN valid THEN len(list_concat(salerts, valerts)) > 0 OR urgent ELSE level IN ('Critical', 'High') END
      AS show_on_top,
    CASE WHEN valid THEN CASE level WHEN 'Critical' THEN 'Immediate (0-10 mins)' WHEN 'High' THEN 'Within 1 hour'
                                    WHEN 'Moderate' THEN 'Same day' ELSE 'Normal booking' END
         ELSE CASE level WHEN 'Critical' THEN 'Immediate (0-10 mins)' WHEN 'High' THEN 'Within 1 hour (vitals ASAP)'
                         ELSE 'Vitals required' END END AS rec,
    CASE WHEN valid THEN CASE level WHEN 'Critical' THEN 'Immediate emergency review recommended'
                                    WHEN 'High' THEN 'Urgent consultation' WHEN 'Moderate' THEN 'Priority follow-up'
                                    ELSE 'Normal booking' END
         ELSE CASE level WHEN 'Critical' THEN 'Immediate attention' WHEN 'High' THEN 'Urgent consultation (symptoms)'
                         ELSE 'Vitals required' END END AS priority,
    CASE WHEN valid THEN CASE level WHEN 'Critical' THEN 'Escalate immediately and follow emergency protocol.'
           WHEN 'High' THEN 'Fast-track for urgent evaluation and document vitals + key symptoms.'
           WHEN 'Moderate' THEN 'Schedule same-day review; monitor symptoms and recheck vitals if needed.'
           ELSE 'Proceed with normal workflow; provide standard precautions and follow-up guidance.' END
         ELSE CASE level WHEN 'Critical' THEN 'Escalate immediately and follow emergency protocol.'
           WHEN 'High' THEN 'High-risk symptoms present. Capture vitals urgently and fast-track for review.'
           ELSE 'Complete vitals entry to enable full triage.' END END AS comment,
    CAST(len(ntk) AS INTEGER) AS n_symptoms,
    CASE WHEN valid THEN clinical_group END AS clin_group,
    CASE WHEN valid THEN list_filter(
        [CASE WHEN rep_pattern = 1 THEN 'Recurring symptom pattern seen in the reference dataset (pattern match).' END,
         CASE WHEN hist_score >= 2 THEN 'Reference patterns suggest a possible chronic trend (not a diagnosis).' END
        ]::VARCHAR[], lambda v: v IS NOT NULL) ELSE []::VARCHAR[] END AS notes
  FROM nt2)"""


NURSE_SELECT = (
    f"valid, {_j('verr')} AS validation_errors, level AS triage_level, priority, show_on_top, "
    f"{_j('ealerts')} AS emergency_alerts, {_j('ntags', ', ')} AS tags, rec AS appointment_recommendation, "
    f"{_j('sugg')} AS suggestions, comment AS nurse_comment, n_symptoms AS symptom_count, "
    f"clin_group AS clinical_risk_group, {_j('notes')} AS notes")


def patient_risk_ctes(key: str = "email") -> str:
    keys = "email, sub_id, sub_at" if key != "email" else "email"
    return f"""
pr AS (
  SELECT fin2.*, {qk_level_sql()} FROM fin2 LEFT JOIN qk USING ({key})),
pr2 AS (
  SELECT {keys}, d_symptoms,
    (age IS NOT NULL AND bmi IS NOT NULL AND glucose IS NOT NULL AND systolic_bp IS NOT NULL AND symptoms <> '')
      AS complete,
    CASE WHEN age IS NOT NULL AND symptoms <> '' THEN q_level END AS quick,
    CASE WHEN final_group IN ('Critical', 'High') THEN 'High' WHEN final_group = 'Moderate' THEN 'Medium'
         ELSE 'Low' END AS norm, final_booking
  FROM pr),
prisk AS (
  SELECT {keys}, d_symptoms,
    CASE WHEN complete THEN CASE WHEN quick = 'High' AND norm <> 'High' THEN 'High' ELSE norm END
         WHEN quick IS NOT NULL THEN quick END AS risk_level,
    CASE WHEN complete THEN 'model' WHEN quick IS NOT NULL THEN 'quick' END AS risk_source,
    CASE WHEN complete THEN CASE WHEN quick = 'High' AND norm <> 'High' THEN 'Urgent review recommended'
                                 ELSE final_booking END
         WHEN quick IS NOT NULL THEN CASE quick WHEN 'High' THEN 'Urgent review recommended'
                                                WHEN 'Medium' THEN 'Priority follow-up recommended'
                                                ELSE 'Standard scheduling is acceptable' END END
      AS risk_booking_priority
  FROM pr2)"""


def qk_level_sql() -> str:
    return "qk.q_level"


def patient_risk_prefix(per_submission: bool = False) -> str:
    """WITH body (no WITH keyword) computing ``prisk`` from submissions: the
    latest document per patient, or every submission (T4 stream twin)."""
    if per_submission:
        src = ("latest AS (SELECT lower(trim(email)) AS email, id, submitted_at, payload_json FROM submissions "
               "WHERE trim(email) <> '')")
        key = "sub_id"
    else:
        src, key = LATEST_CTE, "email"
    return (f"{_ref_prefix()},{src},{details_inputs_cte(False)},{live_ctes('din', key, True)},"
            f"{rule_model_cte()},{quick_ctes('din', 'symptoms', key)},{patient_risk_ctes(key)}")


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    rq = "score_requests"
    lv = live_ctes(rq, "request_id", False)
    q["bp_assessment"] = with_views(
        f"WITH {lv} SELECT request_id, systolic_bp, diastolic_bp, bp_clin AS clinical_category, "
        f"bp_legacy AS legacy_category, CAST(bp_points AS INTEGER) AS severity_points, bp_urgent AS urgent_flag, "
        f"{_j('bp_alert')} AS medical_alerts FROM lvc", rq)
    q["glucose_assessment"] = with_views(
        f"WITH {lv} SELECT request_id, glucose, CASE WHEN gtype IN ('fasting', 'random') THEN gtype END "
        f"AS glucose_type, glu_clin AS clinical_category, glu_legacy AS legacy_category, "
        f"CAST(glu_points AS INTEGER) AS severity_points, glu_urgent AS urgent_flag, "
        f"{_j('glu_alert')} AS medical_alerts FROM lvc", rq)
    band4 = ("CASE WHEN bmi IS NULL OR isnan(bmi) OR bmi <= 0 THEN '' WHEN bmi < 18.5 THEN 'Underweight' "
             "WHEN bmi < 25 THEN 'Normal' WHEN bmi < 30 THEN 'Overweight' ELSE 'Obesity' END")
    band6 = ("CASE WHEN bmi IS NULL OR isnan(bmi) OR bmi <= 0 THEN '-' WHEN bmi < 18.5 THEN 'Underweight' "
             "WHEN bmi < 25 THEN 'Normal weight' WHEN bmi < 30 THEN 'Overweight' WHEN bmi < 35 "
             "THEN 'Obesity (Class I)' WHEN bmi < 40 THEN 'Obesity (Class II)' ELSE 'Obesity (Class III)' END")
    q["bmi_assessment"] = with_views(
        f"WITH {lv} SELECT request_id, bmi, bmi_clin AS clinical_category, bmi_legacy AS legacy_category, "
        f"CAST(bmi_points AS INTEGER) AS severity_points, {_j('bmi_alert')} AS medical_alerts, "
        f"{band4} AS display_band, {band6} AS display_band6 FROM lvc", rq)
    q["clinical_risk"] = with_views(
        f"WITH {lv} SELECT request_id, f_symptom_count AS symptom_count, clinical_group AS clinical_risk_group, "
        f"clinical_score, CAST(sym_points AS INTEGER) AS symptom_points, clinical_booking AS booking_priority, "
        f"urgent AS urgent_flag, {_j('clinical_alerts')} AS alerts FROM lvc", rq)
    lvr = live_ctes(rq, "request_id", True)
    q["risk_scoring"] = with_views(
        f"WITH {_ref_prefix()},{lvr},{rule_model_cte()},{quick_ctes(rq, 'symptoms', 'request_id')}\n"
        "SELECT request_id, model_group AS model_risk_group, clinical_group AS clinical_risk_group, "
        "CASE WHEN q_level = 'High' AND final_group IN ('Low', 'Moderate') THEN 'High' ELSE final_group END "
        "AS risk_group, CASE WHEN q_level = 'High' AND final_group IN ('Low', 'Moderate') "
        "THEN 'Urgent review recommended' ELSE final_booking END AS booking_priority, "
        "vital_sev AS Vital_Severity_Score, CAST(vital_sev + sym_sev AS INTEGER) AS Overall_Severity_Score, "
        "ref_symptom_freq AS Symptom_Profile_Frequency, ref_age_freq AS Age_Group_Profile_Frequency, "
        "ref_gender_freq AS Gender_Profile_Frequency, hist_score AS Historical_Pattern_Score, "
        "CASE WHEN model_group = 'High' THEN 1.0 ELSE 0.0 END AS prob_high, "
        "CASE WHEN model_group = 'Low' THEN 1.0 ELSE 0.0 END AS prob_low, "
        "CASE WHEN model_group = 'Moderate' THEN 1.0 ELSE 0.0 END AS prob_moderate "
        "FROM fin2 JOIN qk USING (request_id)", rq, "patients_raw")
    ps, pd_ = bp_parse("bp_text")
    q["parse_bp"] = with_views(
        "WITH b AS (SELECT id, json_extract_string(payload_json, '$.blood_pressure') AS bp_text FROM submissions) "
        f"SELECT id, bp_text, {ps} AS systolic, {pd_} AS diastolic, "
        "CAST(regexp_extract(bp_text, '(\\d{2,3})\\s*/\\s*(\\d{2,3})', 1) AS INTEGER) AS display_systolic, "
        "CAST(regexp_extract(bp_text, '(\\d{2,3})\\s*/\\s*(\\d{2,3})', 2) AS INTEGER) AS display_diastolic FROM b",
        "submissions")
    parts = ("list_filter(list_transform(string_split_regex(coalesce(qtext, ''), '[,;|\\n]+'), lambda p: trim(p)), "
             "lambda p: p <> '')")
    q["quick_risk"] = with_views(
        f"WITH {quick_ctes(rq, 'symptoms', 'request_id')}\n"
        f"SELECT request_id, q_level AS risk_level, q_score AS score, CAST(len({parts}) AS INTEGER) AS symptom_count, "
        f"array_to_string({parts}, ', ') AS symptom_text, {_j('q_triggers')} AS triggers, "
        f"{_j('list_sort(list_distinct(mh))', ', ')} AS matched_high, "
        f"{_j('list_sort(list_distinct(mm))', ', ')} AS matched_medium, "
        f"{_j('list_sort(list_distinct(ml))', ', ')} AS matched_low FROM qk", rq)
    lvn = live_ctes("nin", "request_id", True)
    q["nurse_triage"] = with_views(
        f"WITH nin AS (SELECT * REPLACE (coalesce(glucose_type, 'fasting') AS glucose_type) FROM {rq}),"
        f"{_ref_prefix()},{lvn},{quick_ctes(rq, 'CAST(symptoms AS VARCHAR)', 'request_id')},"
        f"{nurse_sql('nin', 'request_id')}\nSELECT request_id, {NURSE_SELECT} FROM nt", rq, "patients_raw")
    q["latest_details"] = with_views(f"WITH {LATEST_CTE} SELECT email, id, submitted_at, payload_json FROM latest",
                                     "submissions")
    q["patient_risk"] = with_views(
        f"WITH {patient_risk_prefix()}\nSELECT email, risk_level, risk_source, risk_booking_priority FROM prisk",
        "submissions", "patients_raw")
    q["symptom_advice"] = with_views(
        f"WITH {patient_risk_prefix()},{advice_ctes()}\n"
        "SELECT email, has_symptoms, possible_causes, self_care, next_steps FROM adv", "submissions", "patients_raw")
    return q


def advice_ctes() -> str:
    from ..functions.keywords import ADVICE_RULES, FIXED_STEPS, NEXT_STEP_BY_RISK

    toks = ("list_filter(list_transform(string_split_regex(coalesce(d_symptoms, ''), '[,;\\n]'), "
            "lambda p: lower(trim(p))), lambda p: p <> '')")
    poss, tips = [], []
    for keys, causes, ideas in ADVICE_RULES:
        cond = " OR ".join(f"len(list_filter(atk, lambda t: contains(t, '{k}'))) > 0" for k in keys)
        poss.append(f"CASE WHEN {cond} THEN {_lst([repr_sql(c) for c in causes])} ELSE []::VARCHAR[] END")
        tips.append(f"CASE WHEN {cond} THEN {_lst([repr_sql(c) for c in ideas])} ELSE []::VARCHAR[] END")
    first = (f"CASE WHEN lower(coalesce(risk_level, '')) = 'high' THEN [{repr_sql(NEXT_STEP_BY_RISK['high'])}] "
             f"WHEN lower(coalesce(risk_level, '')) = 'medium' THEN [{repr_sql(NEXT_STEP_BY_RISK['medium'])}] "
             f"WHEN coalesce(risk_level, '') <> '' THEN [{repr_sql(NEXT_STEP_BY_RISK['other'])}] "
             "ELSE []::VARCHAR[] END")
    book = ("CASE WHEN coalesce(risk_booking_priority, '') <> '' THEN [risk_booking_priority] "
            "ELSE []::VARCHAR[] END")
    steps = f"list_concat({first}, {book}, {_lst([repr_sql(s) for s in FIXED_STEPS])})"

    def first6(x):
        return f"({S.distinct_keep_order(x)})[1:6]"

    return f"""
adv0 AS (SELECT *, {toks} AS atk FROM prisk),
adv1 AS (SELECT *, list_concat({', '.join(poss)}) AS poss, list_concat({', '.join(tips)}) AS tips,
                {steps} AS steps FROM adv0),
adv AS (
  SELECT email, len(atk) > 0 AS has_symptoms,
    CASE WHEN len(atk) > 0 THEN {_j(first6('poss'))} ELSE '' END AS possible_causes,
    CASE WHEN len(atk) > 0 THEN {_j(first6('tips'))} ELSE '' END AS self_care,
    CASE WHEN len(atk) > 0 THEN {_j(first6('steps'))} ELSE '' END AS next_steps
  FROM adv1)"""


def repr_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
