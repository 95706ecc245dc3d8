"""Oracle SQL (DuckDB) for every registered query that SQL can express.

Each query is self-contained: fixture views are prefixed as CTEs (see
``fixture_sql.with_views``) over the driver tables that the checker
pre-registers.  Integer aggregates are cast to BIGINT, doubles rounded to 4
places, arrays emitted as text, so that both engines produce equal values.
"""

from __future__ import annotations

from . import sqlparts as S
from .fixture_sql import with_views


def clean_ctes(src: str) -> str:
    """CTEs c1 (typed), cstats, cmode, cids, clean from a raw patient view."""
    def num(c, lo=None, hi=None):
        x = f"TRY_CAST({c} AS DOUBLE)"
        x = f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"
        if lo is not None:
            x = f"(CASE WHEN {x} BETWEEN {lo} AND {hi} THEN {x} END)"
        return x

    return f"""
c1 AS (
  SELECT seq, {num('Patient_ID')} AS pid, {num('Age', 0, 120)} AS age, {num('Glucose', 40, 400)} AS glucose,
         {num('BloodPressure', 30, 250)} AS bp, {num('BMI', 10, 80)} AS bmi,
         Gender AS gender_raw, Symptoms AS symptoms_raw, {S.norm('Disease')} AS disease
  FROM {src}),
cstats AS (
  SELECT median(age) AS m_age, median(glucose) AS m_glu, median(bp) AS m_bp, median(bmi) AS m_bmi,
         floor(max(pid)) AS max_id FROM c1),
cmode AS (
  SELECT disease AS mode_disease FROM c1 WHERE disease IS NOT NULL
  GROUP BY disease ORDER BY count(*) DESC, disease LIMIT 1),
cids AS (
  SELECT c1.*, CASE WHEN pid IS NULL THEN row_number() OVER (PARTITION BY pid IS NULL ORDER BY seq) END AS new_rank
  FROM c1),
clean_pre AS (
  SELECT CAST(round_even(coalesce(pid, coalesce(max_id, 0) + new_rank), 0) AS BIGINT) AS Patient_ID,
         CAST(round_even(coalesce(age, m_age), 0) AS INTEGER) AS Age,
         {S.gender('gender_raw')} AS Gender,
         {S.std_symptoms('symptoms_raw')} AS Symptoms,
         coalesce(disease, (SELECT mode_disease FROM cmode), 'Unknown') AS Disease,
         coalesce(glucose, m_glu) AS Glucose, coalesce(bp, m_bp) AS BloodPressure, coalesce(bmi, m_bmi) AS BMI,
         seq
  FROM cids CROSS JOIN cstats),
clean AS (
  SELECT Patient_ID, Age, Gender,
         CAST(CASE Gender WHEN 'Female' THEN 0 WHEN 'Male' THEN 1 ELSE 2 END AS INTEGER) AS Gender_Encoded,
         Symptoms, CAST({S.count_std('Symptoms')} AS INTEGER) AS Symptom_Count, Disease, Glucose, BloodPressure,
         BMI, min(seq) AS seq
  FROM clean_pre GROUP BY Patient_ID, Age, Gender, Symptoms, Disease, Glucose, BloodPressure, BMI)"""


def feature_ctes() -> str:
    """CTEs feat (row-local F1-F19) from ``clean``."""
    return f"""
f1 AS (
  SELECT *, {S.split_std('Symptoms')} AS lst FROM clean),
f2 AS (
  SELECT * REPLACE (CAST(len(lst) AS INTEGER) AS Symptom_Count),
         CAST(len(list_distinct(lst)) AS INTEGER) AS Unique_Symptom_Count,
         {S.age_group('Age')} AS Age_Group, {S.bmi_cat('BMI')} AS BMI_Category,
         {S.glu_cat('Glucose')} AS Glucose_Category, {S.bp_cat('BloodPressure')} AS BP_Category
  FROM f1),
f3 AS (
  SELECT *, {S.load_group('Symptom_Count')} AS Symptom_Load_Group,
         CAST(Unique_Symptom_Count >= 4 AS INTEGER) AS Multi_System_Symptoms,
         CAST({S.score2('BMI_Category')} AS INTEGER) AS BMI_Severity_Score,
         CAST({S.score2('Glucose_Category')} AS INTEGER) AS Glucose_Severity_Score,
         CAST({S.score2('BP_Category')} AS INTEGER) AS BP_Severity_Score
  FROM f2),
f4 AS (
  SELECT *, CAST({S.sym_score('Symptom_Load_Group')} AS INTEGER) AS Symptom_Severity_Score,
         CAST(BMI_Severity_Score + Glucose_Severity_Score + BP_Severity_Score AS INTEGER) AS Vital_Severity_Score,
         CAST(Age >= 60 AS INTEGER) AS Senior_Risk, CAST(Age <= 12 AS INTEGER) AS Pediatric_Risk,
         CAST(Symptom_Count >= 4 AS INTEGER) AS High_Symptom_Load,
         CAST(Glucose >= 126 AS INTEGER) AS High_Glucose_Risk, CAST(BloodPressure >= 90 AS INTEGER) AS High_BP_Risk,
         CAST(BMI >= 30 AS INTEGER) AS Obesity_Risk
  FROM f3),
f5 AS (
  SELECT *, CAST(Vital_Severity_Score + Symptom_Severity_Score AS INTEGER) AS Overall_Severity_Score,
         CAST(Vital_Severity_Score >= 4 AS INTEGER) AS Critical_Vitals_Flag,
         CAST(High_Glucose_Risk + High_BP_Risk + Obesity_Risk AS INTEGER) AS Metabolic_Risk_Count
  FROM f4),
feat AS (
  SELECT *, CAST(Senior_Risk + Pediatric_Risk + High_Symptom_Load + High_Glucose_Risk + High_BP_Risk
                 + Obesity_Risk + Critical_Vitals_Flag AS INTEGER) AS Risk_Score
  FROM f5),
featg AS (SELECT *, {S.risk_group('Risk_Score')} AS Risk_Factor_Group FROM feat)"""


def _clean_feat(body: str, src: str = "patients_raw") -> str:
    return with_views(f"WITH {clean_ctes(src)},{feature_ctes()}\n{body}", src)


def _clean_only(body: str, src: str) -> str:
    return with_views(f"WITH {clean_ctes(src)}\n{body}", src)


TOP_SYM_CTE = """
sym_counts AS (SELECT s AS symptom, count(*) AS n FROM (SELECT unnest(lst) AS s FROM featg) GROUP BY s),
top_sym AS (SELECT symptom, CAST(n AS BIGINT) AS n,
                   CAST(row_number() OVER (ORDER BY n DESC, symptom) AS INTEGER) AS rank
            FROM sym_counts ORDER BY n DESC, symptom LIMIT 15)"""

TOP_PAIR_CTE = """
pairs AS (SELECT p[1] AS first_symptom, p[2] AS second_symptom FROM (
  SELECT unnest(list_transform(
      range(1, len(list_sort(list_distinct(lst))) + 1),
      lambda i: list_transform(list_sort(list_distinct(lst))[i + 1:],
                               lambda y: [list_sort(list_distinct(lst))[i], y]))) AS plist FROM featg
  ) t, LATERAL (SELECT unnest(plist) AS p)),
pair_counts AS (SELECT first_symptom, second_symptom, count(*) AS n FROM pairs GROUP BY ALL),
top_pair AS (SELECT first_symptom, second_symptom, CAST(n AS BIGINT) AS n,
                    CAST(row_number() OVER (ORDER BY n DESC, first_symptom, second_symptom) AS INTEGER) AS rank
             FROM pair_counts ORDER BY n DESC, first_symptom, second_symptom LIMIT 10)"""

PROFILE_CTE = """
prof AS (
  SELECT seq, Patient_ID,
    CAST(count(*) OVER (PARTITION BY Symptoms) AS INTEGER) AS Symptom_Profile_Frequency,
    CAST(count(*) OVER (PARTITION BY Age_Group, Symptoms) AS INTEGER) AS Age_Group_Profile_Frequency,
    CAST(count(*) OVER (PARTITION BY Gender, Symptoms) AS INTEGER) AS Gender_Profile_Frequency
  FROM featg),
prof2 AS (
  SELECT *, CAST(Symptom_Profile_Frequency >= 3 AS INTEGER) AS Repeated_Symptom_Pattern,
         CAST(Age_Group_Profile_Frequency >= 2 OR Gender_Profile_Frequency >= 2 AS INTEGER)
           AS Recurring_Demographic_Pattern
  FROM prof)"""


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_patients"] = _clean_only(
        "SELECT Patient_ID, Age, Gender, Gender_Encoded, Symptoms, Symptom_Count, Disease, Glucose, "
        "BloodPressure, BMI, seq FROM clean", "patients_raw_dup")
    q["clean_report"] = _clean_only(
        "SELECT CAST((SELECT count(*) FROM patients_raw_dup) AS BIGINT) AS input_rows, "
        "CAST((SELECT count(*) FROM clean) AS BIGINT) AS output_rows, "
        "CAST((SELECT count(*) FROM patients_raw_dup) - (SELECT count(*) FROM clean) AS BIGINT) "
        "AS duplicates_removed", "patients_raw_dup")
    cols = ["seq", "Patient_ID", "Age", "Gender", "Symptoms", "Disease", "Glucose", "BloodPressure", "BMI"]
    q["null_profile"] = with_views(
        "SELECT column_name, CAST(null_count AS BIGINT) AS null_count FROM (SELECT "
        + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in cols)
        + " FROM patients_raw_dup) UNPIVOT (null_count FOR column_name IN ("
        + ", ".join(cols) + "))", "patients_raw_dup")
    q["feature_severity"] = _clean_feat(
        "SELECT seq, Patient_ID, Symptom_Count, Unique_Symptom_Count, Symptom_Load_Group, Multi_System_Symptoms, "
        "Age_Group, BMI_Category, Glucose_Category, BP_Category, BMI_Severity_Score, Glucose_Severity_Score, "
        "BP_Severity_Score, Symptom_Severity_Score, Vital_Severity_Score, Overall_Severity_Score, "
        "Critical_Vitals_Flag FROM featg")
    q["feature_risk_score"] = _clean_feat(
        "SELECT seq, Patient_ID, Senior_Risk, Pediatric_Risk, High_Symptom_Load, High_Glucose_Risk, High_BP_Risk, "
        "Obesity_Risk, Metabolic_Risk_Count, Risk_Score, Risk_Factor_Group FROM featg")
    q["risk_group_distribution"] = _clean_feat(
        "SELECT Risk_Factor_Group, Age_Group, CAST(count(*) AS BIGINT) AS n, "
        "round(avg(Risk_Score), 4) AS avg_risk_score FROM featg GROUP BY ALL")
    q["top_symptoms"] = with_views(
        f"WITH {clean_ctes('patients_raw')},{feature_ctes()},{TOP_SYM_CTE}\nSELECT symptom, n, rank FROM top_sym",
        "patients_raw")
    q["top_symptom_pairs"] = with_views(
        f"WITH {clean_ctes('patients_raw')},{feature_ctes()},{TOP_PAIR_CTE}\n"
        "SELECT first_symptom, second_symptom, n, rank FROM top_pair", "patients_raw")
    q["symptom_flags"] = with_views(
        f"WITH {clean_ctes('patients_raw')},{feature_ctes()},{TOP_SYM_CTE}\n"
        f"SELECT seq, Patient_ID, 'SYM_' || {S.safe('symptom')} AS feature, "
        "CAST(list_contains(lst, symptom) AS INTEGER) AS flag FROM featg CROSS JOIN top_sym", "patients_raw")
    q["pair_flags"] = with_views(
        f"WITH {clean_ctes('patients_raw')},{feature_ctes()},{TOP_PAIR_CTE}\n"
        f"SELECT seq, Patient_ID, 'PAIR_' || {S.safe('first_symptom')} || '_' || {S.safe('second_symptom')} "
        "AS feature, CAST(list_contains(lst, first_symptom) AND list_contains(lst, second_symptom) AS INTEGER) "
        "AS flag FROM featg CROSS JOIN top_pair", "patients_raw")
    q["profile_frequency"] = with_views(
        f"WITH {clean_ctes('patients_raw')},{feature_ctes()},{PROFILE_CTE}\n"
        "SELECT *, CAST(Repeated_Symptom_Pattern + Recurring_Demographic_Pattern AS INTEGER) "
        "AS Historical_Pattern_Score FROM prof2", "patients_raw")
    from .oracle_scoring import sql_queries as _scoring

    q.update(_scoring())
    from .oracle_records import sql_queries as _records

    q.update(_records())
    from .oracle_model import sql_queries as _model

    q.update(_model())
    from .oracle_extra import sql_queries as _extra

    q.update(_extra())
    # streaming twins must equal their batch twins
    q["stream_rate_limit"] = q["rate_limit_breaches"]
    q["stream_latest_details"] = q["latest_details"]
    q["stream_audit_events"] = q["record_changes"]
    return q
