"""SQL fragments (DuckDB dialect) used to write the oracle queries.

These restate the reference rules independently of the DataFrame code, so a
slip on one side shows up as a mismatch.
"""

from __future__ import annotations

NULL_LIKE = "('', 'nan', 'none', 'null', 'na', 'n/a')"


def ws(x: str) -> str:
    return f"trim(regexp_replace(CAST({x} AS VARCHAR), '\\s+', ' ', 'g'))"


def norm(x: str, lower: bool = False) -> str:
    t = ws(x)
    return f"(CASE WHEN lower({t}) IN {NULL_LIKE} THEN NULL ELSE {'lower(' + t + ')' if lower else t} END)"


def gender(x: str) -> str:
    n = norm(x, True)
    return (f"(CASE {n} WHEN 'male' THEN 'Male' WHEN 'm' THEN 'Male' WHEN 'female' THEN 'Female' "
            f"WHEN 'f' THEN 'Female' WHEN 'other' THEN 'Other' WHEN 'non-binary' THEN 'Other' "
            f"WHEN 'non binary' THEN 'Other' WHEN 'unknown' THEN 'Other' WHEN 'prefer not to say' THEN 'Other' "
            f"ELSE 'Other' END)")


def parts(text: str, pattern: str = "[,;|]+") -> str:
    return (f"list_filter(list_transform(string_split_regex({text}, '{pattern}'), lambda p: trim(p)), "
            f"lambda p: p <> '')")


def distinct_keep_order(lst: str) -> str:
    return f"list_filter({lst}, lambda v, i: list_position({lst}, v) = i)"


def std_symptoms(x: str) -> str:
    d = distinct_keep_order(parts(norm(x, True)))
    return f"(CASE WHEN len(coalesce({d}, [])) > 0 THEN array_to_string({d}, ', ') ELSE 'unknown' END)"


def count_std(s: str) -> str:
    return f"(CASE WHEN {s} = 'unknown' THEN 0 ELSE len(string_split({s}, ', ')) END)"


def split_std(s: str) -> str:
    t = f"lower(trim({s}))"
    return f"(CASE WHEN {t} IS NULL OR {t} = '' OR {t} = 'unknown' THEN []::VARCHAR[] ELSE {parts(t)} END)"


def safe(x: str) -> str:
    r = f"regexp_replace(replace(lower({x}), ' ', '_'), '[^a-z0-9_]+', '_', 'g')"
    return f"trim({r}, '_')"


def age_group(a: str, live: bool = False) -> str:
    core = (f"WHEN {a} <= 18 THEN 'Child' WHEN {a} <= 35 THEN 'Young' WHEN {a} <= 50 THEN 'Adult' "
            f"WHEN {a} <= 65 THEN 'Middle_Age'")
    if live:
        return f"(CASE {core} ELSE 'Senior' END)"
    return f"(CASE WHEN {a} < 0 OR {a} > 120 THEN NULL {core} ELSE 'Senior' END)"


def bmi_cat(x):
    return f"(CASE WHEN {x} < 18.5 THEN 'Underweight' WHEN {x} < 25 THEN 'Normal' WHEN {x} < 30 THEN 'Overweight' ELSE 'Obese' END)"


def glu_cat(x):
    return f"(CASE WHEN {x} < 70 THEN 'Low' WHEN {x} < 100 THEN 'Normal' WHEN {x} < 126 THEN 'Prediabetes' ELSE 'High' END)"


def bp_cat(x):
    return f"(CASE WHEN {x} < 60 THEN 'Low' WHEN {x} < 80 THEN 'Normal' WHEN {x} < 90 THEN 'Prehypertension' ELSE 'High' END)"


def load_group(n):
    return f"(CASE WHEN {n} <= 1 THEN 'Minimal' WHEN {n} <= 3 THEN 'Moderate' WHEN {n} <= 5 THEN 'High' ELSE 'Severe' END)"


def risk_group(s):
    return f"(CASE WHEN {s} <= 2 THEN 'Low' WHEN {s} <= 4 THEN 'Moderate' WHEN {s} <= 6 THEN 'High' ELSE 'Very_High' END)"


def score2(cat, low_val=1):
    """Underweight/Low=1, Normal=0, Overweight/Prediabetes/Prehypertension=1, Obese/High=2."""
    return (f"(CASE {cat} WHEN 'Underweight' THEN 1 WHEN 'Low' THEN 1 WHEN 'Normal' THEN 0 WHEN 'Overweight' THEN 1 "
            f"WHEN 'Prediabetes' THEN 1 WHEN 'Prehypertension' THEN 1 WHEN 'Obese' THEN 2 WHEN 'High' THEN 2 END)")


def sym_score(g):
    return f"(CASE {g} WHEN 'Minimal' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'High' THEN 2 WHEN 'Severe' THEN 3 END)"


# ----------------------------------------------------------- clinical rules

def bp_case(s, d, vals):
    return (f"(CASE WHEN {s} < 90 OR {d} < 60 THEN {vals[0]} WHEN {s} > 180 OR {d} > 120 THEN {vals[1]} "
            f"WHEN {s} >= 140 OR {d} >= 90 THEN {vals[2]} WHEN {s} >= 130 OR {d} >= 80 THEN {vals[3]} "
            f"WHEN {s} >= 120 AND {d} < 80 THEN {vals[4]} ELSE {vals[5]} END)")


BP_CLIN = ["'Low Blood Pressure'", "'Severe Hypertension'", "'Stage 2 Hypertension'", "'Stage 1 Hypertension'",
           "'Elevated Blood Pressure'", "'Normal'"]
BP_LEGACY = ["'Low'", "'High'", "'High'", "'Prehypertension'", "'Prehypertension'", "'Normal'"]
BP_POINTS = ["2", "4", "3", "2", "1", "0"]
BP_URGENT = ["false", "true", "false", "false", "false", "false"]
BP_ALERT = ["['Blood pressure is below 90/60 mmHg.']", "['Blood pressure is above 180/120 mmHg.']",
            "['Blood pressure is in the Stage 2 hypertension range.']",
            "['Blood pressure is in the Stage 1 hypertension range.']",
            "['Blood pressure is elevated above normal.']", "[]::VARCHAR[]"]


def glu_case(g, t, vals):
    """t is the normalised (lower) type; invalid -> NULL."""
    return (f"(CASE WHEN {t} IS NULL OR {t} NOT IN ('fasting', 'random') THEN NULL "
            f"WHEN {g} < 54 THEN {vals[0]} WHEN {g} < 70 THEN {vals[1]} "
            f"WHEN {t} = 'fasting' AND {g} <= 99 THEN {vals[2]} WHEN {t} = 'fasting' AND {g} <= 125 THEN {vals[3]} "
            f"WHEN {t} = 'fasting' THEN {vals[4]} WHEN {g} < 140 THEN {vals[5]} WHEN {g} < 200 THEN {vals[6]} "
            f"ELSE {vals[7]} END)")


GLU_CLIN = ["'Severe Hypoglycemia'", "'Low Glucose'", "'Normal Fasting Glucose'", "'Prediabetes Range'",
            "'Diabetes Range'", "'Normal Random Glucose'", "'Elevated Random Glucose'", "'Diabetes Range'"]
GLU_LEGACY = ["'Low'", "'Low'", "'Normal'", "'Prediabetes'", "'High'", "'Normal'", "'Prediabetes'", "'High'"]
GLU_POINTS = ["4", "3", "0", "1", "3", "0", "1", "3"]
GLU_URGENT = ["true", "false", "false", "false", "false", "false", "false", "false"]
GLU_ALERT = ["['Glucose is below 54 mg/dL.']", "['Glucose is below 70 mg/dL.']", "[]::VARCHAR[]",
             "['Fasting glucose is in the prediabetes range.']", "['Fasting glucose is in the diabetes range.']",
             "[]::VARCHAR[]", "['Random glucose is elevated but not by itself diagnostic for diabetes.']",
             "['Random glucose is in the diabetes range.']"]


def bmi_clin(x):
    return (f"(CASE WHEN {x} < 18.5 THEN 'Underweight' WHEN {x} < 25 THEN 'Healthy Weight' "
            f"WHEN {x} < 30 THEN 'Overweight' WHEN {x} < 35 THEN 'Class 1 Obesity' "
            f"WHEN {x} < 40 THEN 'Class 2 Obesity' ELSE 'Class 3 Obesity' END)")


def bmi_points(x):
    c = bmi_clin(x)
    return (f"(CASE WHEN {c} = 'Healthy Weight' THEN 0 WHEN {c} IN ('Underweight', 'Overweight') THEN 1 "
            f"WHEN {c} = 'Class 1 Obesity' THEN 2 ELSE 3 END)")


def bmi_alert(x):
    c = bmi_clin(x)
    return f"(CASE WHEN {c} = 'Healthy Weight' THEN []::VARCHAR[] ELSE ['BMI is in the ' || {c} || ' range.'] END)"


def sym_points(n):
    return f"(CASE WHEN {n} >= 4 THEN 2 WHEN {n} >= 2 THEN 1 ELSE 0 END)"
