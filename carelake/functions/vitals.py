"""Vital-sign bands and clinical threshold rules as Column expressions.

Two sets of thresholds exist under similar names: the training features
(F11-F19, one blood-pressure number that behaves like a diastolic value) and
the live clinical assessment (R1-R5, systolic + diastolic, glucose type).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import messages as MSG
from .text import normalize_text

G = MSG.GLUCOSE_ALERTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _arr(*items) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def _empty() -> Column:
    return F.array().cast("array<string>")

# ---------------------------------------------------------------- training bands


def age_group(age, live: bool = False) -> Column:
    """(0..18],(18..35],(35..50],(50..65],(65..120]; 0 is a Child.

    Batch (pd.cut) leaves <0 and >120 unbinned (NULL); live scoring maps
    everything above 65 to Senior.
    """
    a = _col(age)
    chain = F.when(a <= 18, "Child").when(a <= 35, "Young").when(a <= 50, "Adult").when(a <= 65, "Middle_Age")
    if live:
        return chain.otherwise("Senior")
    return F.when((a >= 0) & (a <= 120), chain.otherwise("Senior"))


def bmi_category(v) -> Column:
    """F12 (also the legacy BMI category of R4)."""
    x = _col(v)
    return F.when(x < 18.5, "Underweight").when(x < 25, "Normal").when(x < 30, "Overweight").otherwise("Obese")


def glucose_category(v) -> Column:
    """F13."""
    x = _col(v)
    return F.when(x < 70, "Low").when(x < 100, "Normal").when(x < 126, "Prediabetes").otherwise("High")


def bp_category(v) -> Column:
    """F14 (training: one diastolic-like number)."""
    x = _col(v)
    return F.when(x < 60, "Low").when(x < 80, "Normal").when(x < 90, "Prehypertension").otherwise("High")


def symptom_load_group(count) -> Column:
    """F4."""
    n = _col(count)
    return F.when(n <= 1, "Minimal").when(n <= 3, "Moderate").when(n <= 5, "High").otherwise("Severe")


def risk_group(score) -> Column:
    """Very_High cannot occur (max score 6)."""
    s = _col(score)
    return F.when(s <= 2, "Low").when(s <= 4, "Moderate").when(s <= 6, "High").otherwise("Very_High")


# Ordinal severity maps of the training features.
BMI_SCORE = {"Underweight": 1, "Normal": 0, "Overweight": 1, "Obese": 2}
GLUCOSE_SCORE = {"Low": 1, "Normal": 0, "Prediabetes": 1, "High": 2}
BP_SCORE = {"Low": 1, "Normal": 0, "Prehypertension": 1, "High": 2}
SYMPTOM_SCORE = {"Minimal": 0, "Moderate": 1, "High": 2, "Severe": 3}


def score_of(mapping: dict, c) -> Column:
    """lookup of an ordinal map (a CASE would compute ``c`` anew for every entry)."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(pairs, _col(c)).cast("int")


# ------------------------------------------------------------ clinical rules


def bmi_clinical_category(v) -> Column:
    """Six clinical BMI bands."""
    x = _col(v)
    return (F.when(x < 18.5, "Underweight").when(x < 25, "Healthy Weight").when(x < 30, "Overweight")
            .when(x < 35, "Class 1 Obesity").when(x < 40, "Class 2 Obesity").otherwise("Class 3 Obesity"))


def bp_assessment(systolic, diastolic) -> Column:
    """First matching band wins (Low is tested before Severe)."""
    s, d = _col(systolic), _col(diastolic)
    low = (s < 90) | (d < 60)
    severe = (s > 180) | (d > 120)
    stage2 = (s >= 140) | (d >= 90)
    stage1 = (s >= 130) | (d >= 80)
    elevated = (s >= 120) & (d < 80)

    def pick(*vals):
        return (F.when(low, vals[0]).when(severe, vals[1]).when(stage2, vals[2]).when(stage1, vals[3])
                .when(elevated, vals[4]).otherwise(vals[5]))

    return F.struct(
        pick("Low Blood Pressure", "Severe Hypertension", "Stage 2 Hypertension", "Stage 1 Hypertension",
             "Elevated Blood Pressure", "Normal").alias("clinical_category"),
        pick("Low", "High", "High", "Prehypertension", "Prehypertension", "Normal").alias("legacy_category"),
        pick(F.lit(2), F.lit(4), F.lit(3), F.lit(2), F.lit(1), F.lit(0)).cast("int").alias("severity_points"),
        pick(F.lit(False), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(False)).alias("urgent_flag"),
        pick(*[_arr(MSG.BP_ALERTS[k]) for k in ("low", "severe", "stage2", "stage1", "elevated")], _empty())
        .alias("medical_alerts"),
    )


GLUCOSE_TYPE_ERROR = "glucose_type must be either 'fasting' or 'random'."


def glucose_assessment(glucose, glucose_type, normal: bool = False) -> Column:
    """R2: glucose band by measurement type; bad type -> ``error`` set, rest NULL.  A ``normal`` type is
    a column that went through ``normalize_text`` already; the rules ask for it many times a row."""
    g = _col(glucose)
    t = _col(glucose_type) if normal else normalize_text(glucose_type, True)
    valid = t.isin("fasting", "random")
    fasting = t == "fasting"
    conds = [
        g < 54,
        g < 70,
        fasting & (g <= 99),
        fasting & (g <= 125),
        fasting,
        g < 140,
        g < 200,
    ]

    def pick(*vals):
        expr = F.when(~valid | t.isNull(), None)
        for c, v in zip(conds, vals[:-1]):
            expr = expr.when(c, v)
        return expr.otherwise(vals[-1])

    return F.struct(
        pick("Severe Hypoglycemia", "Low Glucose", "Normal Fasting Glucose", "Prediabetes Range", "Diabetes Range",
             "Normal Random Glucose", "Elevated Random Glucose", "Diabetes Range").alias("clinical_category"),
        pick("Low", "Low", "Normal", "Prediabetes", "High", "Normal", "Prediabetes", "High").alias("legacy_category"),
        pick(*[F.lit(v) for v in (4, 3, 0, 1, 3, 0, 1, 3)]).cast("int").alias("severity_points"),
        pick(*[F.lit(v) for v in (True, False, False, False, False, False, False, False)]).alias("urgent_flag"),
        pick(_arr(G["severe_low"]), _arr(G["low"]), _empty(), _arr(G["fasting_prediabetes"]),
             _arr(G["fasting_diabetes"]), _empty(), _arr(G["random_elevated"]), _arr(G["random_diabetes"]))
        .alias("medical_alerts"),
        F.when(valid, t).alias("glucose_type"),
        F.when(~valid | t.isNull(), F.lit(GLUCOSE_TYPE_ERROR)).alias("error"),
    )


def bmi_assessment(bmi) -> Column:
    """Clinical + legacy BMI class, points and alert."""
    cat = bmi_clinical_category(bmi)
    points = (F.when(cat == "Healthy Weight", 0).when(cat.isin("Underweight", "Overweight"), 1)
              .when(cat == "Class 1 Obesity", 2).otherwise(3)).cast("int")
    alerts = F.when(cat == "Healthy Weight", _empty()).otherwise(
        F.array(F.concat(F.lit("BMI is in the "), cat, F.lit(" range."))))
    return F.struct(cat.alias("clinical_category"), bmi_category(bmi).alias("legacy_category"),
                    points.alias("severity_points"), alerts.alias("medical_alerts"))


def clinical_risk(bp: Column, glu: Column, bmi: Column, symptom_count) -> Column:
    """Points -> clinical group; urgent BP/glucose -> Critical."""
    n = _col(symptom_count)
    sym_points = F.when(n >= 4, 2).when(n >= 2, 1).otherwise(0).cast("int")
    total = (bp["severity_points"] + glu["severity_points"] + bmi["severity_points"] + sym_points).cast("int")
    urgent = bp["urgent_flag"] | glu["urgent_flag"]
    group = F.when(urgent, "Critical").when(total >= 6, "High").when(total >= 3, "Moderate").otherwise("Low")
    booking = (F.when(urgent, "Immediate emergency review recommended")
               .when(total >= 6, "Urgent clinical review recommended")
               .when(total >= 3, "Priority follow-up recommended")
               .otherwise("Standard scheduling is acceptable"))
    alerts = F.concat(bp["medical_alerts"], glu["medical_alerts"], bmi["medical_alerts"])
    return F.struct(group.alias("risk_group"), total.alias("clinical_score"), sym_points.alias("symptom_points"),
                    booking.alias("booking_priority"), urgent.alias("urgent_flag"), alerts.alias("alerts"))


# ---------------------------------------------------------------- parsing


def parse_bp(text) -> Column:
    """First two numbers of free text, both > 0, else NULL struct."""
    nums = F.regexp_extract_all(F.coalesce(_col(text).cast("string"), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), 0)
    s = F.try_element_at(nums, F.lit(1)).try_cast("double")
    d = F.try_element_at(nums, F.lit(2)).try_cast("double")
    ok = (F.size(nums) >= 2) & (s > 0) & (d > 0)
    return F.when(ok, F.struct(s.alias("systolic"), d.alias("diastolic")))


def parse_bp_display(text) -> Column:
    """Strict ``NN(N)/NN(N)`` display parse (dashboard)."""
    pat = r"(\d{2,3})\s*/\s*(\d{2,3})"
    t = _col(text).cast("string")
    hit = t.rlike(pat)
    return F.when(hit, F.struct(F.regexp_extract(t, pat, 1).cast("int").alias("systolic"),
                                F.regexp_extract(t, pat, 2).cast("int").alias("diastolic")))


def bmi_from_height_weight(height_cm, weight_kg) -> Column:
    """Kg / m^2 rounded half up to 0.1; NULL unless both > 0."""
    h, w = _col(height_cm), _col(weight_kg)
    raw = w / ((h / 100) * (h / 100))
    return F.when((h > 0) & (w > 0), F.floor(raw * 10 + 0.5) / 10)


def bmi_display_band(bmi, six_band: bool = False) -> Column:
    """Dashboard wording; empty text unless the value is a positive number."""
    x = _col(bmi)
    missing = x.isNull() | F.isnan(x) | (x <= 0)
    if six_band:
        return (F.when(missing, "-").when(x < 18.5, "Underweight").when(x < 25, "Normal weight")
                .when(x < 30, "Overweight").when(x < 35, "Obesity (Class I)").when(x < 40, "Obesity (Class II)")
                .otherwise("Obesity (Class III)"))
    return (F.when(missing, "").when(x < 18.5, "Underweight").when(x < 25, "Normal").when(x < 30, "Overweight")
            .otherwise("Obesity"))
