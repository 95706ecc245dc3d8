"""Score whole request / patient tables at once.

The live feature row (R8) is built once per input row and shared by the model
predictor, the clinical rules (R1-R5) and the nurse rules (N1-N9).  Reference
profile frequencies (R6) are grouped counts of the training feature table,
joined with ``left`` joins (AQE broadcasts them while they are small).

The model is a pluggable predictor: ``rule_predictor`` applies the training
label's own rule (F17-F19) to the live row, so the scored table can be checked
exactly against SQL; ``carelake.operators.model.model_predictor`` uses the
fitted ``pyspark.ml`` pipeline instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import messages as MSG
from ..functions import vitals as V
from ..functions.text import (GENDER_CODES, non_null, normalize_text, split_symptoms, standardize_gender,
                              standardize_symptoms, symptom_tokens)

# Rank of the combined risk groups (model vs clinical).
RISK_RANK = {"Low": 0, "Moderate": 1, "High": 2, "Critical": 3}

LIVE_INPUTS = ["age", "gender", "symptoms", "glucose", "glucose_type", "systolic_bp", "diastolic_bp", "bmi"]


# Label domains of the batch age groups (F11) and standardised genders.
AGE_GROUPS = ["Child", "Young", "Adult", "Middle_Age", "Senior"]
GENDERS = ["Female", "Male", "Other"]


def reference_frequencies(featured: DataFrame) -> DataFrame:
    """Profile counts of the reference feature table, all three granularities
    in ONE grouped table keyed by the symptom profile.

    Age group and gender have fixed label domains, so the (age group, profile)
    and (gender, profile) counts are conditional counts of the same aggregate:
    the feature table is read once, pre-aggregated map-side, and joined once.
    """
    ref = featured.select(standardize_symptoms("Symptoms").alias("ref_symptoms"), "Age_Group", "Gender")
    aggs = [F.count(F.lit(1)).cast("int").alias("ref_symptom_freq")]
    aggs += [F.count_if(F.col("Age_Group") == g).cast("int").alias(f"ref_age_{g}") for g in AGE_GROUPS]
    aggs += [F.count_if(F.col("Gender") == g).cast("int").alias(f"ref_gender_{g}") for g in GENDERS]
    return ref.groupBy("ref_symptoms").agg(*aggs)


def _pick(label: Column, prefix: str, domain: list[str]) -> Column:
    expr = None
    for g in domain:
        expr = F.when(label == g, F.col(f"{prefix}{g}")) if expr is None else expr.when(label == g, F.col(f"{prefix}{g}"))
    return expr


def live_features(inputs: DataFrame, ref: DataFrame | None) -> DataFrame:
    """Model feature row + clinical assessment for every input row."""
    d = inputs.select(
        "*",
        standardize_gender("gender").alias("std_gender"),
        standardize_symptoms("symptoms").alias("std_symptoms"),
        normalize_text("glucose_type", True).alias("std_glucose_type"),
    )
    d = d.withColumn("symptom_list", split_symptoms("std_symptoms"))
    d = d.select(
        "*",
        F.size("symptom_list").cast("int").alias("f_symptom_count"),
        F.size(F.array_distinct("symptom_list")).cast("int").alias("f_unique_symptom_count"),
        V.age_group("age", live=True).alias("f_age_group"),
        V.bp_assessment("systolic_bp", "diastolic_bp").alias("bp"),
        V.glucose_assessment("glucose", "std_glucose_type", normal=True).alias("glu"),
        V.bmi_assessment("bmi").alias("bmia"),
    ).drop("std_glucose_type")
    d = d.select(
        "*",
        V.symptom_load_group("f_symptom_count").alias("f_symptom_load_group"),
        V.score_of(V.BMI_SCORE, F.col("bmia.legacy_category")).alias("f_bmi_severity"),
        V.score_of(V.GLUCOSE_SCORE, F.col("glu.legacy_category")).alias("f_glucose_severity"),
        V.score_of(V.BP_SCORE, F.col("bp.legacy_category")).alias("f_bp_severity"),
        V.clinical_risk(F.col("bp"), F.col("glu"), F.col("bmia"), F.col("f_symptom_count")).alias("clinical"),
    )
    d = d.withColumns({
        "f_symptom_severity": V.score_of(V.SYMPTOM_SCORE, "f_symptom_load_group"),
        "f_vital_severity": (F.col("f_bmi_severity") + F.col("f_glucose_severity") + F.col("f_bp_severity"))
        .cast("int")})
    d = d.withColumn("f_overall_severity", (F.col("f_vital_severity") + F.col("f_symptom_severity")).cast("int"))
    if ref is not None:
        d = d.join(ref, d["std_symptoms"] == ref["ref_symptoms"], "left")
        d = d.withColumns({
            "ref_symptom_freq": F.coalesce(F.col("ref_symptom_freq"), F.lit(0)),
            "ref_age_freq": F.coalesce(_pick(F.col("f_age_group"), "ref_age_", AGE_GROUPS), F.lit(0)),
            "ref_gender_freq": F.coalesce(_pick(F.col("std_gender"), "ref_gender_", GENDERS), F.lit(0))})
        d = d.drop("ref_symptoms", *[f"ref_age_{g}" for g in AGE_GROUPS], *[f"ref_gender_{g}" for g in GENDERS])
    else:
        d = d.withColumns({c: F.lit(0) for c in ("ref_symptom_freq", "ref_age_freq", "ref_gender_freq")})
    d = d.withColumns({
        "f_repeated_pattern": (F.col("ref_symptom_freq") >= 3).cast("int"),
        "f_recurring_pattern": ((F.col("ref_age_freq") >= 2) | (F.col("ref_gender_freq") >= 2)).cast("int")})
    return d.withColumn("f_historical_score", (F.col("f_repeated_pattern") + F.col("f_recurring_pattern")).cast("int"))


def model_frame(live: DataFrame) -> DataFrame:
    """The live row under the training column names (what the model sees)."""
    gcode = F.when(F.col("std_gender") == "Female", GENDER_CODES["Female"]).when(
        F.col("std_gender") == "Male", GENDER_CODES["Male"]).otherwise(GENDER_CODES["Other"])
    new = {"age", "gender", "gender_encoded", "symptom_count", "glucose", "bloodpressure", "bmi"}
    keep = [F.col(c) for c in live.columns if c.lower() not in new]
    return live.select(
        *keep,
        F.col("age").cast("int").alias("Age"), F.col("std_gender").alias("Gender"), gcode.alias("Gender_Encoded"),
        F.col("f_symptom_count").alias("Symptom_Count"), F.col("glucose").cast("double").alias("Glucose"),
        F.col("diastolic_bp").cast("double").alias("BloodPressure"), F.col("bmi").cast("double").alias("BMI"),
        F.col("f_unique_symptom_count").alias("Unique_Symptom_Count"),
        F.col("f_symptom_load_group").alias("Symptom_Load_Group"),
        (F.col("f_unique_symptom_count") >= 4).cast("int").alias("Multi_System_Symptoms"),
        F.col("f_age_group").alias("Age_Group"), F.col("bmia.legacy_category").alias("BMI_Category"),
        F.col("glu.legacy_category").alias("Glucose_Category"), F.col("bp.legacy_category").alias("BP_Category"),
        F.col("f_bmi_severity").alias("BMI_Severity_Score"), F.col("f_glucose_severity").alias("Glucose_Severity_Score"),
        F.col("f_bp_severity").alias("BP_Severity_Score"), F.col("f_symptom_severity").alias("Symptom_Severity_Score"),
        F.col("f_vital_severity").alias("Vital_Severity_Score"),
        F.col("f_overall_severity").alias("Overall_Severity_Score"),
        F.col("ref_symptom_freq").alias("Symptom_Profile_Frequency"),
        F.col("ref_age_freq").alias("Age_Group_Profile_Frequency"),
        F.col("ref_gender_freq").alias("Gender_Profile_Frequency"),
        F.col("f_repeated_pattern").alias("Repeated_Symptom_Pattern"),
        F.col("f_recurring_pattern").alias("Recurring_Demographic_Pattern"),
        F.col("f_historical_score").alias("Historical_Pattern_Score"),
    )


def rule_predictor(frame: DataFrame) -> DataFrame:
    """Label rule of the training target (F17-F19) on the live row.

    Adds ``model_risk_group`` and a one-hot ``risk_probabilities`` map.
    """
    score = ((F.col("Age") >= 60).cast("int") + (F.col("Age") <= 12).cast("int")
             + (F.col("Symptom_Count") >= 4).cast("int") + (F.col("Glucose") >= 126).cast("int")
             + (F.col("BloodPressure") >= 90).cast("int") + (F.col("BMI") >= 30).cast("int")
             + (F.col("Vital_Severity_Score") >= 4).cast("int"))
    group = V.risk_group(score)
    labels = ["High", "Low", "Moderate"]
    probs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]),
                              F.array(*[F.when(group == x, 1.0).otherwise(0.0) for x in labels]))
    return frame.withColumn("model_risk_group", group).withColumn("risk_probabilities", probs)


Predictor = Callable[[DataFrame], DataFrame]


def _rank(c: Column) -> Column:
    return V.score_of(RISK_RANK, c)


def combine_groups(df: DataFrame) -> DataFrame:
    """R9 + R10: final group (model wins ties) and booking priority."""
    m, c = F.col("model_risk_group"), F.col("clinical.risk_group")
    final = F.when(_rank(m) >= _rank(c), m).otherwise(c)
    urgent = F.col("clinical.urgent_flag")
    booking = (F.when(urgent, "Immediate emergency review recommended")
               .when(final == "High", "Urgent review recommended")
               .when(final == "Moderate", "Priority follow-up recommended")
               .otherwise("Standard scheduling is acceptable"))
    return df.withColumn("risk_group", final).withColumn("booking_priority", booking)


def keyword_override(df: DataFrame, symptoms: str = "symptoms") -> DataFrame:
    """Quick keyword High lifts Low/Moderate to High."""
    d = K.add_quick_risk(df, symptoms, "kq_")
    lift = (F.col("kq_risk_level") == "High") & F.col("risk_group").isin("Low", "Moderate")
    d = (d.withColumn("booking_priority", F.when(lift, "Urgent review recommended").otherwise(F.col("booking_priority")))
         .withColumn("risk_group", F.when(lift, "High").otherwise(F.col("risk_group"))))
    return d.drop(*[c for c in d.columns if c.startswith("kq_")])


def score(inputs: DataFrame, ref: DataFrame | None, predictor: Predictor = rule_predictor,
          override: bool = True) -> DataFrame:
    """R12 core: live features -> model -> final group -> keyword override."""
    scored = combine_groups(predictor(model_frame(live_features(inputs, ref))))
    return keyword_override(scored) if override else scored


# ------------------------------------------------------------- nurse rules

NV = MSG.NURSE_VALIDATION
EA = MSG.EMERGENCY_ALERTS


def nurse_triage(inputs: DataFrame, ref: DataFrame | None) -> DataFrame:
    """N1-N9 over a table of inputs (vitals may be NULL)."""
    d = K.add_quick_risk(inputs, F.col("symptoms").cast("string"), "nq_")
    d = d.withColumn("n_tokens", symptom_tokens("symptoms"))
    d = d.withColumn("n_joined", K.joined_tokens(F.col("n_tokens")))  # tokens computed once, then joined
    toks = F.col("n_tokens")
    has = lambda p: K.symptom_has(F.col("n_joined"), p)
    age, s, dia, g, b = (F.col(c) for c in ("age", "systolic_bp", "diastolic_bp", "glucose", "bmi"))
    errors = non_null(
        F.when((age <= 0) | (age > 120), F.lit(NV["age"])),
        F.when(s.isNull() | dia.isNull(), F.lit(NV["bp_missing"])),
        F.when(s.isNotNull() & dia.isNotNull() & ((s < 50) | (s > 250)), F.lit(NV["systolic"])),
        F.when(s.isNotNull() & dia.isNotNull() & ((dia < 30) | (dia > 150)), F.lit(NV["diastolic"])),
        F.when(g.isNull(), F.lit(NV["glucose_missing"])),
        F.when(g <= 0, F.lit(NV["glucose_low"])),
        F.when(g > 1200, F.lit(NV["glucose_high"])),
        F.when(b.isNull(), F.lit(NV["bmi_missing"])),
        F.when((b <= 10) | (b > 60), F.lit(NV["bmi"])),
    )
    n_sym = F.size(toks)
    kw_high = F.col("nq_risk_level") == "High"
    sym_alerts = non_null(
        F.when(has("unconscious") | has("unconsciousness"), F.lit(EA["unconscious"])),
        F.when(has("chest pain") & has("shortness of breath"), F.lit(EA["heart"])),
        F.when(n_sym >= 5, F.lit(EA["load"])),
    )
    d = d.select("*", errors.alias("validation_errors"), n_sym.cast("int").alias("n_symptom_count"),
                 kw_high.alias("keyword_high"), sym_alerts.alias("symptom_alerts"),
                 (has("fever") & has("cough")).alias("infection"), has("headache").alias("has_headache"),
                 has("fatigue").alias("has_fatigue"), has("fever").alias("has_fever"))
    valid = F.size("validation_errors") == 0
    # Full path: the clinical assessment runs on fasting when no type is given.
    full_in = d.withColumn("glucose_type", F.coalesce(F.col("glucose_type"), F.lit("fasting")))
    full = live_features(full_in, ref)
    bp_cat, glu_cat = F.col("bp.clinical_category"), F.col("glu.clinical_category")
    vital_alerts = non_null(
        F.when((s > 180) | (dia > 120), F.lit(EA["crisis"])),
        F.when(g < 54, F.lit(EA["hypo"])),
        F.when(g > 300, F.lit(EA["hyper"])),
    )
    alerts_valid = F.concat(F.col("symptom_alerts"), vital_alerts)
    lvl_valid = (F.when(F.size(alerts_valid) > 0, "Critical")
                 .when(bp_cat.isin("Stage 2 Hypertension", "Severe Hypertension") | (glu_cat == "Diabetes Range")
                       | F.col("keyword_high"), "High")
                 .otherwise(F.col("clinical.risk_group")))
    lvl_invalid = (F.when(F.size("symptom_alerts") > 0, "Critical").when(F.col("keyword_high"), "High")
                   .otherwise("Needs vitals"))
    level = F.when(valid, lvl_valid).otherwise(lvl_invalid)
    stage = bp_cat.isin("Stage 1 Hypertension", "Stage 2 Hypertension", "Severe Hypertension")
    tags_valid = F.array_sort(F.array_distinct(non_null(
        F.when(F.col("infection"), F.lit(MSG.TAGS["infection"])),
        F.when(F.col("has_headache") & stage, F.lit(MSG.TAGS["hypertension"])),
        F.when(F.col("has_fatigue") & (glu_cat == "Diabetes Range"), F.lit(MSG.TAGS["diabetes"])),
        F.when(F.col("n_symptom_count") >= 4, F.lit(MSG.TAGS["multi"])),
    )))
    tags_invalid = non_null(F.when(F.col("infection"), F.lit(MSG.TAGS["infection"])))
    lv = F.col("triage_level")

    def by_level(texts: dict, levels: tuple) -> Column:
        expr = None
        for k in levels:
            expr = F.when(lv == k, texts[k]) if expr is None else expr.when(lv == k, texts[k])
        return expr.otherwise(texts["other"])

    rec_valid = by_level(MSG.RECOMMENDATION_VALID, ("Critical", "High", "Moderate"))
    pri_valid = by_level(MSG.PRIORITY_VALID, ("Critical", "High", "Moderate"))
    com_valid = by_level(MSG.COMMENT_VALID, ("Critical", "High", "Moderate"))
    rec_invalid = by_level(MSG.RECOMMENDATION_INVALID, ("Critical", "High"))
    pri_invalid = by_level(MSG.PRIORITY_INVALID, ("Critical", "High"))
    com_invalid = by_level(MSG.COMMENT_INVALID, ("Critical", "High"))
    sg = MSG.SUGGESTIONS_VALID
    sugg_valid = non_null(
        F.when(g < 70, F.lit(sg["low_glucose"])),
        F.when(F.col("has_fever"), F.lit(sg["fever"])),
        F.when(stage, F.lit(sg["bp"])),
    )
    sugg_invalid = F.array(*[F.lit(x) for x in MSG.SUGGESTIONS_INVALID])
    notes = non_null(
        F.when(F.col("f_repeated_pattern") == 1, F.lit(MSG.NOTES["repeated"])),
        F.when(F.col("f_historical_score") >= 2, F.lit(MSG.NOTES["chronic"])),
    )
    v = F.col("valid")
    res = full.select(
        *inputs.columns,
        valid.alias("valid"),
        "validation_errors",
        level.alias("triage_level"),
        F.when(valid, alerts_valid).otherwise(F.col("symptom_alerts")).alias("emergency_alerts"),
        F.when(valid, tags_valid).otherwise(tags_invalid).alias("tags"),
        F.when(valid, sugg_valid).otherwise(sugg_invalid).alias("suggestions"),
        F.when(valid, F.col("clinical.urgent_flag")).otherwise(F.lit(False)).alias("_urgent"),
        F.col("n_symptom_count").alias("symptom_count"),
        F.when(valid, F.col("f_symptom_count")).alias("clinical_symptom_count"),
        F.when(valid, bp_cat).alias("blood_pressure_category"),
        F.when(valid, glu_cat).alias("glucose_category"),
        F.when(valid, F.col("bmia.clinical_category")).alias("bmi_category"),
        F.when(valid, F.col("clinical.risk_group")).alias("clinical_risk_group"),
        F.when(valid, F.col("f_repeated_pattern")).alias("repeated_symptom_pattern"),
        F.when(valid, F.col("f_historical_score")).alias("historical_pattern_score"),
        F.when(valid, notes).otherwise(F.array().cast("array<string>")).alias("notes"),
    )
    return res.withColumns({
        "show_on_top": F.when(v, (F.size("emergency_alerts") > 0) | F.col("_urgent")).otherwise(
            lv.isin("Critical", "High")),
        "appointment_recommendation": F.when(v, rec_valid).otherwise(rec_invalid),
        "priority": F.when(v, pri_valid).otherwise(pri_invalid),
        "nurse_comment": F.when(v, com_valid).otherwise(com_invalid)}).drop("_urgent")


# --------------------------------------------------- stored documents

DETAILS_SCHEMA = (
    "age INT, gender STRING, symptoms STRING, symptom_count INT, glucose DOUBLE, glucose_type STRING, "
    "blood_pressure STRING, height_cm DOUBLE, weight_kg DOUBLE, bmi DOUBLE, smoking_habit STRING, "
    "alcohol_habit STRING, average_sleep_hours DOUBLE, medical_history STRING, "
    "family_history_major_chronic_disease STRING, submitted_at STRING, updated_at STRING"
)


def parse_details(df: DataFrame, col: str = "payload_json", out: str = "d") -> DataFrame:
    """Lenient JSON decode (bad document or field -> NULL)."""
    return df.withColumn(out, F.from_json(F.col(col), DETAILS_SCHEMA, {"mode": "PERMISSIVE"}))


def details_inputs(df: DataFrame, d: str = "d", nurse: bool = False) -> DataFrame:
    """Map a stored health-details struct to scoring inputs.

    nurse=True applies N10 defaults (age 0, gender Other, fasting).
    """
    bp = V.parse_bp(F.col(f"{d}.blood_pressure"))
    if nurse:
        cols = [F.coalesce(F.col(f"{d}.age"), F.lit(0)).alias("age"),
                F.coalesce(F.when(F.col(f"{d}.gender") != "", F.col(f"{d}.gender")), F.lit("Other")).alias("gender"),
                F.coalesce(F.col(f"{d}.symptoms"), F.lit("")).alias("symptoms"),
                F.col(f"{d}.glucose").alias("glucose"),
                F.coalesce(F.when(F.col(f"{d}.glucose_type") != "", F.col(f"{d}.glucose_type")),
                           F.lit("fasting")).alias("glucose_type")]
    else:
        cols = [F.col(f"{d}.age").alias("age"),
                F.coalesce(F.when(F.col(f"{d}.gender") != "", F.col(f"{d}.gender")), F.lit("Other")).alias("gender"),
                F.coalesce(F.col(f"{d}.symptoms"), F.lit("")).alias("symptoms"),
                F.col(f"{d}.glucose").alias("glucose"), F.lit("fasting").alias("glucose_type")]
    return df.select("*", *cols, bp["systolic"].alias("systolic_bp"), bp["diastolic"].alias("diastolic_bp"),
                     F.col(f"{d}.bmi").alias("bmi"))


def patient_risk(details: DataFrame, ref: DataFrame | None, predictor: Predictor = rule_predictor,
                 d: str = "d") -> DataFrame:
    """3-level risk from a stored document (model path, quick path or none)."""
    inp = details_inputs(details, d)
    has_sym = F.col("symptoms") != ""
    complete = (F.col("age").isNotNull() & F.col("bmi").isNotNull() & F.col("glucose").isNotNull()
                & F.col("systolic_bp").isNotNull() & has_sym)
    inp = K.add_quick_risk(inp, "symptoms", "pq_")
    inp = inp.select("*", complete.alias("_complete"),
                     F.when(F.col("age").isNotNull() & has_sym, F.col("pq_risk_level")).alias("_quick"))
    scored = combine_groups(predictor(model_frame(live_features(inp, ref))))
    quick = F.col("_quick")
    grp = F.col("risk_group")
    norm = F.when(grp.isin("Critical", "High"), "High").when(grp == "Moderate", "Medium").otherwise("Low")
    lift = (quick == "High") & (norm != "High")
    model_level = F.when(lift, "High").otherwise(norm)
    model_booking = F.when(lift, "Urgent review recommended").otherwise(F.col("booking_priority"))
    quick_booking = (F.when(quick == "High", "Urgent review recommended")
                     .when(quick == "Medium", "Priority follow-up recommended")
                     .otherwise("Standard scheduling is acceptable"))
    done = F.col("_complete")
    return scored.select(
        *details.columns,
        F.when(done, model_level).when(quick.isNotNull(), quick).alias("risk_level"),
        F.when(done, F.lit("model")).when(quick.isNotNull(), F.lit("quick")).alias("risk_source"),
        F.when(done, model_booking).when(quick.isNotNull(), quick_booking).alias("risk_booking_priority"),
    )
