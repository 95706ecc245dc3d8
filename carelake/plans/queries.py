"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator group.

Every query reads the driver tables through the fixture views, so its work
grows with the data; none runs on fixed literal input alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import features as FE
from ..operators import scoring as SC
from ..sources import views as VW
from ..sources.tables import table_path
from ..streaming.sources import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _clean(spark, sf_dir, dup=False):
    raw = VW.patients_raw_with_duplicates(spark, sf_dir) if dup else VW.patients_raw(spark, sf_dir)
    return C.clean_patients(raw)


def _featured(spark, sf_dir):
    return FE.row_features(_clean(spark, sf_dir))


_reference_paths: dict[tuple, str] = {}


def reference_table(spark, sf_dir, cleaned: DataFrame | None = None) -> DataFrame:
    """R6 as a stored table: the profile counts of the training data, written to the
    shared folder once per session and version of the data, and read by all scoring.
    ``cleaned``: the cleaned patients, where a query has them stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, "orders"))
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, str(path), status.getModificationTime(), status.getLen())
    if key not in _reference_paths:
        out = scratch_path(spark, "reference")
        featured = _featured(spark, sf_dir) if cleaned is None else FE.row_features(cleaned)
        SC.reference_frequencies(featured).write.parquet(out)
        _reference_paths[key] = out
    return spark.read.parquet(_reference_paths[key])


def q_clean_patients(spark, sf_dir):
    return _clean(spark, sf_dir, dup=True)


def q_clean_report(spark, sf_dir):
    raw = VW.patients_raw_with_duplicates(spark, sf_dir)
    return C.clean_report(raw, C.clean_patients(raw))


def q_null_profile(spark, sf_dir):
    return C.null_profile(VW.patients_raw_with_duplicates(spark, sf_dir)).select("column_name", "null_count")


def q_feature_severity(spark, sf_dir):
    return _featured(spark, sf_dir).select(
        "seq", "Patient_ID", "Symptom_Count", "Unique_Symptom_Count", "Symptom_Load_Group", "Multi_System_Symptoms",
        "Age_Group", "BMI_Category", "Glucose_Category", "BP_Category", "BMI_Severity_Score",
        "Glucose_Severity_Score", "BP_Severity_Score", "Symptom_Severity_Score", "Vital_Severity_Score",
        "Overall_Severity_Score", "Critical_Vitals_Flag")


def q_feature_risk_score(spark, sf_dir):
    return _featured(spark, sf_dir).select(
        "seq", "Patient_ID", *FE.RISK_FLAGS, "Metabolic_Risk_Count", "Risk_Score", "Risk_Factor_Group")


def q_risk_group_distribution(spark, sf_dir):
    return FE.risk_group_distribution(_featured(spark, sf_dir))


def q_top_symptoms(spark, sf_dir):
    return FE.top_symptoms(_featured(spark, sf_dir)).select("symptom", "n", "rank")


def q_top_symptom_pairs(spark, sf_dir):
    return FE.top_symptom_pairs(_featured(spark, sf_dir)).select("first_symptom", "second_symptom", "n", "rank")


def q_symptom_flags(spark, sf_dir):
    f = _featured(spark, sf_dir)
    vocab = FE.vocabulary_names(FE.top_symptoms(f), "SYM_", ["symptom"])  # <= 15 names, as for SYM_ columns
    return FE.flags_long(f, vocab).select("seq", "Patient_ID", "feature", "flag")


def q_pair_flags(spark, sf_dir):
    f = _featured(spark, sf_dir)
    vocab = FE.vocabulary_names(FE.top_symptom_pairs(f), "PAIR_", ["first_symptom", "second_symptom"])  # <= 10 pairs
    return FE.flags_long(f, vocab).select("seq", "Patient_ID", "feature", "flag")


def q_profile_frequency(spark, sf_dir):
    return FE.profile_frequency(_featured(spark, sf_dir)).select(
        "seq", "Patient_ID", "Symptom_Profile_Frequency", "Age_Group_Profile_Frequency", "Gender_Profile_Frequency",
        "Repeated_Symptom_Pattern", "Recurring_Demographic_Pattern", "Historical_Pattern_Score")


def registry() -> dict[str, Query]:
    from .queries_records import registry_records

    out = registry_base()
    out.update(registry_scoring())
    out.update(registry_records())
    from .queries_model import registry_model

    out.update(registry_model())
    from .queries_stream import registry_stream

    out.update(registry_stream())
    from .queries_extra import registry_extra

    out.update(registry_extra())
    return out


def registry_base() -> dict[str, Query]:
    return {
        "clean_patients": q_clean_patients,
        "clean_report": q_clean_report,
        "null_profile": q_null_profile,
        "feature_severity": q_feature_severity,
        "feature_risk_score": q_feature_risk_score,
        "risk_group_distribution": q_risk_group_distribution,
        "top_symptoms": q_top_symptoms,
        "top_symptom_pairs": q_top_symptom_pairs,
        "symptom_flags": q_symptom_flags,
        "pair_flags": q_pair_flags,
        "profile_frequency": q_profile_frequency,
    }


# ------------------------------------------------------------ scoring rules
from ..functions import keywords as K  # noqa: E402
from ..functions import vitals as V  # noqa: E402
from ..operators import records as RC  # noqa: E402


def _j(c, sep=" | "):
    return F.array_join(c, sep)


def _reference(spark, sf_dir):
    """R6 reference frequency tables from the training feature table."""
    return reference_table(spark, sf_dir)


def q_bp_assessment(spark, sf_dir):
    r = VW.score_requests(spark, sf_dir)
    a = V.bp_assessment("systolic_bp", "diastolic_bp")
    return r.select("request_id", "systolic_bp", "diastolic_bp", a["clinical_category"].alias("clinical_category"),
                    a["legacy_category"].alias("legacy_category"), a["severity_points"].alias("severity_points"),
                    a["urgent_flag"].alias("urgent_flag"), _j(a["medical_alerts"]).alias("medical_alerts"))


def q_glucose_assessment(spark, sf_dir):
    r = VW.score_requests(spark, sf_dir)
    a = V.glucose_assessment("glucose", "glucose_type")
    return r.select("request_id", "glucose", a["glucose_type"].alias("glucose_type"),
                    a["clinical_category"].alias("clinical_category"), a["legacy_category"].alias("legacy_category"),
                    a["severity_points"].alias("severity_points"), a["urgent_flag"].alias("urgent_flag"),
                    _j(a["medical_alerts"]).alias("medical_alerts"))


def q_bmi_assessment(spark, sf_dir):
    r = VW.score_requests(spark, sf_dir)
    a = V.bmi_assessment("bmi")
    return r.select("request_id", "bmi", a["clinical_category"].alias("clinical_category"),
                    a["legacy_category"].alias("legacy_category"), a["severity_points"].alias("severity_points"),
                    _j(a["medical_alerts"]).alias("medical_alerts"),
                    V.bmi_display_band("bmi").alias("display_band"),
                    V.bmi_display_band("bmi", six_band=True).alias("display_band6"))


def q_clinical_risk(spark, sf_dir):
    live = SC.live_features(VW.score_requests(spark, sf_dir), None)
    c = F.col("clinical")
    return live.select("request_id", F.col("f_symptom_count").alias("symptom_count"),
                       c["risk_group"].alias("clinical_risk_group"), c["clinical_score"].alias("clinical_score"),
                       c["symptom_points"].alias("symptom_points"), c["booking_priority"].alias("booking_priority"),
                       c["urgent_flag"].alias("urgent_flag"), _j(c["alerts"]).alias("alerts"))


def q_risk_scoring(spark, sf_dir):
    """Live features, rule predictor, final group, keyword override."""
    s = SC.score(VW.score_requests(spark, sf_dir), _reference(spark, sf_dir))
    p = F.col("risk_probabilities")
    return s.select("request_id", "model_risk_group", F.col("clinical.risk_group").alias("clinical_risk_group"),
                    "risk_group", "booking_priority", "Vital_Severity_Score", "Overall_Severity_Score",
                    "Symptom_Profile_Frequency", "Age_Group_Profile_Frequency", "Gender_Profile_Frequency",
                    "Historical_Pattern_Score",
                    F.element_at(p, F.lit("High")).alias("prob_high"),
                    F.element_at(p, F.lit("Low")).alias("prob_low"),
                    F.element_at(p, F.lit("Moderate")).alias("prob_moderate"))


def q_parse_bp(spark, sf_dir):
    d = SC.parse_details(VW.submissions(spark, sf_dir))
    t = F.col("d.blood_pressure")
    p, q = V.parse_bp(t), V.parse_bp_display(t)
    return d.select("id", t.alias("bp_text"), p["systolic"].alias("systolic"), p["diastolic"].alias("diastolic"),
                    q["systolic"].alias("display_systolic"), q["diastolic"].alias("display_diastolic"))


def q_quick_risk(spark, sf_dir):
    r = K.add_quick_risk(VW.score_requests(spark, sf_dir), "symptoms", "q_")
    return r.select("request_id", F.col("q_risk_level").alias("risk_level"), F.col("q_score").alias("score"),
                    F.col("q_symptom_count").alias("symptom_count"), F.col("q_symptoms").alias("symptom_text"),
                    _j(F.col("q_triggers")).alias("triggers"), _j(F.col("q_matched_high"), ", ").alias("matched_high"),
                    _j(F.col("q_matched_medium"), ", ").alias("matched_medium"),
                    _j(F.col("q_matched_low"), ", ").alias("matched_low"))


def q_nurse_triage(spark, sf_dir):
    t = SC.nurse_triage(VW.score_requests(spark, sf_dir), _reference(spark, sf_dir))
    return t.select("request_id", "valid", _j(F.col("validation_errors")).alias("validation_errors"), "triage_level",
                    "priority", "show_on_top", _j(F.col("emergency_alerts")).alias("emergency_alerts"),
                    _j(F.col("tags"), ", ").alias("tags"), "appointment_recommendation",
                    _j(F.col("suggestions")).alias("suggestions"), "nurse_comment", "symptom_count",
                    "clinical_risk_group", _j(F.col("notes")).alias("notes"))


def q_latest_details(spark, sf_dir):
    return RC.latest_details(VW.submissions(spark, sf_dir)).select("email", "id", "submitted_at", "payload_json")


def q_patient_risk(spark, sf_dir):
    hd = RC.health_details(VW.submissions(spark, sf_dir))
    r = SC.patient_risk(hd, _reference(spark, sf_dir))
    return r.select("email", "risk_level", "risk_source", "risk_booking_priority")


def q_symptom_advice(spark, sf_dir):
    hd = RC.health_details(VW.submissions(spark, sf_dir))
    r = SC.patient_risk(hd, _reference(spark, sf_dir))
    a = K.symptom_advice(F.col("d.symptoms"), "risk_level", "risk_booking_priority")
    return r.select("email", a["has_symptoms"].alias("has_symptoms"),
                    _j(a["possible_causes"]).alias("possible_causes"), _j(a["self_care"]).alias("self_care"),
                    _j(a["next_steps"]).alias("next_steps"))


def registry_scoring() -> dict[str, Query]:
    return {
        "bp_assessment": q_bp_assessment,
        "glucose_assessment": q_glucose_assessment,
        "bmi_assessment": q_bmi_assessment,
        "clinical_risk": q_clinical_risk,
        "risk_scoring": q_risk_scoring,
        "parse_bp": q_parse_bp,
        "quick_risk": q_quick_risk,
        "nurse_triage": q_nurse_triage,
        "latest_details": q_latest_details,
        "patient_risk": q_patient_risk,
        "symptom_advice": q_symptom_advice,
    }
