"""Every registered query against its DuckDB oracle (sf0.001), as the driver does at sf0.01.

Queries without oracle SQL (fitted model, per-submission stream scoring) get a
rows-only smoke run; the model is checked for quality in test_model.py.
"""

import os

import pytest

import __spark_entry__ as entry

from .oracle_check import compare, duck_connection

SF = os.environ.get("CARELAKE_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SQL = entry.oracle_sql()
SLOW = {"model_evaluation", "model_scoring"}


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_matches_oracle(spark, con, name):
    r = compare(spark, SF, name, QUERIES[name], SQL[name], con)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and n not in SLOW))
def test_rows_only(spark, con, name):
    r = compare(spark, SF, name, QUERIES[name], None, con)
    assert r["spark_rows"] >= 0


def test_every_query_named_in_survey_is_registered():
    wanted = ("clean_patients clean_report null_profile feature_severity feature_risk_score top_symptoms "
              "top_symptom_pairs symptom_flags pair_flags profile_frequency risk_group_distribution "
              "derived_label_distribution stratified_split_counts class_weights confusion_matrix metric_bundle "
              "classification_report bp_assessment glucose_assessment bmi_assessment clinical_risk parse_bp "
              "quick_risk symptom_advice nurse_triage patient_risk users_with_details appointment_enriched "
              "leave_match emergency_available directory booking_admission cancel_admission latest_details "
              "history_topn record_changes changes_exploded merge_patch doctor_appointments dashboard_worklist "
              "dashboard_stats patient_worklist doctor_kpis risk_share doctor_insights date_window_counts "
              "emergency_hours registration_uniqueness field_validation integrity_audit cascade_delete "
              "renumber_ids seed_union bootstrap_import table_inventory truthy_count rate_limit_breaches").split()
    assert not [w for w in wanted if w not in QUERIES]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 4 and df.count() > 0
