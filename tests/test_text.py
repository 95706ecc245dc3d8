"""Text cleaning and keyword rules on small inline tables."""

from pyspark.sql import functions as F

from carelake.functions import keywords as K
from carelake.functions import text as TX


def _col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr).collect()]


def test_normalize_and_gender(spark):
    assert _col(spark, ["  a   b ", "N/A", " NaN ", None, "x"], TX.normalize_text("v")) == ["a b", None, None, None, "x"]
    assert _col(spark, ["Male", " f ", "FEMALE", "m", "non  binary", "xyz", None],
                TX.standardize_gender("v")) == ["Male", "Female", "Female", "Male", "Other", "Other", "Other"]


def test_standardize_symptoms(spark):
    got = _col(spark, ["Fever; cough | FEVER", " NaN ", "", ",,;", "a,b,,c"], TX.standardize_symptoms("v"))
    assert got == ["fever, cough", "unknown", "unknown", "unknown", "a, b, c"]
    counts = _col(spark, ["fever, cough", "unknown"], TX.count_symptoms("v"))
    assert counts == [2, 0]


def test_safe_name(spark):
    assert _col(spark, ["Shortness of Breath", "fatigue (extreme)", "__x__"], TX.safe_name("v")) == [
        "shortness_of_breath", "fatigue__extreme", "x"]


def test_quick_risk(spark):
    df = spark.createDataFrame([(1, "difficulty in breathing"), (2, "mild fever, runny nose"), (3, "fever"),
                                (4, "chest pain; headache"), (5, "vomiting"), (6, "")], "id int, s string")
    out = {r.id: r for r in K.add_quick_risk(df, "s").collect()}
    assert out[1].q_risk_level == "High"  # all words of "difficulty breathing" in one token
    assert out[2].q_risk_level == "Low" and "mild fever" in out[2].q_matched_low
    assert out[3].q_risk_level == "Medium" and out[3].q_matched_medium == ["fever"]
    assert out[4].q_risk_level == "High" and out[4].q_score == 3
    assert out[5].q_matched_medium == ["frequent vomiting"]
    assert out[6].q_risk_level == "Low" and out[6].q_triggers == []


def test_advice(spark):
    df = spark.createDataFrame([("fever, cough", "High", "Urgent review recommended"), ("", None, None)],
                               "s string, r string, b string")
    a = K.symptom_advice(F.col("s"), "r", "b")
    rows = df.select(a.alias("a")).collect()
    assert rows[0].a.possible_causes[0] == "Viral infection / flu-like illness"
    assert rows[0].a.next_steps[1] == "Urgent review recommended"
    assert rows[1].a.has_symptoms is False and rows[1].a.next_steps == []


def test_risk_label_normaliser(spark):
    assert _col(spark, ["High", "moderate", "Medium risk", "low", "", None], K.normalize_risk_label("v")) == [
        "high", "medium", "medium", "low", "unknown", "unknown"]
