"""Boundary tables for every threshold of the clinical and feature rules."""

from pyspark.sql import functions as F

from carelake.functions import vitals as V


def _one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_age_groups(spark):
    ages = [0, 12, 18, 19, 35, 36, 50, 51, 65, 66, 120, 121, -1]
    got = _one(spark, [(a,) for a in ages], "a int", V.age_group("a"))
    assert got == ["Child", "Child", "Child", "Young", "Young", "Adult", "Adult", "Middle_Age", "Middle_Age",
                   "Senior", "Senior", None, None]
    live = _one(spark, [(a,) for a in ages], "a int", V.age_group("a", live=True))
    assert live[-2] == "Senior" and live[-1] == "Child"


def test_training_bands(spark):
    assert _one(spark, [(x,) for x in (18.4, 18.5, 24.9, 25.0, 29.9, 30.0, None)], "x double",
                V.bmi_category("x")) == ["Underweight", "Normal", "Normal", "Overweight", "Overweight", "Obese", "Obese"]
    assert _one(spark, [(x,) for x in (69.9, 70.0, 99.9, 100.0, 125.9, 126.0)], "x double",
                V.glucose_category("x")) == ["Low", "Normal", "Normal", "Prediabetes", "Prediabetes", "High"]
    assert _one(spark, [(x,) for x in (59.0, 60.0, 79.0, 80.0, 89.0, 90.0)], "x double",
                V.bp_category("x")) == ["Low", "Normal", "Normal", "Prehypertension", "Prehypertension", "High"]
    assert _one(spark, [(x,) for x in range(0, 8)], "x int", V.symptom_load_group("x")) == [
        "Minimal", "Minimal", "Moderate", "Moderate", "High", "High", "Severe", "Severe"]
    assert _one(spark, [(x,) for x in (2, 3, 4, 5, 6, 7)], "x int", V.risk_group("x")) == [
        "Low", "Moderate", "Moderate", "High", "High", "Very_High"]


def test_blood_pressure_bands(spark):
    cases = {
        (89, 60): "Low Blood Pressure", (90, 59): "Low Blood Pressure", (119, 79): "Normal",
        (120, 79): "Elevated Blood Pressure", (129, 79): "Elevated Blood Pressure", (130, 79): "Stage 1 Hypertension",
        (129, 80): "Stage 1 Hypertension", (140, 79): "Stage 2 Hypertension", (139, 90): "Stage 2 Hypertension",
        (180, 120): "Stage 2 Hypertension", (181, 119): "Severe Hypertension", (180, 121): "Severe Hypertension",
        (190, 55): "Low Blood Pressure",
    }
    df = spark.createDataFrame([(float(s), float(d)) for s, d in cases], "s double, d double")
    got = {(int(r.s), int(r.d)): (r.c, r.u, r.p) for r in df.select(
        "s", "d", V.bp_assessment("s", "d")["clinical_category"].alias("c"),
        V.bp_assessment("s", "d")["urgent_flag"].alias("u"),
        V.bp_assessment("s", "d")["severity_points"].alias("p")).collect()}
    for k, v in cases.items():
        assert got[k][0] == v, k
    assert got[(181, 119)][1] is True and got[(181, 119)][2] == 4
    assert got[(190, 55)][1] is False  # Low is tested before Severe


def test_glucose_bands(spark):
    rows = [(53.9, "fasting"), (54.0, "fasting"), (69.9, "random"), (70.0, "fasting"), (99.0, "fasting"),
            (99.5, "fasting"), (125.0, "fasting"), (126.0, "fasting"), (139.9, "random"), (140.0, "random"),
            (199.9, "random"), (200.0, "random"), (100.0, "Fasting "), (100.0, "other")]
    df = spark.createDataFrame(rows, "g double, t string")
    a = V.glucose_assessment("g", "t")
    got = [(r.c, r.e) for r in df.select(a["clinical_category"].alias("c"), a["error"].alias("e")).collect()]
    assert [c for c, _ in got] == [
        "Severe Hypoglycemia", "Low Glucose", "Low Glucose", "Normal Fasting Glucose", "Normal Fasting Glucose",
        "Prediabetes Range", "Prediabetes Range", "Diabetes Range", "Normal Random Glucose",
        "Elevated Random Glucose", "Elevated Random Glucose", "Diabetes Range", "Prediabetes Range", None]
    assert got[-1][1] == V.GLUCOSE_TYPE_ERROR and got[-2][1] is None


def test_bmi_bands(spark):
    vals = [10.0, 18.5, 25.0, 30.0, 35.0, 40.0, 60.0, 60.1]
    df = spark.createDataFrame([(v,) for v in vals], "b double")
    a = V.bmi_assessment("b")
    got = [(r.c, r.p) for r in df.select(a["clinical_category"].alias("c"), a["severity_points"].alias("p")).collect()]
    assert got == [("Underweight", 1), ("Healthy Weight", 0), ("Overweight", 1), ("Class 1 Obesity", 2),
                   ("Class 2 Obesity", 3), ("Class 3 Obesity", 3), ("Class 3 Obesity", 3), ("Class 3 Obesity", 3)]


def test_worked_examples(spark):
    """High case (148/96, fasting 145, BMI 31.2, 4 symptoms -> 3+3+2+2 = 10 -> High) and critical case."""
    df = spark.createDataFrame([(148.0, 96.0, 145.0, "fasting", 31.2, 4), (190.0, 124.0, 52.0, "random", 33.4, 3)],
                               "s double, d double, g double, t string, b double, n int")
    c = V.clinical_risk(V.bp_assessment("s", "d"), V.glucose_assessment("g", "t"), V.bmi_assessment("b"), F.col("n"))
    got = df.select(c["risk_group"].alias("g"), c["clinical_score"].alias("p")).collect()
    assert (got[0].g, got[0].p) == ("High", 10)
    assert got[1].g == "Critical"


def test_parse_bp_and_bmi(spark):
    df = spark.createDataFrame([("120/80",), ("bp 148 / 96 mmHg",), ("120",), ("0/80",), (None,), ("12.5/7",)],
                               "t string")
    got = [(r.s, r.d) for r in df.select(V.parse_bp("t")["systolic"].alias("s"),
                                         V.parse_bp("t")["diastolic"].alias("d")).collect()]
    assert got == [(120.0, 80.0), (148.0, 96.0), (None, None), (None, None), (None, None), (12.5, 7.0)]
    disp = [r[0] for r in df.select(V.parse_bp_display("t")["systolic"]).collect()]
    assert disp == [120, 148, None, None, None, None]
    hw = spark.createDataFrame([(165.0, 60.0), (0.0, 60.0), (170.0, 72.25)], "h double, w double")
    assert [r[0] for r in hw.select(V.bmi_from_height_weight("h", "w")).collect()] == [22.0, None, 25.0]
