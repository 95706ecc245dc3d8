"""Costly expressions stand in a plan once: CASE branches and filters inferred by the optimizer repeat what they name."""

from pyspark.sql import functions as F

from carelake.functions import text as TX
from carelake.functions import vitals as V
from carelake.operators import portal as P
from carelake.operators import scoring as SC


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_normalised_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    for c in (TX.normalize_text("t", True), TX.standardize_symptoms("t"), V.score_of(V.BMI_SCORE, TX.collapse_ws("t"))):
        assert _plan(df.select(c.alias("x"))).count("regexp_replace") == 1


def test_null_like_texts_and_ranks(spark):
    df = spark.createDataFrame([(" A  b ",), ("N/A",), ("",), (None,), (" ,; ",)], "t string")
    got = df.select(TX.normalize_text("t", True), TX.standardize_symptoms("t"), TX.split_symptoms("t")).collect()
    assert [tuple(r) for r in got] == [("a b", "a b", ["a  b"]), (None, "unknown", ["n/a"]), (None, "unknown", []),
                                       (None, "unknown", []), (",;", "unknown", [])]
    ranks = spark.createDataFrame([("Low",), ("Critical",), ("x",), (None,)], "g string").select(SC._rank(F.col("g")))
    assert [r[0] for r in ranks.collect()] == [0, 3, None, None]


def test_bars_filter_nothing_below_the_scores(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('High', 0.255D, 'Low', 2D)), (2, map()), (3, NULL) AS t(k, p)")
    assert sorted(tuple(r) for r in P.probability_bars(df, "k", "p").collect()) == [(1, "High", 2, 26), (1, "Low", 0, 100)]
    inputs = spark.range(5).select(
        F.col("id").alias("request_id"), F.lit(50).alias("age"), F.lit("f").alias("gender"),
        F.concat(F.lit("fever, "), F.col("id").cast("string")).alias("symptoms"), F.lit(90.0).alias("glucose"),
        F.lit("random").alias("glucose_type"), F.col("id").cast("double").alias("systolic_bp"),
        F.col("id").cast("double").alias("diastolic_bp"), F.col("id").cast("double").alias("bmi"))
    plan = _plan(P.probability_bars(SC.score(inputs, None), "request_id", "risk_probabilities"))
    assert plan.count("Filter") == 1 and len(plan) < 50_000
