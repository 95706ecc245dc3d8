"""Registered queries for the model group (M-series, R8-R12 with the fitted model)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import model as M
from ..operators import model_table as MT
from ..operators import scoring as SC
from ..sources import views as VW
from .queries import _clean, _featured, reference_table


def _baseline_pairs(spark, sf):
    f = _featured(spark, sf).withColumn("baseline", M.severity_baseline(F.col("Overall_Severity_Score")))
    return f, M.pair_counts(f, M.TARGET, "baseline")


def q_stratified_split_counts(spark, sf):
    s = M.stratified_split(M.prepare_dataset(_featured(spark, sf)).select(M.TARGET, "Patient_ID", "seq"))
    return s.groupBy(F.col(M.TARGET).alias("label"), "split").agg(F.count(F.lit(1)).alias("n"))


def q_class_weights(spark, sf):
    w = M.class_weights(M.prepare_dataset(_featured(spark, sf)))
    return w.select(F.col(M.TARGET).alias("label"), "n", F.round("weight", 4).alias("weight"))


def q_confusion_matrix(spark, sf):
    # the (actual, predicted, n) table is k^2 rows: materialise it once, read the
    # label list from it, and pivot it -- the feature pipeline runs one time
    _, pairs = _baseline_pairs(spark, sf)
    pairs = pairs.checkpoint(eager=True)
    return M.confusion_matrix(pairs, "actual", "predicted", M.label_values(pairs, "actual"), "n")


def q_metric_bundle(spark, sf):
    return M.metric_bundle(_baseline_pairs(spark, sf)[1])


def q_classification_report(spark, sf):
    return M.classification_report(_baseline_pairs(spark, sf)[1])


def q_derived_label_distribution(spark, sf):
    f = _featured(spark, sf)
    lvl = M.derive_risk_level(F.col("Age"), F.col("Symptom_Count"))
    return f.groupBy(lvl.alias("risk_level")).agg(F.count(F.lit(1)).alias("n"))


def _fitted(spark, sf, max_iter=M.MAX_ITER):
    feats = FE.feature_table(_clean(spark, sf).checkpoint(eager=True))  # its vocabularies and rows are three passes
    return M.train_and_evaluate(feats, max_iter=max_iter)


def q_model_evaluation(spark, sf):
    """M9-M13 with the fitted model (rows-only check: the model has no SQL twin)."""
    _, summary, _ = _fitted(spark, sf)
    return summary


def q_model_scoring(spark, sf):
    """R8-R12 with the fitted logistic regression as predictor (rows-only check)."""
    cleaned = _clean(spark, sf).checkpoint(eager=True)
    model = M.fit_final(FE.feature_table(cleaned))
    ref = reference_table(spark, sf, cleaned)
    s = SC.score(VW.score_requests(spark, sf), ref, predictor=M.model_predictor(model))
    return s.select("request_id", "model_risk_group", F.col("clinical.risk_group").alias("clinical_risk_group"),
                    "risk_group", "booking_priority",
                    F.to_json("risk_probabilities").alias("risk_probabilities"))


# Inputs of the scores that SQL checks.
SCORED_NUMERIC = ["Age", "BMI", "BloodPressure", "Glucose", "Symptom_Count"]
SCORED_LEVELS = ["Gender", "Symptom_Load_Group"]


def q_linear_scoring(spark, sf):
    """M14's arithmetic against SQL: a model table fitted by class means, scored row by row."""
    f = _featured(spark, sf).select("seq", "Patient_ID", M.TARGET, *SCORED_NUMERIC, *SCORED_LEVELS).checkpoint(eager=True)
    table = MT.centroid_table(f, M.TARGET, SCORED_NUMERIC, SCORED_LEVELS)
    # Sums run in another order in SQL: three decimals, and no label where the best two are that near.
    p = F.sort_array("exact_probabilities", asc=False)
    near = p[0] - F.coalesce(p[1], F.lit(0.0)) < 1e-9
    scored = MT.score_with_table(f, table)
    return scored.select("seq", "Patient_ID", F.when(~near, F.col("model_risk_group")).alias("model_risk_group"),
                         F.round(F.array_max("exact_probabilities"), 3).alias("top_probability"))


MOST_GRADIENT = 1e-4
LEAST_ACCURACY = 0.9404
LEAST_RECALL = 0.9546


def q_model_certificate(spark, sf):
    """M8, M9: per class the training rows, their weight, and whether the fit holds: every derivative of its loss
    near 0, the table's scores those of the pipeline, test accuracy and recall at least the reference's."""
    data = M.stratified_split(M.prepare_dataset(FE.feature_table(_clean(spark, sf)).checkpoint(eager=True))).checkpoint(
        eager=True)
    train = M.with_weights(data.filter("split <> 'test'")).checkpoint(eager=True)
    model = M.fit(train.drop("weight"))
    table = MT.coefficient_table(spark, model).checkpoint(eager=True)
    worst = MT.gradients(train, table, M.TARGET).groupBy("class").agg(F.max(F.abs("gradient")).alias("worst"))
    test = MT.score_with_table(data.filter("split = 'test'"), table)
    metrics = M.metric_bundle(M.pair_counts(test, M.TARGET, "model_risk_group"))
    good = metrics.select((F.col("accuracy") >= LEAST_ACCURACY) & (F.col("recall") >= LEAST_RECALL)).scalar()
    old = model.transform(data).select("seq", "Patient_ID", F.col("model_risk_group").alias("old_group"),
                                       F.col("risk_probabilities").alias("old"))
    new = MT.score_with_table(data, table).select("seq", "Patient_ID", "model_risk_group", "risk_probabilities")
    labels = [F.abs(F.col("old")[c] - F.col("risk_probabilities")[c]) > 1.5e-4 for c in model.labels]
    differ = F.col("old_group") != F.col("model_risk_group")
    for x in labels:
        differ = differ | x
    same = old.join(new, ["seq", "Patient_ID"]).agg((F.count("*") > 0) & (F.count_if(differ) == 0)).scalar()
    sizes = train.groupBy(F.col(M.TARGET).alias("label")).agg(F.count("*").alias("n"), F.round(F.first("weight"), 4)
                                                              .alias("weight"))
    return sizes.join(worst, F.col("label") == F.col("class")).select(
        "label", "n", "weight", (F.col("worst") <= MOST_GRADIENT).alias("at_minimum"), good.alias("meets_reference"),
        same.alias("table_equals_pipeline"))


def registry_model():
    return {
        "stratified_split_counts": q_stratified_split_counts,
        "class_weights": q_class_weights,
        "confusion_matrix": q_confusion_matrix,
        "metric_bundle": q_metric_bundle,
        "classification_report": q_classification_report,
        "derived_label_distribution": q_derived_label_distribution,
        "linear_scoring": q_linear_scoring,
        "model_certificate": q_model_certificate,
        "model_evaluation": q_model_evaluation,
        "model_scoring": q_model_scoring,
    }
