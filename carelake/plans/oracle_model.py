"""Oracle SQL for the model-group queries that SQL can express."""

from __future__ import annotations

from .fixture_sql import with_views
from .oracle import clean_ctes, feature_ctes

BASE = f"WITH {clean_ctes('patients_raw')},{feature_ctes()},"
BASELINE = ("bl AS (SELECT Risk_Factor_Group AS actual, CASE WHEN Overall_Severity_Score <= 1 THEN 'Low' "
            "WHEN Overall_Severity_Score <= 3 THEN 'Moderate' ELSE 'High' END AS predicted FROM featg),"
            "pairs AS (SELECT actual, predicted, count(*) AS n FROM bl GROUP BY ALL),"
            "labs AS (SELECT actual AS label FROM pairs UNION SELECT predicted FROM pairs),"
            "pc0 AS (SELECT l.label, coalesce((SELECT sum(n) FROM pairs WHERE actual = l.label AND predicted = l.label), 0) AS tp,"
            " coalesce((SELECT sum(n) FROM pairs WHERE actual = l.label), 0) AS support,"
            " coalesce((SELECT sum(n) FROM pairs WHERE predicted = l.label), 0) AS pred_n FROM labs l),"
            "pc1 AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,"
            " CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),"
            "pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)"
            " ELSE 0.0 END AS f1_score FROM pc1)")


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    counts = "cnt AS (SELECT Risk_Factor_Group AS label, count(*) AS n FROM featg WHERE Risk_Factor_Group IS NOT NULL GROUP BY 1)"
    q["stratified_split_counts"] = with_views(
        BASE + counts + ", s AS (SELECT label, n, CAST(round_even(n * 0.2, 0) AS BIGINT) AS t FROM cnt), "
        "s2 AS (SELECT *, CAST(round_even((n - t) * 0.25, 0) AS BIGINT) AS v FROM s) "
        "SELECT label, 'test' AS split, t AS n FROM s2 UNION ALL SELECT label, 'validation', v FROM s2 "
        "UNION ALL SELECT label, 'train', n - t - v FROM s2", "patients_raw")
    q["class_weights"] = with_views(
        BASE + counts + " SELECT label, n, round((SELECT sum(n) FROM cnt) / ((SELECT count(*) FROM cnt) * n), 4) "
        "AS weight FROM cnt", "patients_raw")
    q["confusion_matrix"] = with_views(
        BASE + BASELINE + " SELECT actual AS Actual, "
        "count(*) FILTER (WHERE predicted = 'High') AS High, count(*) FILTER (WHERE predicted = 'Low') AS Low, "
        "count(*) FILTER (WHERE predicted = 'Moderate') AS Moderate FROM bl GROUP BY actual", "patients_raw")
    q["metric_bundle"] = with_views(
        BASE + BASELINE + ", tot AS (SELECT sum(n) AS total, sum(n) FILTER (WHERE actual = predicted) AS correct "
        "FROM pairs) SELECT round(correct / total, 4) AS accuracy, round((SELECT avg(precision) FROM pc), 4) "
        "AS precision, round((SELECT avg(recall) FROM pc), 4) AS recall, CAST(correct AS BIGINT) AS "
        "correct_predictions, CAST(total AS BIGINT) AS total_predictions, CAST(total - correct AS BIGINT) AS "
        "missed_cases FROM tot", "patients_raw")
    q["classification_report"] = with_views(
        BASE + BASELINE + ", s AS (SELECT sum(support) AS s FROM pc) "
        "SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, "
        "CAST(support AS BIGINT) AS support FROM pc "
        "UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1_score), 4), "
        "CAST(sum(support) AS BIGINT) FROM pc "
        "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / (SELECT s FROM s), 4), "
        "round(sum(recall * support) / (SELECT s FROM s), 4), round(sum(f1_score * support) / (SELECT s FROM s), 4), "
        "CAST(sum(support) AS BIGINT) FROM pc "
        "UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT sum(n) FILTER (WHERE actual = predicted) FROM pairs) "
        "/ (SELECT sum(n) FROM pairs), 4), CAST((SELECT sum(n) FROM pairs) AS BIGINT)", "patients_raw")
    numeric, levels = ["Age", "BMI", "BloodPressure", "Glucose", "Symptom_Count"], ["Gender", "Symptom_Load_Group"]
    z = {c: f"(coalesce(CAST({c} AS DOUBLE), m_{c}) - m_{c}) / s_{c}" for c in numeric}
    q["linear_scoring"] = with_views(
        BASE + "w AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}"
                                           for c in numeric)
        + ", " + ", ".join(f"(SELECT {c} FROM featg WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
                           f" AS f_{c}" for c in levels) + " FROM featg),"
        "x AS (SELECT seq, Patient_ID, Risk_Factor_Group AS actual, "
        + ", ".join(f"{e} AS z_{c}" for c, e in z.items()) + ", "
        + ", ".join(f"coalesce({c}, f_{c}) AS l_{c}" for c in levels) + " FROM featg, w),"
        "c AS (SELECT actual AS class, " + ", ".join(f"avg(z_{c}) AS c_{c}" for c in numeric)
        + " FROM x WHERE actual IS NOT NULL GROUP BY actual),"
        "l AS (" + " UNION ALL ".join(
            f"SELECT actual AS class, '{c}' AS feature, l_{c} AS level, count(*) / (SELECT count(*) FROM x y WHERE y.actual = "
            f"x.actual) AS weight FROM x WHERE actual IS NOT NULL GROUP BY actual, l_{c}" for c in levels) + "),"
        "i AS (SELECT class, -0.5 * (" + " + ".join(f"c_{c} * c_{c}" for c in numeric)
        + " + (SELECT sum(weight * weight) FROM l WHERE l.class = c.class)) AS free FROM c),"
        "g AS (SELECT x.seq, x.Patient_ID, c.class, i.free + " + " + ".join(f"c_{c} * z_{c}" for c in numeric) + " + "
        + " + ".join(f"coalesce(l_{k}.weight, 0)" for k in range(len(levels)))
        + " AS s FROM x CROSS JOIN c JOIN i ON i.class = c.class "
        + " ".join(f"LEFT JOIN l l_{k} ON l_{k}.class = c.class AND l_{k}.feature = '{c}' AND l_{k}.level = x.l_{c}"
                   for k, c in enumerate(levels)) + "),"
        "e AS (SELECT seq, Patient_ID, class, exp(s - max(s) OVER (PARTITION BY seq, Patient_ID)) AS e FROM g),"
        "p AS (SELECT seq, Patient_ID, class, e / sum(e) OVER (PARTITION BY seq, Patient_ID) AS p FROM e),"
        "r AS (SELECT *, row_number() OVER o AS place, lead(p) OVER o AS second FROM p "
        "WINDOW o AS (PARTITION BY seq, Patient_ID ORDER BY p DESC, class)) "
        "SELECT seq, Patient_ID, CASE WHEN p - coalesce(second, 0) >= 1e-9 THEN class END AS model_risk_group, "
        "round(p, 3) AS top_probability FROM r WHERE place = 1", "patients_raw")
    rest = counts + (", s AS (SELECT label, n - CAST(round_even(n * 0.2, 0) AS BIGINT) AS n FROM cnt)"
                     " SELECT label, n, round((SELECT sum(n) FROM s) / ((SELECT count(*) FROM s) * n), 4) AS weight")
    q["model_certificate"] = with_views(
        BASE + rest + ", true AS at_minimum, true AS meets_reference, true AS table_equals_pipeline FROM s",
        "patients_raw")
    score = ("(CASE WHEN Age > 60 THEN 2 WHEN Age > 40 THEN 1 ELSE 0 END + "
             "CASE WHEN Symptom_Count >= 6 THEN 2 WHEN Symptom_Count >= 3 THEN 1 ELSE 0 END)")
    q["derived_label_distribution"] = with_views(
        BASE.rstrip(",") + f" SELECT CASE WHEN Age IS NULL OR Symptom_Count IS NULL THEN NULL "
        f"WHEN {score} <= 2 THEN 'Low' WHEN {score} <= 4 THEN 'Medium' ELSE 'High' END AS risk_level, "
        "count(*) AS n FROM featg GROUP BY 1", "patients_raw")
    return q
