"""Published numbers recomputed from published counts, and the JSON outputs."""

import json

import pytest
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.operators import agreement, judge, metrics

# 30 responses rated twice: dimension, first rater, rubric, rows
RATED = [
    ("average_score", 3.7, 4.46, 1), ("average_score", 3.7, 4.7, 1), ("average_score", 3.9, 4.76, 5),
    ("average_score", 3.9, 4.8, 3), ("average_score", 4.5, 4.46, 7), ("average_score", 4.5, 4.7, 4),
    ("average_score", 4.8, 4.76, 6), ("average_score", 4.8, 4.8, 3),
    ("brand_consistency", 4.5, 4.8, 19), ("brand_consistency", 4.5, 5.0, 11),
    ("correctness", 2.5, 4.5, 10), ("correctness", 5.0, 4.5, 20),
    ("groundedness", 4.0, 4.0, 8), ("groundedness", 4.0, 4.5, 5), ("groundedness", 5.0, 5.0, 17),
    ("helpfulness", 2.5, 4.0, 1), ("helpfulness", 2.5, 4.5, 9), ("helpfulness", 4.0, 4.0, 7),
    ("helpfulness", 4.0, 4.5, 4), ("helpfulness", 4.5, 4.5, 9), ("safety", 5.0, 5.0, 30),
]
# r, p, rho, p, kappa, mean absolute error, disagreement rate
PUBLISHED = {
    "average_score": ("-0.033", 0.863612, "0.140", 0.461697, "-0.263", 0.336, 0.033),
    "correctness": ("N/A", None, "N/A", None, "0.000", 1.0, 0.333),
    "groundedness": ("0.928", None, "0.963", None, "0.645", 0.083, 0.0),
    "helpfulness": ("-0.117", None, "0.060", None, "0.316", 0.717, 0.333),
    "brand_consistency": ("N/A", None, "N/A", None, "1.000*", 0.373, 0.0),
    "safety": ("1.000*", None, "1.000*", None, "1.000*", 0.0, 0.0),
}
# rows: true intent, columns: predicted, both in taxonomy order
MATRIX = [
    [17, 0, 3, 0, 0, 0, 0, 0, 0, 0],
    [1, 17, 1, 0, 0, 0, 0, 0, 0, 1],
    [1, 0, 19, 0, 0, 0, 0, 0, 0, 0],
    [2, 2, 0, 14, 0, 0, 1, 0, 0, 1],
    [3, 0, 1, 0, 16, 0, 0, 0, 0, 0],
    [1, 0, 0, 0, 1, 15, 0, 0, 1, 2],
    [0, 0, 1, 0, 1, 0, 18, 0, 0, 0],
    [1, 0, 0, 0, 0, 0, 1, 18, 0, 0],
    [6, 1, 0, 0, 0, 0, 2, 0, 11, 0],
    [4, 0, 3, 0, 1, 0, 3, 0, 0, 9],
]
PERCENT = [(47.2, 85.0, 60.7), (85.0, 85.0, 85.0), (67.9, 95.0, 79.2), (100.0, 70.0, 82.4), (84.2, 80.0, 82.1),
           (100.0, 75.0, 85.7), (72.0, 90.0, 80.0), (100.0, 90.0, 94.7), (91.7, 55.0, 68.8), (69.2, 45.0, 54.5)]


def test_thirty_rated_responses(spark):
    long = spark.createDataFrame([r[:3] for r in RATED for _ in range(r[3])], "dimension string, h double, l double")
    got = {r["dimension"]: r for r in agreement.agreement(long).collect()}
    for dim, (r, p, rho, rp, kappa, mae, far) in PUBLISHED.items():
        g = got[dim]
        assert (g["sample_size"], g["pearson_r"], g["spearman_rho"], g["cohens_kappa"]) == (30, r, rho, kappa)
        assert (round(g["mean_absolute_error"], 3), round(g["disagreement_rate"], 3)) == (mae, far)
        if p is not None:
            assert (g["pearson_p_value"], g["spearman_p_value"]) == pytest.approx((p, rp), abs=1e-6)


@pytest.fixture(scope="module")
def predicted(spark):
    rows = [("agent", fixed.INTENTS[i], fixed.INTENTS[j], "ESCALATE", "ESCALATE" if i == j else "AUTO_HANDLE")
            for i, line in enumerate(MATRIX) for j, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "system string, true_intent string, pred_intent string, true_action string, pred_action string")


def test_ten_by_ten_matrix(predicted):
    counts = metrics.pair_counts(predicted, "true_intent", "pred_intent")
    s = metrics.intent_summary(counts).first()
    assert (s["accuracy"], round(s["macro_f1"], 3), s["n"]) == (0.77, 0.773, 200)
    rep = {r["label"]: r for r in metrics.report_with_averages(counts, fixed.INTENTS).collect()}
    assert [tuple(round(100 * rep[i][m], 1) for m in ("precision", "recall", "f1")) for i in fixed.INTENTS] == PERCENT
    assert rep["accuracy"]["f1"] == 0.77
    wide = {r["true_label"]: [r[i] for i in fixed.INTENTS] for r in metrics.confusion_matrix(counts, fixed.INTENTS).collect()}
    assert [wide[i] for i in fixed.INTENTS] == MATRIX


def test_summary_json(predicted):
    d = json.loads(metrics.summary_json(predicted, fixed.INTENTS).first()["summary"])
    agent = d["systems"]["agent"]
    assert (d["dataset_size"], d["num_intents"], agent["intent"]["accuracy"], agent["escalation"]["fn"]) == (200, 10, 0.77, 46)
    report = agent["intent"]["classification_report"]
    assert set(report) == {*fixed.INTENTS, "macro avg", "weighted avg", "accuracy"} and report["accuracy"] == 0.77
    assert report[fixed.INTENTS[0]]["f1-score"] == 0.607143


def test_rejected_answers_go_to_a_side_table_and_the_rubric_stands_in(spark):
    good = '{"correctness": 5, "groundedness": "4", "helpfulness": 4, "brand_consistency": 5, "safety": 5}'
    rows = [(0, good), (1, good.replace('"4"', "0.5").replace("5}", "9}")), (2, good.replace('"4"', '"high"')),
            (3, '{"safety": 5}'), (4, "no json"), (5, "[1]"), (6, ""), (7, None)]
    df = spark.createDataFrame(rows, "i int, raw string")
    scored = judge.scored_answers(df, "raw", judge.rubric(F.lit("AUTO_HANDLE"), F.lit("hello"), F.lit("")))
    got = {r["i"]: r for r in scored.collect()}
    assert got[0]["score_source"] == "judge" and got[0]["score"]["average_score"] == 4.6
    assert all(got[i]["score_source"] == "rubric" and got[i]["score"]["safety"] == 5.0 for i in range(1, 8))
    why = {r["i"]: r["reject_reason"] for r in judge.rejected_answers(scored).collect()}
    assert why == {1: "out of range: groundedness, safety", 2: "not a number: groundedness",
                   3: "not a number: correctness, groundedness, helpfulness, brand_consistency",
                   **{i: "not a JSON object" for i in (4, 5, 6, 7)}}
