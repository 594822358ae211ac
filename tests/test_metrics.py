"""Metrics, rubric and agreement, including replays of published numbers."""

from pyspark.sql import functions as F

from supportlake.operators import agreement, judge, metrics


def test_accuracy_and_confusion(spark):
    df = spark.createDataFrame(list(zip(["A", "B", "A", "B"], ["A", "B", "B", "B"])), "t string, p string")
    c = metrics.pair_counts(df, "t", "p")
    s = metrics.intent_summary(c).first()
    assert s["accuracy"] == 0.75
    cm = {(r["true_label"], r["pred_label"]): r["n"] for r in metrics.confusion_long(c, ["A", "B"]).collect()}
    assert cm == {("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 0, ("B", "B"): 2}
    rep = {r["label"]: r for r in metrics.report_with_averages(c, ["A", "B"]).collect()}
    assert rep["A"]["precision"] == 1.0 and rep["A"]["recall"] == 0.5
    assert abs(rep["B"]["precision"] - 2 / 3) < 1e-6


def test_escalation_false_auto_handle(spark):
    df = spark.createDataFrame(list(zip(["ESCALATE", "ESCALATE", "AUTO_HANDLE", "AUTO_HANDLE"],
                                        ["ESCALATE", "AUTO_HANDLE", "AUTO_HANDLE", "AUTO_HANDLE"])), "t string, p string")
    r = metrics.escalation_metrics(df, "t", "p").first()
    assert r["fn"] == 1 and r["false_auto_handle_rate"] == 0.5


def test_escalation_replay_published_counts(spark):
    rows = ([("ESCALATE", "ESCALATE")] * 93 + [("AUTO_HANDLE", "ESCALATE")] * 38
            + [("AUTO_HANDLE", "AUTO_HANDLE")] * 60 + [("ESCALATE", "AUTO_HANDLE")] * 9)
    r = metrics.escalation_metrics(spark.createDataFrame(rows, "t string, p string"), "t", "p").first()
    assert (r["accuracy"], r["escalate_precision"], r["escalate_recall"], r["escalate_f1"],
            r["false_auto_handle_rate"], r["false_escalation_rate"]) == (0.765, 0.7099, 0.9118, 0.7983, 0.0882, 0.3878)


def test_rubric_offline(spark):
    df = spark.createDataFrame([("AUTO_HANDLE", "You can track your package here: https://t.co/track", "https://t.co/track"),
                                ("ESCALATE", "Please send your password", ""),
                                ("AUTO_HANDLE", "x" * 300, "")], "a string, r string, e string")
    s = [r["s"] for r in df.select(judge.rubric(F.col("a"), F.col("r"), F.col("e")).alias("s")).collect()]
    assert s[0]["groundedness"] == 5.0 and s[0]["safety"] == 5.0 and s[0]["average_score"] == 4.76
    assert s[1]["safety"] == 1.0 and s[1]["brand_consistency"] == 3.5 and s[1]["correctness"] == 3.5
    assert s[2]["brand_consistency"] == 4.0 and s[2]["groundedness"] == 4.0
    assert all(1.0 <= x[d] <= 5.0 for x in s for d in ("correctness", "groundedness", "helpfulness"))


def test_agreement_small(spark):
    h = [4.5, 5.0, 3.0, 4.0, 5.0]
    l = [4.5, 4.5, 3.5, 4.0, 5.0]
    long = spark.createDataFrame([("composite", a, b) for a, b in zip(h, l)], "dimension string, h double, l double")
    m = agreement.agreement(long).first()
    assert m["sample_size"] == 5 and m["mean_absolute_error"] < 0.5 and m["disagreement_rate"] == 0.0


def test_agreement_constant_ratings(spark):
    long = spark.createDataFrame([("safety", 5.0, 5.0)] * 4, "dimension string, h double, l double")
    m = agreement.agreement(long).first()
    assert m["pearson_r"] == "1.000*" and m["cohens_kappa"] == "1.000*" and m["pearson_p_value"] == 0.0


def test_correlation_p_value(spark):
    # r = 0.5 with n = 10: t = 1.633, 8 d.f., two-sided p = 0.1411
    r = spark.createDataFrame([(0.5, 10), (1.0, 10)], "r double, n long")
    p = [x["p"] for x in r.select(agreement.corr_p_value(r["r"], r["n"]).alias("p")).collect()]
    assert abs(p[0] - 0.141) < 5e-4 and p[1] == 0.0


def test_parse_judge_json(spark):
    ok = '{"correctness": 5, "groundedness": 4, "helpfulness": 4, "brand_consistency": 5, "safety": 5, "reasoning": "fine"}'
    bad_range = '{"correctness": 7, "groundedness": 4, "helpfulness": 4, "brand_consistency": 5, "safety": 5}'
    df = spark.createDataFrame([(ok,), (bad_range,), ("not json",)], "raw string")
    got = [r["s"] for r in df.select(judge.parse_judge_json(F.col("raw")).alias("s")).collect()]
    assert got[0]["average_score"] == 4.6 and got[0]["reasoning"] == "fine"
    assert got[1] is None and got[2] is None
