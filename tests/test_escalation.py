"""Escalation engine cases (default policy profile)."""

from pyspark.sql import functions as F

from supportlake.operators.policy import DEFAULT_POLICY, escalation_decision


def decide(spark, message, intent, conf, sims):
    df = spark.createDataFrame([(message, intent, conf, sims)], "m string, i string, c double, s array<double>")
    return df.select(escalation_decision(F.col("m"), F.col("i"), F.col("c"), F.col("s"), DEFAULT_POLICY).alias("d")).first()["d"]


def test_threat_keyword(spark):
    d = decide(spark, "This is fraud! I am contacting my lawyer and will sue you in court.", "ORDER_TRACKING_AND_DELIVERY", 0.95, [0.85])
    assert d["action"] == "ESCALATE"
    assert "(keyword: 'sue')" in d["reason"]  # first keyword in list order


def test_sensitive_intent(spark):
    d = decide(spark, "Please help me reset my account 2FA password.", "ACCOUNT_ACCESS_AND_SECURITY", 0.92, [0.80])
    assert d["action"] == "ESCALATE" and "ACCOUNT_ACCESS_AND_SECURITY" in d["reason"]


def test_low_confidence(spark):
    d = decide(spark, "maybe order item thing", "ORDER_TRACKING_AND_DELIVERY", 0.42, [0.75])
    assert d["action"] == "ESCALATE"
    assert "confidence (0.42) is below operational threshold (0.65)" in d["reason"]


def test_weak_evidence_and_empty_evidence(spark):
    d = decide(spark, "Where can I check the estimated delivery date?", "ORDER_TRACKING_AND_DELIVERY", 0.92, [])
    assert d["action"] == "ESCALATE" and "top similarity: 0.00 < 0.55" in d["reason"]


def test_safe_auto_handle(spark):
    d = decide(spark, "Where can I check the estimated delivery date for my order?", "ORDER_TRACKING_AND_DELIVERY", 0.92, [0.84])
    assert d["action"] == "AUTO_HANDLE"
    assert "safe for automated self-service" in d["reason"]
    assert "(0.92)" in d["reason"] and "(similarity: 0.84)" in d["reason"]


def test_lost_parcel_only_for_delivery_intent(spark):
    d = decide(spark, "the tracking says delivered but nothing came", "ORDER_TRACKING_AND_DELIVERY", 0.9, [0.9])
    assert d["action"] == "ESCALATE"
    d = decide(spark, "the tracking says delivered but nothing came", "PRODUCT_AVAILABILITY_AND_PRICING", 0.9, [0.9])
    assert d["action"] == "AUTO_HANDLE"
