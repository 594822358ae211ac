"""One-pass keyword counting equals per-keyword whole-word regex counts."""

import random
import re

from pyspark.sql import functions as F

from supportlake.functions.encoders import with_keyword_counts
from supportlake.operators.labels import ground_truth_action, with_weak_label
from supportlake.taxonomy import keyword_vocabulary


def reference_counts(text):
    low = text.lower()
    return [len(re.findall(r"\b" + re.escape(k) + r"\b", low)) for k in keyword_vocabulary()]


def test_counts_match_per_keyword_regex(spark):
    vocab = keyword_vocabulary()
    words = vocab + ["a", "the", "Cancelled", "returns", "prime-video", "ORDER", "video", "issue", ",", "!"]
    rnd = random.Random(7)
    texts = []
    for _ in range(300):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 10)))
        if rnd.random() < 0.3:
            t = t.replace(" ", rnd.choice(["", ",", "  ", "-"]), 1)
        texts.append((len(texts), t))
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: list(r["_kc"]) for r in with_keyword_counts(df, "text").collect()}
    for i, t in texts:
        assert got[i] == reference_counts(t), t


def test_weak_label_first_intent_wins_ties(spark):
    # "late" (delivery) and "refund" (billing) both score 2.0: taxonomy order wins
    df = spark.createDataFrame([(1, "it is late and I want a refund"), (2, "nothing to see")], "id long, customer_text string")
    rows = {r["id"]: (r["weak_intent"], r["weak_score"]) for r in with_weak_label(df).collect()}
    assert rows[1] == ("ORDER_TRACKING_AND_DELIVERY", 2.0)
    assert rows[2] == (None, 0.0)


def test_ground_truth_threat_is_substring(spark):
    df = spark.createDataFrame([("My kindle has an issue", "DIGITAL_SERVICES_AND_DEVICES")], "t string, i string")
    r = df.select(ground_truth_action(F.col("i"), F.col("t")).alias("g")).first()["g"]
    assert r["action"] == "ESCALATE"  # "sue" inside "issue"
