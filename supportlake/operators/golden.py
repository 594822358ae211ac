"""Evaluation sets: stratified golden set, seeded samples, annotation template.

Corpus order is made explicit (reply id), because a DataFrame has no file
order.  All limits here are the feature itself (a quota per intent, a sample
of N rows); each is planned as a partial top-k, never as a full sort or a
whole group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.operators.labels import weak_labels
from supportlake.operators.pairs import without_ids

ORDER_KEY = "brand_tweet_id"


def seeded_key(id_col: str, seed: int = fixed.SAMPLE_SEED) -> Column:
    """Deterministic pseudo-random order key, identical in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_sample(df: DataFrame, n: int, id_col: str = ORDER_KEY, seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    """Exactly min(n, rows) rows chosen by a seeded hash order.

    Planned as TakeOrderedAndProject: each task keeps its n best rows, so the
    driver merges n x tasks rows at most.
    """
    return df.withColumn("_sample_key", seeded_key(id_col, seed)).orderBy("_sample_key", id_col).limit(n).drop("_sample_key")


def seq_id(prefix: Column | str, rn: Column, width: int = 3) -> Column:
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.lpad(rn.cast("string"), width, "0"))


def golden_set(pairs: DataFrame, per_intent: int = fixed.GOLDEN_PER_INTENT) -> DataFrame:
    """Stratified golden set: first ``per_intent`` confident messages per intent.

    A customer message counts once (its first reply by id); because the label
    depends only on the message text, dropping later repeats first gives the
    same set as the one-by-one scan.
    """
    cand = pairs.where(tx.word_count("customer_text") >= fixed.GOLDEN_MIN_WORDS)
    # first occurrence per customer message: a partial/final min aggregate, so a
    # message with very many replies is combined map-side, not in one task
    first = cand.groupBy("customer_tweet_id").agg(
        F.min(F.struct(F.col(ORDER_KEY), F.col("customer_text"), F.col("brand_text"), F.col("links"))).alias("f"))
    first = first.select("customer_tweet_id", "f.*")
    labelled = weak_labels(first)
    w = Window.partitionBy("weak_intent").orderBy(ORDER_KEY)
    top = labelled.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_intent)
    return top.select(
        seq_id(F.concat(F.lit("eval_"), F.lower(F.substring("weak_intent", 1, 3)), F.lit("_")), F.col("_rn")).alias("eval_id"),
        "customer_tweet_id",
        F.col(ORDER_KEY).alias("brand_tweet_id"),
        "customer_text",
        F.col("brand_text").alias("reference_reply"),
        tx.links_to_string("links").alias("reference_links"),
        F.col("weak_intent").alias("true_intent"),
        "true_action",
        "ground_truth_reason",
        F.lit(fixed.GOLDEN_ANNOTATOR).alias("annotator_id"),
        F.lit(fixed.GOLDEN_STATUS).alias("annotation_status"),
    )


def golden_check(golden: DataFrame, intents: DataFrame, per_intent: int = fixed.GOLDEN_PER_INTENT) -> DataFrame:
    """Quality check: rows per intent against the quota (every intent listed)."""
    counts = golden.groupBy(F.col("true_intent").alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    spine = intents.select(F.col("name").alias("intent"))
    return spine.join(counts, "intent", "left").select(
        "intent", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == per_intent).alias("ok"))


def annotation_template(pairs: DataFrame, golden: DataFrame, n: int = fixed.ANNOTATION_SAMPLE_SIZE) -> DataFrame:
    """Seeded sample of non-golden pairs with pending annotation columns."""
    pool = without_ids(pairs, golden, "customer_tweet_id")
    sample = pool.withColumn("_k", seeded_key(ORDER_KEY)).orderBy("_k", ORDER_KEY).limit(n)
    w = Window.orderBy("_k", ORDER_KEY)  # n rows at most: a single small partition
    return sample.select(
        seq_id("human_task_", F.row_number().over(w)).alias("task_id"),
        "customer_tweet_id",
        "customer_text",
        F.col("brand_text").alias("historical_brand_reply"),
        F.lit(fixed.PENDING).alias("assigned_intent"),
        F.lit(fixed.PENDING).alias("assigned_action"),
        F.lit(fixed.PENDING).alias("escalation_reason"),
        F.lit(fixed.PENDING_ANNOTATOR).alias("annotator_id"),
        F.lit(fixed.PENDING).alias("annotation_status"),
    )
