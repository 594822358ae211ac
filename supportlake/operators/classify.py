"""Classifiers: class histogram, majority baseline, prototype (nearest anchor)
classifier, TF-IDF features and logistic-regression heads.

Fits are Spark aggregations or Spark ML estimators; predictions are joins
with small, size-bounded model tables or ML transforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake import fixed


def class_histogram(df: DataFrame, label_col: str) -> DataFrame:
    """intent, n, share; the share window runs over the (#classes-row) aggregate."""
    c = df.groupBy(F.col(label_col).alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("intent", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit(1))


def fit_majority(df: DataFrame, intent_col: str, action_col: str | None = None,
                 order_col: str | None = None) -> DataFrame:
    """One-row model: majority intent, its share, majority action.

    Ties go to the value seen first in ``order_col`` order; without actions the
    majority action is AUTO_HANDLE.
    """
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()

    def best(col: str) -> DataFrame:
        c = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
        return c.agg(
            F.max_by("v", F.struct(F.col("n"), -F.col("first_seen"))).alias("best"),
            F.max_by("n", F.struct(F.col("n"), -F.col("first_seen"))).alias("best_n"),
            F.sum("n").alias("total"),
        )

    bi = best(intent_col).select(F.col("best").alias("majority_intent"),
                                 (F.col("best_n") / F.col("total")).alias("intent_share"))
    if action_col is None:
        return bi.withColumn("majority_action", F.lit(fixed.AUTO_HANDLE))
    ba = best(action_col).select(F.coalesce(F.col("best"), F.lit(fixed.AUTO_HANDLE)).alias("majority_action"))
    # both sides are single aggregate rows: a constant-key equi-join
    return _one(bi).join(_one(ba), "_one").drop("_one")


def predict_majority(df: DataFrame, model: DataFrame) -> DataFrame:
    """Attach the one-row majority model to every row (broadcast, 1 row)."""
    m = F.broadcast(_one(model).select("_one", F.col("majority_intent").alias("pred_intent"),
                                       F.col("intent_share").alias("pred_confidence"),
                                       F.col("majority_action").alias("pred_action")))
    return _one(df).join(m, "_one").drop("_one")


def confidence_from_cosine(sim: Column) -> Column:
    """Cosine in [-1, 1] -> confidence in [0, 1], rounded to 4."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sim + 1.0) / 2.0)), 4)
