"""Taxonomy as data: a small DataFrame (broadcast where joined) and helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake import fixed

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("intent_ord", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType()), False),
    T.StructField("exemplars", T.ArrayType(T.StringType()), False),
    T.StructField("auto_handle_eligible", T.BooleanType(), False),
    T.StructField("escalation_triggers", T.ArrayType(T.StringType()), False),
    T.StructField("default_policy", T.StringType(), False),
])


def keywords_by_intent() -> dict[str, list[str]]:
    return {row[0]: list(row[2]) for row in fixed.TAXONOMY}


def keyword_vocabulary() -> list[str]:
    """Distinct taxonomy keywords in first-seen order (the keyword encoder's axes)."""
    seen: dict[str, None] = {}
    for row in fixed.TAXONOMY:
        for kw in row[2]:
            seen.setdefault(kw, None)
    return list(seen)


def prototype_texts() -> list[tuple[int, str, str]]:
    """(proto_ord, intent, text): three exemplars then the description, per intent."""
    out = []
    for name, description, _kw, exemplars, *_ in fixed.TAXONOMY:
        for t in list(exemplars) + [description]:
            out.append((len(out), name, t))
    return out


def taxonomy_df(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(fixed.TAXONOMY)]
    return spark.createDataFrame(rows, TAXONOMY_SCHEMA)


def list_intents(spark: SparkSession) -> DataFrame:
    """name, description, keywords, eligibility (the intents listing)."""
    return taxonomy_df(spark).select("intent_ord", "name", "description", "keywords", "auto_handle_eligible")


def describe_intent(df: DataFrame, intent_col: str = "intent") -> DataFrame:
    """Left join to the (10-row, broadcast) taxonomy; unknown intents get ''."""
    tax = F.broadcast(taxonomy_df(df.sparkSession).select(
        F.col("name").alias("_tax_name"), F.col("description").alias("_tax_description")))
    return df.join(tax, df[intent_col] == tax["_tax_name"], "left").withColumn(
        "intent_description", F.coalesce(F.col("_tax_description"), F.lit(""))).drop("_tax_name", "_tax_description")
