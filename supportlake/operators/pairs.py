"""Conversation pairs: reply -> parent self-join, cleaning, English filter.

Plan shape: one scan of the tweet table feeds both join sides; the English
and length predicates that touch only one side are pushed below the join by
Catalyst, so only surviving rows are shuffled.  The join is a sort-merge
join on the parent id (AQE splits a parent with very many replies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.operators import prefix
from supportlake.session import cut_lineage


def brand_replies(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Outbound tweets that answer something (optionally of one brand)."""
    cond = (~F.col("inbound")) & F.col("in_response_to_tweet_id").isNotNull()
    if brand is not None:
        cond = cond & (F.col("author_id") == brand)
    return tweets.where(cond)


def conversation_pairs(tweets: DataFrame, brand: str | None = None, max_pairs: int | None = None) -> DataFrame:
    """Clean English message/reply pairs.

    ``max_pairs`` keeps the first pairs by reply id (an explicit order); by
    default every pair is kept.
    """
    # texts are made once (``materialize``), not once for every part of the test that reads them
    replies = tx.materialize(brand_replies(tweets, brand).select(
        F.col("tweet_id").alias("brand_tweet_id"),
        F.col("author_id").alias("brand"),
        F.col("text"),
        F.col("created_at").alias("created_at_brand"),
        F.col("in_response_to_tweet_id").alias("parent_id"),
    ), brand_text_raw=F.col("text")).drop("text").where(tx.is_english("brand_text_raw"))
    parents = tx.materialize(tweets.select(
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("text"),
        F.col("created_at").alias("created_at_customer"),
    ), customer_text_raw=F.col("text")).drop("text").where(tx.is_english("customer_text_raw"))
    joined = replies.join(parents, replies.parent_id == parents.customer_tweet_id, "inner")
    # only what was joined is cleaned, once for the length and the result
    cleaned = tx.materialize(joined, customer_text=tx.clean_text("customer_text_raw", False), brand_text=tx.clean_text("brand_text_raw", True))
    out = cleaned.where(
        (F.length("customer_text") >= fixed.MIN_CLEAN_LENGTH) & (F.length("brand_text") >= fixed.MIN_CLEAN_LENGTH)
    ).select(
        "customer_tweet_id",
        "brand_tweet_id",
        "customer_text_raw",
        "customer_text",
        "brand_text_raw",
        "brand_text",
        tx.extract_links("brand_text_raw").alias("links"),
        "brand",
        "created_at_customer",
        "created_at_brand",
    )
    if max_pairs is not None:
        # the keys of the pairs are written once, narrow; the cut on the reply id is pushed below the join
        keys = cut_lineage(out.select("brand_tweet_id"))
        out = prefix.first_rows(out, max_pairs, "brand_tweet_id", keys)
    return out


def answered_parents(tweets: DataFrame, brand: str | None = None) -> DataFrame:
    """Tweets some brand reply answers (semi-join reduction of the parent side)."""
    replies = brand_replies(tweets, brand).select(F.col("in_response_to_tweet_id").alias("parent_id"))
    return tweets.join(replies, tweets.tweet_id == replies.parent_id, "left_semi")


def without_ids(df: DataFrame, excluded: DataFrame, key: str = "customer_tweet_id") -> DataFrame:
    """Anti-join: drop rows whose ``key`` appears in ``excluded``."""
    ex = excluded.select(F.col(key).alias("_excluded_key")).distinct()
    return df.join(ex, df[key] == ex["_excluded_key"], "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail fast on an empty input (one cheap ``isEmpty`` probe)."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df
