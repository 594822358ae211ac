"""Brand comparison: volume, English share, DM deflection, link rate, lengths.

One left join (reply -> parent) and ONE hash aggregation for all brands:
a reply without a parent row still counts as a sampled reply, so the reply
count and the pair count come out of the same pass.  The aggregate is
partial/final, so only one row per brand and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import prefix
from supportlake.operators.pairs import brand_replies


def brand_profile(tweets: DataFrame, brands: Sequence[str] | None = None, first_rows: int | None = None) -> DataFrame:
    """Per-brand profile, sorted by English pairs (then brand).

    ``first_rows`` restricts the analysis to the first N tweets by id (the
    prefix-sample mode); by default the whole table is profiled.
    """
    if first_rows is not None:
        tweets = prefix.first_rows(tweets, first_rows, "tweet_id")
    replies = brand_replies(tweets)
    if brands is not None:
        replies = replies.where(F.col("author_id").isin(list(brands)))
    replies = replies.select(
        F.col("author_id").alias("brand"),
        F.col("text").alias("text_brand"),
        F.col("in_response_to_tweet_id").alias("parent_id"),
    )
    parents = tweets.select(F.col("tweet_id").alias("parent_tweet_id"), F.col("text").alias("text_cust"))
    j = replies.join(parents, replies.parent_id == parents.parent_tweet_id, "left")
    paired = F.col("parent_tweet_id").isNotNull()
    eng = paired & tx.is_english("text_brand") & tx.is_english("text_cust")
    agg = j.groupBy("brand").agg(
        F.count(F.lit(1)).alias("sample_replies"),
        F.count_if(paired).alias("paired_conversations"),
        F.count_if(eng).alias("english_pairs"),
        F.count_if(eng & tx.dm_flag("text_brand")).alias("_dm"),
        F.count_if(eng & tx.link_flag("text_brand")).alias("_link"),
        F.sum(F.when(eng, F.length("text_cust"))).alias("_cust_len"),
        F.sum(F.when(eng, F.length("text_brand"))).alias("_brand_len"),
    ).where(F.col("paired_conversations") > 0)

    def share(num: str) -> F.Column:
        return F.when(F.col("english_pairs") > 0, F.col(num) / F.col("english_pairs")).otherwise(F.lit(0.0))

    return agg.select(
        "brand",
        "sample_replies",
        "paired_conversations",
        "english_pairs",
        F.round(F.col("english_pairs") / F.greatest(F.col("paired_conversations"), F.lit(1)) * 100, 1).alias("english_pct"),
        F.round(share("_dm") * 100, 1).alias("dm_redirect_pct"),
        F.round(share("_link") * 100, 1).alias("link_pct"),
        F.round(share("_cust_len"), 1).alias("avg_cust_length"),
        F.round(share("_brand_len"), 1).alias("avg_brand_length"),
    ).orderBy(F.desc("english_pairs"), "brand")
