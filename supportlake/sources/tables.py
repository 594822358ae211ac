"""Sources: the driver's parquet tables, raw tweet CSV imports, and the
derived tweet view used by the conversation operators.

Reads always go through ``spark.read`` with a fixed schema (never inferred)
so Catalyst can prune columns and push filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

RAW_TWEET_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.LongType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("inbound", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("response_tweet_id", T.StringType()),
    T.StructField("in_response_to_tweet_id", T.StringType()),
])

HUMAN_VALIDATION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("val_id",)]
    + [T.StructField("customer_tweet_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in (
        "customer_text", "true_intent", "true_action", "agent_intent", "agent_action", "agent_reply", "evidence")]
    + [T.StructField(f"human_{d}", T.DoubleType()) for d in (
        "correctness", "groundedness", "helpfulness", "brand_consistency", "safety", "average_score")]
    + [T.StructField("human_qa_notes", T.StringType())]
)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    A small input file (one parquet row group) is a single split, so every
    narrow operator after the scan would run in one task.  Only then is the
    scan round-robin repartitioned; a large table already has many more splits
    than cores and is returned unchanged (no extra shuffle at scale).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if balance else df


def read_raw_tweets_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw tweet export.  ``multi_line`` is for files whose quoted texts hold
    line breaks (each file is then one task).  The parent id arrives as a
    float-looking string (``1234.0``); it goes through DECIMAL to BIGINT, so
    no digit of a long id is lost."""
    df = (spark.read.schema(RAW_TWEET_SCHEMA).option("header", True).option("multiLine", multi_line)
          .option("escape", '"').csv(path))
    return df.select(
        "tweet_id", "author_id", "inbound", "created_at", "text",
        F.col("in_response_to_tweet_id").try_cast("decimal(38,6)").try_cast("bigint").alias("in_response_to_tweet_id"),
    )


def read_human_validation_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(HUMAN_VALIDATION_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


# --------------------------------------------------------------------------
# Derived tweet view (test fixture over ``events``; see FIXTURES.md §3).
# The driver's text tables contain none of the support vocabulary, so the
# conversation operators run on tweets derived deterministically from
# ``events``.  The same definition is written in SQL for the oracle.
# --------------------------------------------------------------------------

FIXTURE_BRANDS = ["BrandA", "BrandB", "BrandC", "BrandD", "BrandE"]

FIXTURE_CUSTOMER_TEXTS = [
    "Where is my package? It was supposed to arrive yesterday",
    "The tracking says delivered but the package is not here",
    "How do I return an item and get a return label for it",
    "The return was rejected and I want an exchange for the shoes",
    "I was charged twice and I want my money back, please refund me",
    "Is there a duplicate charge on my credit card from the bank",
    "The mug was broken and damaged when I got the box",
    "Please cancel order, I was too late and it is in transit",
    "I want to cancel my order before it is sent to me",
    "I am locked out and the password reset otp is not working",
    "What are the benefits of the prime membership for students",
    "I was charged without asking for the annual fee, this is a dispute",
    "My kindle and alexa can not connect, what is the issue",
    "The echo is dead and there is smoke, is it hardware",
    "When will the headphones be in stock and is there a promo code",
    "Can you price match this and honor the price match guarantee",
    "This is unacceptable &amp; I want a supervisor or a manager",
    "I will sue you, my lawyer is on it &#39;today&#39;",
    "Is the delivery late or is the tracking wrong and a refund due",
    "Someone has stolen the package from my porch, please help me",
    "Guten Tag wie kann ich Ihnen helfen",
    "thanks a lot",
    "ok &lt;3",
    "It is not what I would have on my list, can you do that for me",
]

FIXTURE_REPLY_TEXTS = [
    "We are sorry for the delay, you can see it all here: https://amzn.example/track. ^TN",
    "Please send us a DM with your number so we can help you /CH",
    "You can start the return in your account: https://help.example/returns?x=1 and https://help.example/faq -Sam",
    "Hello and thanks, our team is on it and we will update you *AB",
    "Please sign in and do this in the app to get it done, thanks for the sign-in",
    "Please do not post your password, send a direct message to us and we would help",
    "Vielen Dank, bitte schreiben Sie uns",
    "ok ^KH",
    "We are on it and a specialist is reviewing this for you ^KH https://amzn.example/case",
]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def tweet_view(events: DataFrame, keep_time: bool = False) -> DataFrame:
    """Raw-tweet schema derived row by row from ``events`` (narrow, no shuffle).

    ``keep_time`` adds the event time as ``event_time`` (streaming jobs)."""
    e = F.col("event_id")
    k = F.expr("event_id div 2")
    brand = _pick(FIXTURE_BRANDS, k % 5)
    even = (e % 2) == 0
    text = F.when(even, F.concat(F.lit("@"), brand, F.lit("  "), _pick(FIXTURE_CUSTOMER_TEXTS, k % 24))).otherwise(
        F.concat(F.lit("@"), F.col("user_id").cast("string"), F.lit(" "),
                 _pick(FIXTURE_REPLY_TEXTS, (k * 7 + F.expr("event_id div 2 div 24")) % 9)))
    parent = (F.when(even, F.lit(None).cast("bigint"))
              .when(k % 31 == 0, F.lit(None).cast("bigint"))
              .when(k % 97 == 0, F.lit(-1).cast("bigint"))
              .when(k % 40 == 39, e - 3)
              .otherwise(e - 1))
    extra = [F.col("ts").cast("timestamp").alias("event_time")] if keep_time else []
    return events.select(
        e.alias("tweet_id"),
        F.when(even, F.concat(F.lit("cust_"), F.col("user_id").cast("string"))).otherwise(brand).alias("author_id"),
        even.alias("inbound"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        text.alias("text"),
        parent.alias("in_response_to_tweet_id"),
        *extra,
    )


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tweet_view(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"))


def tweet_view_sql(events: str = "events") -> str:
    """The same derivation as DuckDB SQL (for the oracle)."""
    def arr(values):
        return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

    brand = f"({arr(FIXTURE_BRANDS)})[((event_id // 2) % 5) + 1]"
    cust = f"({arr(FIXTURE_CUSTOMER_TEXTS)})[((event_id // 2) % 24) + 1]"
    rep = f"({arr(FIXTURE_REPLY_TEXTS)})[(((event_id // 2) * 7 + (event_id // 2) // 24) % 9) + 1]"
    return f"""(SELECT
  event_id AS tweet_id,
  CASE WHEN event_id % 2 = 0 THEN 'cust_' || CAST(user_id AS VARCHAR) ELSE {brand} END AS author_id,
  (event_id % 2 = 0) AS inbound,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
  CASE WHEN event_id % 2 = 0 THEN '@' || {brand} || '  ' || {cust}
       ELSE '@' || CAST(user_id AS VARCHAR) || ' ' || {rep} END AS text,
  CAST(CASE WHEN event_id % 2 = 0 THEN NULL
       WHEN (event_id // 2) % 31 = 0 THEN NULL
       WHEN (event_id // 2) % 97 = 0 THEN -1
       WHEN (event_id // 2) % 40 = 39 THEN event_id - 3
       ELSE event_id - 1 END AS BIGINT) AS in_response_to_tweet_id,
  ts AS event_time
FROM {events})"""
