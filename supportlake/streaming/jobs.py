"""Structured Streaming jobs over the ``events`` stream.

Every job reads a file stream (parquet, fixed schema), derives tweets with
the same Columns as the batch code, and writes append-mode output with its
own checkpoint in the shared checkpoint folder; a job that is given its old
folder (``root``) resumes exactly where it stopped.

* J1 ``triage_stream``: stateless triage per micro-batch (``foreachBatch``)
  against a static history index.
* J2 ``escalation_windows``: tumbling-window counts of customer messages and
  of policy escalations per weak intent, watermark 10 minutes;
  ``sliding_windows``: the same in windows that overlap.
* J3 ``customer_sessions``: ``session_window`` (30 minutes gap) per author.
* J4 ``dedup_messages``: duplicate tweets dropped with a watermark.
* J5 ``reply_pairs``: stream-stream inner join of replies to their parent
  message within 24 hours, watermarks on both sides.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake import fixed
from supportlake.operators.labels import ground_truth_action, with_weak_label
from supportlake.session import cut_lineage, ensure_checkpoint_dir
from supportlake.sources.tables import tweet_view
from supportlake.functions import text as tx

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

WATERMARK = "10 minutes"
WINDOW = "1 hour"
SLIDE = "15 minutes"
SESSION_GAP = "30 minutes"
REPLY_WITHIN = "24 hours"


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Event rows as a stream; ``ts`` cast to TIMESTAMP (watermarks need it)."""
    # the stream source lists a folder; the glob filter keeps the events files
    src = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("pathGlobFilter", "events*.parquet").parquet(sf_dir))
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


def _tweets_with_time(events: DataFrame) -> DataFrame:
    """Tweets with their event time (same derivation as the batch view)."""
    return tweet_view(events, keep_time=True)


def _run(df: DataFrame, name: str, mode: str = "append", foreach=None, root: str | None = None) -> str:
    """Run to the end of the input; returns the output folder.  A job that is
    given the same ``root`` again resumes from its checkpoint there."""
    spark = df.sparkSession
    root = root or os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "checkpoint")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if foreach is not None:
        q = w.foreachBatch(lambda bdf, bid: foreach(bdf, bid, out)).start()
    else:
        q = w.format("parquet").option("path", out).start()
    q.awaitTermination()
    return out


def customer_messages(tweets: DataFrame) -> DataFrame:
    """Inbound messages with cleaned text, weak intent and policy action."""
    m = tweets.where(F.col("inbound")).select(
        "tweet_id", "author_id", "event_time", tx.clean_text("text").alias("message"))
    lab = with_weak_label(m, "message")
    intent = F.coalesce(F.col("weak_intent"), F.lit("UNLABELLED"))
    return lab.withColumn("intent", intent).withColumn(
        "action", ground_truth_action(F.col("weak_intent"), F.col("message")).getField("action"))


def escalation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2: per (1-hour window, intent): messages and escalations, closed windows."""
    msgs = customer_messages(_tweets_with_time(events_stream(spark, sf_dir)))
    agg = msgs.withWatermark("event_time", WATERMARK).groupBy(F.window("event_time", WINDOW), "intent").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("action") == fixed.ESCALATE).alias("n_escalations"))
    out = agg.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     F.date_format("window.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                     "intent", "n_messages", "n_escalations")
    return spark.read.parquet(_run(out, "escalation_windows"))


def sliding_windows(spark: SparkSession, sf_dir: str, slide: str = SLIDE) -> DataFrame:
    """J2, sliding: every message counts in each of the overlapping windows that
    hold it; state is kept per window and intent until the watermark passes its
    end, and rows behind the watermark count in none that has closed."""
    msgs = customer_messages(_tweets_with_time(events_stream(spark, sf_dir)))
    agg = msgs.withWatermark("event_time", WATERMARK).groupBy(F.window("event_time", WINDOW, slide), "intent").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("action") == fixed.ESCALATE).alias("n_escalations"))
    out = agg.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     F.date_format("window.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "intent", "n_messages", "n_escalations",
                     F.round(F.col("n_escalations") / F.col("n_messages"), 4).alias("escalation_rate"))
    return spark.read.parquet(_run(out, "sliding_windows"))


def customer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3: sessions per author (gap 30 minutes), closed sessions only."""
    ev = events_stream(spark, sf_dir)
    t = _tweets_with_time(ev).withWatermark("event_time", WATERMARK)
    s = t.groupBy(F.session_window("event_time", SESSION_GAP), "author_id").agg(F.count(F.lit(1)).alias("n_tweets"))
    out = s.select("author_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                   F.date_format("session_window.end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n_tweets")
    return spark.read.parquet(_run(out, "customer_sessions"))


def dedup_messages(spark: SparkSession, sf_dir: str, redelivered: str | None = None) -> DataFrame:
    """J4: each tweet id once; the watermark bounds the dedup state.  With
    ``redelivered`` (an interval) every event comes a second time, that much
    later, as from a source that delivers at least once."""
    ev = events_stream(spark, sf_dir)
    if redelivered is not None:
        ev = ev.unionByName(events_stream(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {redelivered}")))
    t = _tweets_with_time(ev).withWatermark("event_time", WATERMARK).dropDuplicatesWithinWatermark(["tweet_id"])
    out = t.select("tweet_id", "author_id", "inbound")
    return spark.read.parquet(_run(out, "dedup_messages"))


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5: replies joined to their parent message within 24 hours."""
    t1 = _tweets_with_time(events_stream(spark, sf_dir))
    t2 = _tweets_with_time(events_stream(spark, sf_dir))
    cust = t1.where(F.col("inbound")).select(F.col("tweet_id").alias("customer_tweet_id"),
                                             F.col("event_time").alias("customer_time")).withWatermark(
        "customer_time", WATERMARK)
    rep = t2.where(~F.col("inbound") & F.col("in_response_to_tweet_id").isNotNull()).select(
        F.col("tweet_id").alias("brand_tweet_id"), F.col("author_id").alias("brand"),
        F.col("in_response_to_tweet_id").alias("parent_id"), F.col("event_time").alias("reply_time")).withWatermark(
        "reply_time", WATERMARK)
    j = rep.join(cust, F.expr(f"""parent_id = customer_tweet_id AND reply_time >= customer_time
                                  AND reply_time <= customer_time + interval {REPLY_WITHIN}"""), "inner")
    out = j.select("customer_tweet_id", "brand_tweet_id", "brand")
    return spark.read.parquet(_run(out, "reply_pairs"))


def triage_stream(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """J1: triage every incoming customer message per micro-batch against the
    static history index (pairs of the batch table).  A message's own pairs, which
    a replayed history holds, are no evidence for it.  Index and prototypes are
    written once and read by every batch."""
    from supportlake.operators.pairs import conversation_pairs
    from supportlake.plans import triage as tr
    from supportlake.sources.tables import tweets

    history = tr.history_index(conversation_pairs(tweets(spark, sf_dir)))
    protos = cut_lineage(tr.prototype_index(spark))
    ev = events_stream(spark, sf_dir)
    msgs = _tweets_with_time(ev).where(F.col("inbound")).select(F.col("tweet_id").alias("id"),
                                                               F.col("text").alias("message"))

    def per_batch(bdf: DataFrame, batch_id: int, out: str) -> None:
        # the micro-batch is replayable from the source offsets: persist it
        # for the three triage stages instead of writing it out
        bdf = bdf.persist()
        try:
            res = tr.triage(bdf, history, protos, write_inputs=False, exclude_own=True)
            res.select("id", "intent", "confidence", "action", "reason", "reply",
                       F.size("evidence").alias("n_evidence")).write.mode("overwrite").parquet(
                os.path.join(out, f"batch={batch_id}"))  # a replayed batch replaces its rows
        finally:
            bdf.unpersist()

    return spark.read.parquet(_run(msgs, "triage_stream", foreach=per_batch, root=root)).drop("batch")
