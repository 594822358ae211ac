"""End-to-end triage as one DataFrame pipeline:

clean -> classify (nearest prototype, or a fitted ML model) -> retrieve
(exact top-k over the history index, threshold after top-k) -> decide
(escalation policy) -> grounded template reply.

Every stage is a join/aggregate over ids; messages are never looped over on
the driver.  The same functions serve a batch table or a micro-batch of a
stream (``foreachBatch``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.functions.encoders import with_keyword_vector
from supportlake.operators import classify, policy, replies, vectors
from supportlake.session import cut_lineage
from supportlake.taxonomy import prototype_texts


def prototype_index(spark: SparkSession) -> DataFrame:
    """Anchors of the zero-shot classifier: three exemplars + description per
    intent (40 rows), embedded with the keyword encoder."""
    rows = prototype_texts()
    df = spark.createDataFrame(rows, "proto_ord long, intent string, text string")
    return with_keyword_vector(df, "text")


def classify_by_prototypes(msgs: DataFrame, protos: DataFrame, id_col: str = "id",
                           vec_col: str = "embedding") -> DataFrame:
    """(id, intent, confidence): nearest anchor, first anchor wins ties."""
    best = vectors.distinct_topk(msgs, protos, 1, query_id=id_col, query_vec=vec_col, doc_id="proto_ord")
    names = F.broadcast(protos.select(F.col("proto_ord").alias("doc_id"), "intent"))
    return best.join(names, "doc_id").select(
        F.col("query_id").alias(id_col), "intent",
        classify.confidence_from_cosine(F.col("similarity")).alias("confidence"))


def history_index(pairs: DataFrame, write: bool = True) -> DataFrame:
    """Index rows: metadata and vector in one row (no position lookup).

    The index is read several times (size check, broadcast, evidence
    metadata), so by default it is written once as a table in the shared
    checkpoint folder, like a persisted vector index."""
    rows = pairs.select(
        F.col("brand_tweet_id").alias("doc_id"), "customer_tweet_id", "brand_tweet_id", "customer_text", "brand_text",
        "links")
    idx = with_keyword_vector(rows, "customer_text")
    return cut_lineage(idx) if write else idx


def retrieve(msgs: DataFrame, index: DataFrame, k: int = fixed.RETRIEVAL_TOP_K,
             threshold: float = fixed.RETRIEVAL_SIMILARITY_THRESHOLD, id_col: str = "id",
             exclude_same_id: bool = False, exclude_ids: DataFrame | None = None, exclude_own: bool = False) -> DataFrame:
    """(id, evidence ARRAY<STRUCT>) for messages with at least one hit.
    ``exclude_own``: ids are those of customer messages, whose own pairs do not
    serve as evidence."""
    if exclude_ids is not None:  # (doc_id): rows that must not serve as evidence
        index = index.join(exclude_ids.select("doc_id"), "doc_id", "left_anti")
    own = {"query_owner": id_col, "doc_owner": "customer_tweet_id"} if exclude_own else {}
    top = vectors.distinct_topk(msgs, index, k, query_id=id_col, doc_id="doc_id", exclude_self=exclude_same_id, **own)
    top = vectors.apply_threshold(top, threshold)
    meta = index.drop("embedding")
    return vectors.evidence(top, meta).withColumnRenamed("query_id", id_col)


def message_text(text_col: str):
    """A message as it is triaged: cleaned, or as it came where cleaning leaves nothing."""
    cleaned = tx.clean_text(F.col(text_col))
    return F.when(cleaned == "", tx.not_null_text(text_col)).otherwise(cleaned)


def triage(messages: DataFrame, index: DataFrame, protos: DataFrame, pol: policy.Policy = policy.CONFIGURED_POLICY,
           k: int = fixed.RETRIEVAL_TOP_K, threshold: float = fixed.RETRIEVAL_SIMILARITY_THRESHOLD,
           id_col: str = "id", text_col: str = "message", exclude_same_id: bool = False, exclude_own: bool = False,
           write_inputs: bool = True, prepared: bool = False) -> DataFrame:
    """id, message, intent, confidence, action, reason, reply, evidence.

    The vectorised messages feed three stages (classification, retrieval, the
    final join); with ``write_inputs`` they are written once to the shared
    checkpoint folder instead of being re-derived per stage.  Micro-batch
    callers pass ``write_inputs=False`` and persist the batch instead.
    ``prepared`` messages (id, message, embedding) are cleaned, encoded and
    written already, like the rows of a history index.
    """
    if prepared:
        msgs = messages.select("id", "message", "embedding")
    else:
        msgs = messages.select(F.col(id_col).alias("id"), message_text(text_col).alias("message"))
        msgs = with_keyword_vector(msgs, "message")
        if write_inputs:
            msgs = cut_lineage(msgs)
    cls = classify_by_prototypes(msgs, protos)
    ev = retrieve(msgs, index, k, threshold, exclude_same_id=exclude_same_id, exclude_own=exclude_own)
    j = msgs.drop("embedding").join(cls, "id", "left").join(ev, "id", "left")
    j = j.withColumn("evidence", F.coalesce(F.col("evidence"), F.array().cast(ev.schema["evidence"].dataType)))
    sims = F.transform("evidence", lambda e: e.getField("similarity"))
    d = policy.escalation_decision(F.col("message"), F.col("intent"), F.col("confidence"), sims, pol)
    out = j.withColumn("_d", d)
    return out.select(
        "id", "message", "intent", "confidence",
        F.col("_d.action").alias("action"), F.col("_d.reason").alias("reason"),
        replies.template_reply(F.col("_d.action"), F.col("evidence")).alias("reply"),
        "evidence",
    )
