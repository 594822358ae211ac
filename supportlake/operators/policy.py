"""Escalation engine as one ordered CASE chain (short-circuit, codegen'd).

threat keyword (whole word, first in list order) -> lost-parcel phrases (for
the delivery intent, substring) -> sensitive intent -> low confidence ->
weak evidence -> auto-handle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx


UNKNOWN_CONFIDENCE = 0.5  # of a message that has no classification


@dataclass(frozen=True)
class Policy:
    confidence_threshold: float = fixed.CONFIDENCE_THRESHOLD
    min_evidence_similarity: float = fixed.MIN_EVIDENCE_SIMILARITY
    threat_keywords: Sequence[str] = field(default_factory=lambda: list(fixed.DEFAULT_THREAT_KEYWORDS))
    sensitive_intents: Sequence[str] = field(default_factory=lambda: list(fixed.DEFAULT_SENSITIVE_INTENTS))


DEFAULT_POLICY = Policy()
CONFIGURED_POLICY = Policy(
    threat_keywords=list(fixed.CONFIGURED_THREAT_KEYWORDS),
    sensitive_intents=list(fixed.CONFIGURED_SENSITIVE_INTENTS),
)


def max_similarity(sims: Column) -> Column:
    return F.coalesce(F.array_max(sims), F.lit(0.0)).cast("double")


def escalation_decision(message: Column, intent: Column, confidence: Column, sims: Column,
                        policy: Policy = CONFIGURED_POLICY) -> Column:
    """struct(action, reason) for each row."""
    low = F.lower(tx.not_null_text(message))
    kw = tx.first_word_match(low, policy.threat_keywords)
    max_sim = max_similarity(sims)
    # a message without a classification is not safe to answer
    conf = F.coalesce(confidence.cast("double"), F.lit(UNKNOWN_CONFIDENCE))
    esc, auto = F.lit(fixed.ESCALATE), F.lit(fixed.AUTO_HANDLE)
    thr = F.lit(f"{policy.confidence_threshold:.2f}")
    min_sim = F.lit(f"{policy.min_evidence_similarity:.2f}")

    def res(action: Column, reason: Column) -> Column:
        return F.struct(action.alias("action"), reason.alias("reason"))

    return (
        F.when(kw.isNotNull(), res(esc, tx.fill_template(fixed.REASON_THREAT, kw=kw)))
        .when((intent == fixed.DELIVERY_INTENT) & tx.contains_any(low, fixed.DELIVERY_THREAT_PHRASES),
              res(esc, F.lit(fixed.REASON_DELIVERY)))
        .when(intent.isin(list(policy.sensitive_intents)),
              res(esc, tx.fill_template(fixed.REASON_SENSITIVE, intent=intent)))
        .when(conf < policy.confidence_threshold,
              res(esc, tx.fill_template(fixed.REASON_LOW_CONFIDENCE, conf=tx.fmt2(conf), thr=thr)))
        .when(max_sim < policy.min_evidence_similarity,
              res(esc, tx.fill_template(fixed.REASON_WEAK_EVIDENCE, sim=tx.fmt2(max_sim), min_sim=min_sim)))
        .otherwise(res(auto, tx.fill_template(fixed.REASON_AUTO, conf=tx.fmt2(conf), sim=tx.fmt2(max_sim))))
    )
