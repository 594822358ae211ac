"""Keyword weak labeller and the ground-truth action policy.

Scores are static Column sums (no join against the taxonomy): for each
intent, 2.0 x whole-word keyword occurrences in the lower-cased text.  The
best intent is the first one in taxonomy order holding the maximum score, so
no window/shuffle is needed either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.functions.encoders import with_keyword_counts
from supportlake.taxonomy import keyword_vocabulary, keywords_by_intent


def intent_scores_from_counts(counts: Column) -> dict[str, Column]:
    """2.0 x summed keyword counts per intent, from a vocabulary count array."""
    vocab = {kw: i + 1 for i, kw in enumerate(keyword_vocabulary())}
    out = {}
    for intent, kws in keywords_by_intent().items():
        total = None
        for kw in kws:
            c = F.element_at(counts, vocab[kw])
            total = c if total is None else total + c
        out[intent] = (total * F.lit(fixed.KEYWORD_WEIGHT)).cast("double")
    return out


def score_array_from_counts(counts: Column) -> Column:
    """ARRAY<DOUBLE> of the ten intent scores in taxonomy order."""
    return F.array(*intent_scores_from_counts(counts).values())


def best_intent(scores: Column) -> tuple[Column, Column]:
    """(intent or null, best score) from a score array; ``array_position``
    returns the first maximum, so the first intent in taxonomy order wins."""
    best = F.array_max(scores)
    names = F.array(*[F.lit(i) for i in fixed.INTENTS])
    return F.when(best > 0, F.element_at(names, F.array_position(scores, best).cast("int"))), best


def with_weak_label(df: DataFrame, text_col: str = "customer_text") -> DataFrame:
    """Adds ``weak_intent`` (null unless score >= 2.0) and ``weak_score``."""
    kc = with_keyword_counts(df, text_col)
    scored = tx.materialize(kc, _scores=score_array_from_counts(F.col("_kc"))).drop("_kc")
    intent, best = best_intent(F.col("_scores"))
    labelled = tx.materialize(scored, weak_score=best, weak_intent=F.when(best >= fixed.MIN_LABEL_SCORE, intent))
    return labelled.drop("_scores")


def ground_truth_action(intent: Column, text: Column) -> Column:
    """struct(action, reason) by the ordered policy; substring tests throughout."""
    low = F.lower(tx.not_null_text(text))
    esc, auto = F.lit(fixed.ESCALATE), F.lit(fixed.AUTO_HANDLE)

    def res(action: Column, reason: str) -> Column:
        return F.struct(action.alias("action"), F.lit(reason).alias("reason"))

    chain = F.when(tx.contains_any(low, fixed.GT_THREAT_WORDS), res(esc, fixed.GT_THREAT_REASON))
    for name, reason in fixed.GT_ALWAYS_ESCALATE:
        chain = chain.when(intent == name, res(esc, reason))
    for name, words, esc_reason, auto_reason in fixed.GT_INTENT_EXCEPTIONS:
        chain = chain.when((intent == name) & tx.contains_any(low, words), res(esc, esc_reason))
        chain = chain.when(intent == name, res(auto, auto_reason))
    return chain.otherwise(res(auto, fixed.GT_DEFAULT_REASON))


def weak_labels(df: DataFrame, text_col: str = "customer_text") -> DataFrame:
    """Confident weak labels with their ground-truth action and reason."""
    labelled = with_weak_label(df, text_col).where(F.col("weak_intent").isNotNull())
    gt = ground_truth_action(F.col("weak_intent"), F.col(text_col))
    return labelled.withColumn("gt", gt).select(
        "*", F.col("gt.action").alias("true_action"), F.col("gt.reason").alias("ground_truth_reason")
    ).drop("gt")
