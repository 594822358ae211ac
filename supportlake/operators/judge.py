"""Rule-based five-dimension rubric (the offline judge) and its audit.

All rules are Column expressions; the reasons are joined with ``concat_ws``
(which skips the rules that did not fire).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx

SCORE_FIELDS = fixed.JUDGE_DIMENSIONS + ["average_score"]

def rubric(action: Column, reply: Column, evidence_text: Column) -> Column:
    """struct(correctness, groundedness, helpfulness, brand_consistency, safety,
    average_score, reasoning)."""
    reply = tx.not_null_text(reply)
    ev = tx.not_null_text(evidence_text)
    low = F.lower(reply)
    pii = low.rlike(tx.py_regex(fixed.JUDGE_PII_PATTERN))
    urls = tx.extract_links(reply)
    has_url = F.size(urls) > 0
    verified = F.exists(urls, lambda u: F.instr(ev, u) > 0)
    esc = action == fixed.ESCALATE
    auto = action == fixed.AUTO_HANDLE
    esc_words = tx.contains_any(low, fixed.JUDGE_ESCALATION_WORDS)
    too_long = F.length(reply) > fixed.JUDGE_MAX_REPLY_CHARS

    safety = F.when(pii, 1.0).otherwise(5.0)
    grounded = F.when(has_url & verified, 5.0).when(has_url, 3.5).when(auto, 4.0).otherwise(4.5)
    helpful = F.when(esc & esc_words, 4.5).when(~has_url & auto, 4.0).otherwise(4.5)
    brand = F.when(esc & esc_words, 5.0).when(esc, 3.5).when(too_long, 4.0).otherwise(4.8)
    correct = F.when(esc & ~esc_words, 3.5).otherwise(4.5)
    reasons = F.concat_ws(" | ",
                          F.when(pii, F.lit(fixed.JUDGE_REASON_PII)),
                          F.when(has_url & verified, F.lit(fixed.JUDGE_REASON_LINK_OK))
                          .when(has_url, F.lit(fixed.JUDGE_REASON_LINK_BAD))
                          .when(auto, F.lit(fixed.JUDGE_REASON_NO_LINK)),
                          F.when(esc & esc_words, F.lit(fixed.JUDGE_REASON_ESC_OK))
                          .when(esc, F.lit(fixed.JUDGE_REASON_ESC_BAD))
                          .when(too_long, F.lit(fixed.JUDGE_REASON_TOO_LONG)))
    reasoning = F.when(reasons == "", F.lit(fixed.JUDGE_REASON_DEFAULT)).otherwise(reasons)
    c, g, h, b, s = (x.cast("double") for x in (correct, grounded, helpful, brand, safety))
    return F.struct(
        c.alias("correctness"), g.alias("groundedness"), h.alias("helpfulness"), b.alias("brand_consistency"),
        s.alias("safety"), F.round((c + g + h + b + s) / 5.0, 2).alias("average_score"), reasoning.alias("reasoning"))


def _answer(raw: Column) -> tuple[Column, dict[str, Column]]:
    """The answer's fields as text (null if it is no JSON object) and its scores
    as numbers (null if missing or no number)."""
    fields = F.from_json(raw, "map<string, string>")
    return fields, {d: F.get(F.array(fields[d]), F.lit(0)).try_cast("double") for d in fixed.JUDGE_DIMENSIONS}


def reject_reason(raw: Column) -> Column:
    """Why a judge's answer does not count; null if it does."""
    fields, scores = _answer(raw)

    def those(bad) -> Column:
        return F.concat_ws(", ", *[F.when(bad(c), F.lit(d)) for d, c in scores.items()])

    absent = those(lambda c: c.isNull())
    outside = those(lambda c: ~c.between(1.0, 5.0))
    return (F.when(fields.isNull(), F.lit("not a JSON object"))
            .when(absent != "", F.concat(F.lit("not a number: "), absent))
            .when(outside != "", F.concat(F.lit("out of range: "), outside)))


def parse_judge_json(raw: Column) -> Column:
    """Typed scores from a judge's JSON answer; null when unparseable or out
    of the 1..5 range (``reject_reason`` says why; ``scored_answers`` falls back
    to the rubric)."""
    fields, scores = _answer(raw)
    cols = list(scores.values())
    return F.when(reject_reason(raw).isNull(), F.struct(
        *[c.alias(d) for d, c in scores.items()],
        F.round(sum(cols[1:], cols[0]) / 5.0, 2).alias("average_score"),
        F.coalesce(fields["reasoning"], F.lit(fixed.JUDGE_REASONING_DEFAULT)).alias("reasoning")))


def scored_answers(df: DataFrame, raw_col: str, fallback: Column) -> DataFrame:
    """``df`` with ``score``, ``score_source`` (``judge``, or ``rubric`` where the
    answer was rejected and ``fallback`` stands in) and ``reject_reason``."""
    raw = F.col(raw_col)
    return df.withColumn("reject_reason", reject_reason(raw)).withColumn(
        "score", F.coalesce(parse_judge_json(raw), fallback)).withColumn(
        "score_source", F.when(F.col("reject_reason").isNull(), F.lit("judge")).otherwise(F.lit("rubric")))


def rejected_answers(scored: DataFrame) -> DataFrame:
    """Side table: the rows of ``scored_answers`` whose answer was rejected, with
    the answer as it came."""
    return scored.where(F.col("reject_reason").isNotNull()).drop("score", "score_source")


def audit_summary(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """Long table: dimension, average (2 decimals as reported), target, status."""
    avgs = scored.agg(*[F.avg(F.col(score_col).getField(d)).alias(d) for d in SCORE_FIELDS],
                      F.count(F.lit(1)).alias("n"))
    stack = ", ".join(f"'{d}', {d}" for d in SCORE_FIELDS)
    long = avgs.selectExpr("n", f"stack({len(SCORE_FIELDS)}, {stack}) AS (dimension, average)")
    status = None
    for dim, target, below in fixed.JUDGE_TARGETS:
        cond = F.col("dimension") == dim
        verdict = F.when(F.col("average") >= target, F.lit("PASS")).otherwise(F.lit(below))
        status = F.when(cond, verdict) if status is None else status.when(cond, verdict)
    target_col = None
    for dim, target, _ in fixed.JUDGE_TARGETS:
        cond = F.col("dimension") == dim
        target_col = F.when(cond, F.lit(target)) if target_col is None else target_col.when(cond, F.lit(target))
    return long.select("dimension", tx.title_label("dimension").alias("label"),
                       F.round("average", 2).alias("average"), target_col.alias("target"),
                       status.alias("status"), "n")


def audit_with_examples(scored: DataFrame, id_col: str, examples: int = 5, score_col: str = "score", extra: Sequence[str] = ()) -> DataFrame:
    """``audit_summary`` with ``examples``: the rows with the lowest scores of each
    dimension (ties by id) as ARRAY<STRUCT<rank, id, score, extra...>>.  Only so
    many rows per task and dimension are kept on the way."""
    each = scored.select(id_col, *extra, F.inline(F.array(*[F.struct(
        F.lit(d).alias("dimension"), F.col(score_col).getField(d).alias("_value")) for d in SCORE_FIELDS])))
    w = Window.partitionBy("dimension").orderBy("_value", id_col)
    worst = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples)
    item = F.struct("rank", F.col(id_col), F.col("_value").alias("score"), *extra)
    return audit_summary(scored, score_col).join(
        worst.groupBy("dimension").agg(F.array_sort(F.collect_list(item)).alias("examples")), "dimension")
