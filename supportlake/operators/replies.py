"""Grounded template replies, prompt text, and the pluggable generator slot.

The template reply is a CASE chain over the top evidence item; the prompt is
``concat``/``array_join`` over the evidence array.  An external generator
(e.g. a local model) plugs in through ``generate_with`` (``mapInPandas``
over the prompt column); rows it leaves empty or fails on fall back to the template.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake import fixed
from supportlake.functions import text as tx


def top_evidence(evidence: Column) -> tuple[Column, Column]:
    """(resolution or '', first link or null) of the first evidence item.

    ``get`` (not ``[0]``) so an empty array yields null under ANSI mode."""
    first = F.get(evidence, 0)
    return F.coalesce(first.getField("resolution"), F.lit("")), F.get(first.getField("links"), 0)


def template_reply(action: Column, evidence: Column) -> Column:
    res, link = top_evidence(evidence)
    clean_res = tx.py_strip(res)
    grounded = F.when(link.isNotNull() & (F.instr(clean_res, F.coalesce(link, F.lit(""))) == 0),
                      tx.fill_template(fixed.REPLY_GROUNDED_WITH_LINK, resolution=clean_res, link=link)).otherwise(clean_res)
    return (
        F.when(action == fixed.ESCALATE,
               F.when(link.isNotNull(), tx.fill_template(fixed.REPLY_ESCALATE_WITH_LINK, link=link))
               .otherwise(F.lit(fixed.REPLY_ESCALATE)))
        .when(F.length(res) > fixed.REPLY_MIN_RESOLUTION_CHARS, grounded)
        .when(link.isNotNull(), tx.fill_template(fixed.REPLY_LINK_ONLY, link=link))
        .otherwise(F.lit(fixed.REPLY_DEFAULT))
    )


def prompt_text(message: Column, intent: Column, confidence: Column, action: Column, reason: Column,
                evidence: Column) -> Column:
    def item(e: Column, i: Column) -> Column:
        links = e.getField("links")
        body = tx.fill_template(fixed.PROMPT_EVIDENCE_ITEM, n=(i + 1).cast("string"), sim=tx.fmt2(e.getField("similarity")),
                                query=e.getField("query"), resolution=e.getField("resolution"))
        extra = F.when(F.size(links) > 0,
                       tx.fill_template(fixed.PROMPT_EVIDENCE_LINKS, links=F.array_join(links, ", "))).otherwise(F.lit(""))
        return F.concat(body, extra)

    ev_text = F.when(F.size(evidence) > 0, F.array_join(F.transform(evidence, item), "")).otherwise(
        F.lit(fixed.PROMPT_NO_EVIDENCE))
    return tx.fill_template(fixed.PROMPT_TEMPLATE, message=message, intent=intent, conf=tx.fmt2(confidence),
                            action=action, reason=reason, evidence=ev_text)


def _answers(generate: Callable[[list[str]], list[str | None]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) per prompt: all at once, or one by one where the batch fails."""
    try:
        out = list(generate(prompts))
        if len(out) != len(prompts):
            raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
        return [(a, None) for a in out]
    except Exception as e:  # noqa: BLE001  a generator may fail in any way; its row falls back
        if len(prompts) == 1:
            return [(None, type(e).__name__)]
        return [x for p in prompts for x in _answers(generate, [p])]


def generate_with(df: DataFrame, make_generator: Callable[[], Callable[[list[str]], list[str | None]]],
                  prompt_col: str = "prompt", fallback_col: str = "template_reply", out_col: str = "reply") -> DataFrame:
    """Run a batch generator over the prompt column, made once per task.  Adds
    the answer, its source (``generator``, or ``template`` where the fallback
    stands in) and why (the error's name, or ``no answer``).  A batch that fails
    is asked again row by row, so one bad prompt costs no other its answer."""
    source, error = f"{out_col}_source", f"{out_col}_error"
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in (out_col, source, error)]])

    def run(batches):
        gen = make_generator()
        for pdf in batches:
            got = _answers(gen, pdf[prompt_col].fillna("").tolist()) if len(pdf) else []
            rows = []
            for (answer, why), fallback in zip(got, pdf[fallback_col]):
                answer = (answer or "").strip()
                rows.append((answer, "generator", None) if answer else ((fallback or "").strip(), "template", why or "no answer"))
            yield pdf.assign(**{c: pd.Series([r[i] for r in rows], index=pdf.index, dtype="object") for i, c in enumerate((out_col, source, error))})

    return df.mapInPandas(run, schema)


def response_json(intent: Column, confidence: Column, reply: Column, action: Column, reason: Column, evidence: Column) -> Column:
    """The response as one JSON object; missing values stay as null fields."""
    return F.to_json(F.struct(intent.alias("intent"), confidence.alias("confidence"), reply.alias("reply"), action.alias("action"),
                              reason.alias("reason"), evidence.alias("evidence")), {"ignoreNullFields": "false"})
