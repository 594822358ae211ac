"""Decision, reply, judge, agreement and triage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.operators import agreement, judge, labels, metrics, policy, ranks, replies
from supportlake.plans import oracle as sq
from supportlake.plans import triage as tr
from supportlake.plans.queries import _labelled_cte, _pairs_cte, corpus
from supportlake.plans.registry import query
from supportlake.sources.tables import table
from supportlake.taxonomy import prototype_texts

POL = policy.CONFIGURED_POLICY

# --------------------------------------------------------------------------
# escalation decision over every pair (leave-one-out retrieval)
# --------------------------------------------------------------------------


def _norm_sql(v0: str) -> str:
    n = f"sqrt(list_sum(list_transform({v0}, lambda y: y * y)))"
    return f"CASE WHEN {n} > 0 THEN list_transform({v0}, lambda x: x / {n}) ELSE list_transform({v0}, lambda x: 0.0) END"


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, {sq.lit('^' + tx.PY_WHITESPACE + '+|' + tx.PY_WHITESPACE + '+$')}, '', 'g')"


def _template_sql(action: str, res: str, strip: str, link: str) -> str:
    grounded = (f"CASE WHEN {link} IS NOT NULL AND NOT contains({strip}, {link}) THEN "
                f"{sq.template(fixed.REPLY_GROUNDED_WITH_LINK, resolution=strip, link=link)} ELSE {strip} END")
    return f"""CASE WHEN {action} = 'ESCALATE' THEN
        (CASE WHEN {link} IS NOT NULL THEN {sq.template(fixed.REPLY_ESCALATE_WITH_LINK, link=link)}
              ELSE {sq.lit(fixed.REPLY_ESCALATE)} END)
      WHEN length({res}) > {fixed.REPLY_MIN_RESOLUTION_CHARS} THEN ({grounded})
      WHEN {link} IS NOT NULL THEN {sq.template(fixed.REPLY_LINK_ONLY, link=link)}
      ELSE {sq.lit(fixed.REPLY_DEFAULT)} END"""


def _decision_cte(base: str | None = None, messages: str = "pairs", history: str = "pairs", other: str = "q.id <> d.id") -> str:
    """Decisions on the rows of ``messages`` with evidence from the rows of
    ``history`` that are ``other`` than the message's own."""
    protos = ", ".join(f"({o}, {sq.lit(i)}, {sq.lit(t)})" for o, i, t in prototype_texts())
    action, reason = sq.escalation("message", "intent", "confidence", "max_sim", POL.threat_keywords,
                                   POL.sensitive_intents, POL.confidence_threshold, POL.min_evidence_similarity)
    k, thr = fixed.RETRIEVAL_TOP_K, fixed.RETRIEVAL_SIMILARITY_THRESHOLD
    return f"""{base or _pairs_cte()},
mv0 AS (SELECT brand_tweet_id AS id, customer_text AS message, {sq.keyword_vector('customer_text')} AS v0 FROM {messages}),
mv AS (SELECT id, message, {_norm_sql('v0')} AS v FROM mv0),
hv0 AS (SELECT brand_tweet_id AS id, customer_tweet_id, {sq.keyword_vector('customer_text')} AS v0 FROM {history}),
hv AS (SELECT id, customer_tweet_id, {_norm_sql('v0')} AS v FROM hv0),
p0 AS (SELECT * FROM (VALUES {protos}) t(proto_ord, intent, txt)),
pv AS (SELECT proto_ord, intent, {_norm_sql(sq.keyword_vector('txt'))} AS v FROM p0),
cls0 AS (SELECT m.id, p.intent, list_inner_product(m.v, p.v) AS sim,
           row_number() OVER (PARTITION BY m.id ORDER BY round(list_inner_product(m.v, p.v), 9) DESC, p.proto_ord) AS rk
         FROM mv m JOIN pv p ON true),
cls AS (SELECT id, intent, round(greatest(0.0, least(1.0, (sim + 1) / 2)), 4) AS confidence FROM cls0 WHERE rk = 1),
ret0 AS (SELECT q.id, d.id AS doc_id, list_inner_product(q.v, d.v) AS sim FROM mv q JOIN hv d ON {other}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, doc_id) AS rk FROM ret0)
         WHERE rk <= {k} AND sim >= {thr}),
ret AS (SELECT id, max(round(sim, 4)) AS max_sim, count(*) AS n_evidence FROM hits GROUP BY id),
dec0 AS (SELECT m.id, m.message, c.intent, c.confidence, coalesce(r.max_sim, 0.0) AS max_sim,
                coalesce(r.n_evidence, 0) AS n_evidence
         FROM mv m JOIN cls c USING (id) LEFT JOIN ret r USING (id)),
decision AS (SELECT *, {action} AS action, {reason} AS reason FROM dec0)"""


def evidence_reply_sql(history: str = "pairs") -> str:
    """CTE ``answered``: every decision with the reply built from its first evidence."""
    return f"""ev AS (SELECT h.id, h.rk, h.sim, d.* EXCLUDE (links), {sq.links('d.brand_text_raw')} AS lks FROM hits h JOIN {history} d ON d.brand_tweet_id = h.doc_id),
top AS (SELECT id AS tid, brand_text AS res, lks[1] AS link, {_stripped('brand_text')} AS clean FROM ev
        WHERE rk = (SELECT min(e.rk) FROM ev e WHERE e.id = ev.id)),
answered AS (SELECT decision.*, {_template_sql('action', "coalesce(res, '')", "coalesce(clean, '')", 'link')} AS reply
             FROM decision LEFT JOIN top ON top.tid = decision.id)"""


def _decisions(spark, sf_dir, index=None):
    """Leave-one-out triage of every pair: the index is written once, and the
    messages are its rows."""
    index = tr.history_index(corpus(spark, sf_dir)) if index is None else index
    msgs = index.select(F.col("doc_id").alias("id"), F.col("customer_text").alias("message"), "embedding")
    return tr.triage(msgs, index, tr.prototype_index(spark), POL, exclude_same_id=True, prepared=True)


@query("escalation_decision", lambda: f"""WITH {_decision_cte()}
SELECT id, intent, confidence, max_sim, CAST(n_evidence AS BIGINT) AS n_evidence, action, reason FROM decision""")
def q_escalation_decision(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    sims = F.transform("evidence", lambda e: e.getField("similarity"))
    return d.select("id", "intent", "confidence", policy.max_similarity(sims).alias("max_sim"),
                    F.size("evidence").cast("long").alias("n_evidence"), "action", "reason")


@query("triage")
def q_triage(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query("triage_replies", lambda: f"""WITH {_decision_cte()}, {evidence_reply_sql()}
SELECT id, message, intent, confidence, action, reason, reply, CAST(n_evidence AS BIGINT) AS n_evidence FROM answered""")
def q_triage_replies(spark, sf_dir):
    """The replies that triage builds from the evidence it found."""
    return _decisions(spark, sf_dir).withColumn("n_evidence", F.size("evidence").cast("long")).drop("evidence")


@query("triage_evidence", lambda: f"""WITH {_decision_cte()}, {evidence_reply_sql()}
SELECT id, CAST(rk AS BIGINT) AS rank, round(sim, 4) AS similarity, customer_tweet_id, brand_tweet_id, customer_text AS query,
  brand_text AS resolution, array_to_string(lks, ';') AS links FROM ev""")
def q_triage_evidence(spark, sf_dir):
    """The evidence itself: every retrieved case with its place."""
    found = _decisions(spark, sf_dir).select("id", F.posexplode("evidence").alias("rank", "e"))
    return found.select("id", (F.col("rank") + 1).cast("long").alias("rank"), "e.similarity", "e.customer_tweet_id", "e.brand_tweet_id",
                        "e.query", "e.resolution", F.array_join("e.links", ";").alias("links"))


@query("escalation_metrics", lambda: f"""WITH {_decision_cte()}, {_labelled_cte('pairs')},
j AS (SELECT lab.true_action, decision.action AS pred_action FROM lab JOIN decision ON lab.brand_tweet_id = decision.id),
c AS (SELECT count(*) FILTER (WHERE true_action = 'ESCALATE' AND pred_action = 'ESCALATE') AS tp,
             count(*) FILTER (WHERE true_action <> 'ESCALATE' AND pred_action = 'ESCALATE') AS fp,
             count(*) FILTER (WHERE true_action <> 'ESCALATE' AND pred_action <> 'ESCALATE') AS tn,
             count(*) FILTER (WHERE true_action = 'ESCALATE' AND pred_action <> 'ESCALATE') AS fn,
             count(*) FILTER (WHERE true_action = pred_action) AS agree, count(*) AS n FROM j)
SELECT round(CASE WHEN n > 0 THEN agree / n ELSE 0.0 END, 4) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS escalate_precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS escalate_recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS escalate_f1,
       round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END, 4) AS false_auto_handle_rate,
       round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0.0 END, 4) AS false_escalation_rate,
       tp, fp, tn, fn FROM c""")
def q_escalation_metrics(spark, sf_dir):
    index = tr.history_index(corpus(spark, sf_dir))     # holds the pairs, written once
    truth = labels.weak_labels(index.select("brand_tweet_id", "customer_text")).select(F.col("brand_tweet_id").alias("id"), "true_action")
    pred = _decisions(spark, sf_dir, index).select("id", F.col("action").alias("pred_action"))
    return metrics.escalation_metrics(truth.join(pred, "id"), "true_action", "pred_action")


# --------------------------------------------------------------------------
# grounded reply, prompt, rubric judge (evidence = the pair's own reply)
# --------------------------------------------------------------------------


def _judged(spark, sf_dir):
    lab = labels.weak_labels(corpus(spark, sf_dir))
    ev = F.array(F.struct(
        F.col("customer_text").alias("query"), F.col("brand_text").alias("resolution"),
        F.lit(1.0).alias("similarity"), F.col("links").alias("links"),
        F.col("customer_tweet_id").alias("customer_tweet_id"), F.col("brand_tweet_id").alias("brand_tweet_id")))
    df = lab.withColumn("evidence", ev)
    df = df.withColumn("reply", replies.template_reply(F.col("true_action"), F.col("evidence")))
    return df


def _reply_sql() -> str:
    return _template_sql("true_action", "brand_text", _stripped("brand_text"), f"({sq.links('brand_text_raw')})[1]")


def _rubric_sql(action: str, reply: str, ev: str) -> str:
    low = f"lower({reply})"
    urls = sq.links(reply)
    has_url = f"(len({urls}) > 0)"
    verified = f"(len(list_filter({urls}, lambda u: contains({ev}, u))) > 0)"
    esc = f"({action} = 'ESCALATE')"
    auto = f"({action} = 'AUTO_HANDLE')"
    words = sq.contains_any(low, fixed.JUDGE_ESCALATION_WORDS)
    too_long = f"(length({reply}) > {fixed.JUDGE_MAX_REPLY_CHARS})"
    pii = f"regexp_matches({low}, {sq.lit(fixed.JUDGE_PII_PATTERN)})"
    c = f"CAST(CASE WHEN {esc} AND NOT {words} THEN 3.5 ELSE 4.5 END AS DOUBLE)"
    g = f"CAST(CASE WHEN {has_url} AND {verified} THEN 5.0 WHEN {has_url} THEN 3.5 WHEN {auto} THEN 4.0 ELSE 4.5 END AS DOUBLE)"
    h = f"CAST(CASE WHEN {esc} AND {words} THEN 4.5 WHEN NOT {has_url} AND {auto} THEN 4.0 ELSE 4.5 END AS DOUBLE)"
    b = f"CAST(CASE WHEN {esc} AND {words} THEN 5.0 WHEN {esc} THEN 3.5 WHEN {too_long} THEN 4.0 ELSE 4.8 END AS DOUBLE)"
    s = f"CAST(CASE WHEN {pii} THEN 1.0 ELSE 5.0 END AS DOUBLE)"
    reasons = (f"concat_ws(' | ', CASE WHEN {pii} THEN {sq.lit(fixed.JUDGE_REASON_PII)} END, "
               f"CASE WHEN {has_url} AND {verified} THEN {sq.lit(fixed.JUDGE_REASON_LINK_OK)} "
               f"WHEN {has_url} THEN {sq.lit(fixed.JUDGE_REASON_LINK_BAD)} "
               f"WHEN {auto} THEN {sq.lit(fixed.JUDGE_REASON_NO_LINK)} END, "
               f"CASE WHEN {esc} AND {words} THEN {sq.lit(fixed.JUDGE_REASON_ESC_OK)} "
               f"WHEN {esc} THEN {sq.lit(fixed.JUDGE_REASON_ESC_BAD)} "
               f"WHEN {too_long} THEN {sq.lit(fixed.JUDGE_REASON_TOO_LONG)} END)")
    return (f"{c} AS correctness, {g} AS groundedness, {h} AS helpfulness, {b} AS brand_consistency, {s} AS safety, "
            f"round(({c} + {g} + {h} + {b} + {s}) / 5.0, 2) AS average_score, "
            f"CASE WHEN {reasons} = '' THEN {sq.lit(fixed.JUDGE_REASON_DEFAULT)} ELSE {reasons} END AS reasoning")


def _judged_cte() -> str:
    return f"""{_pairs_cte()}, {_labelled_cte('pairs')},
rep AS (SELECT *, {_reply_sql()} AS reply FROM lab),
judged AS (SELECT brand_tweet_id, true_action, reply, {_rubric_sql('true_action', 'reply', 'brand_text_raw')} FROM rep)"""


@query("reply_template", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')}
SELECT brand_tweet_id, true_action, {_reply_sql()} AS reply FROM lab""")
def q_reply_template(spark, sf_dir):
    return _judged(spark, sf_dir).select("brand_tweet_id", "true_action", "reply")


@query("response_json", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')},
rep AS (SELECT *, {_reply_sql()} AS reply FROM lab)
SELECT brand_tweet_id, CAST(to_json({{'intent': weak_intent, 'confidence': CAST(weak_score / 10.0 AS DOUBLE), 'reply': reply,
  'action': true_action, 'reason': ground_truth_reason,
  'evidence': [{{'query': customer_text, 'resolution': brand_text, 'similarity': CAST(1.0 AS DOUBLE),
                'links': {sq.links('brand_text_raw')}, 'customer_tweet_id': customer_tweet_id,
                'brand_tweet_id': brand_tweet_id}}]}}) AS VARCHAR) AS response FROM rep""")
def q_response_json(spark, sf_dir):
    df = _judged(spark, sf_dir)
    return df.select("brand_tweet_id", replies.response_json(
        F.col("weak_intent"), (F.col("weak_score") / 10.0).cast("double"), F.col("reply"), F.col("true_action"),
        F.col("ground_truth_reason"), F.col("evidence")).alias("response"))


@query("prompt_text", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')},
lk AS (SELECT *, {sq.links('brand_text_raw')} AS lks FROM lab)
SELECT brand_tweet_id, {sq.template(fixed.PROMPT_TEMPLATE, message='customer_text', intent='weak_intent',
    conf=sq.fmt2('weak_score / 10.0'), action='true_action', reason='ground_truth_reason',
    evidence=sq.template(fixed.PROMPT_EVIDENCE_ITEM, n="'1'", sim=sq.fmt2('1.0'), query='customer_text',
                         resolution='brand_text')
             + " || CASE WHEN len(lks) > 0 THEN " + sq.template(fixed.PROMPT_EVIDENCE_LINKS,
                                                               links="array_to_string(lks, ', ')") + " ELSE '' END")}
  AS prompt FROM lk""")
def q_prompt_text(spark, sf_dir):
    df = _judged(spark, sf_dir)
    return df.select("brand_tweet_id", replies.prompt_text(
        F.col("customer_text"), F.col("weak_intent"), F.col("weak_score") / 10.0, F.col("true_action"),
        F.col("ground_truth_reason"), F.col("evidence")).alias("prompt"))


def _scored(spark, sf_dir):
    df = _judged(spark, sf_dir)
    return df.withColumn("score", judge.rubric(F.col("true_action"), F.col("reply"), F.col("brand_text_raw")))


@query("judge_rubric", lambda: f"""WITH {_judged_cte()}
SELECT brand_tweet_id, true_action, correctness, groundedness, helpfulness, brand_consistency, safety,
       average_score, reasoning FROM judged""")
def q_judge_rubric(spark, sf_dir):
    return _scored(spark, sf_dir).select("brand_tweet_id", "true_action", "score.*")


def _status_sql() -> str:
    dims = judge.SCORE_FIELDS
    unions = " UNION ALL ".join(f"SELECT {sq.lit(d)} AS dimension, avg({d}) AS average, count(*) AS n FROM judged"
                                for d in dims)
    tgt = " ".join(f"WHEN dimension = {sq.lit(d)} THEN {t}" for d, t, _ in fixed.JUDGE_TARGETS)
    st = " ".join(f"WHEN dimension = {sq.lit(d)} THEN (CASE WHEN average >= {t} THEN 'PASS' ELSE {sq.lit(b)} END)"
                  for d, t, b in fixed.JUDGE_TARGETS)
    return f"""WITH {_judged_cte()}, u AS ({unions})
SELECT dimension, concat_ws(' ', list_transform(string_split(replace(dimension, '_', ' '), ' '),
         lambda w: upper(w[1]) || lower(w[2:]))) AS label,
       round(average, 2) AS average, CAST(CASE {tgt} END AS DOUBLE) AS target, CASE {st} END AS status, n FROM u"""


@query("judge_status", _status_sql)
def q_judge_status(spark, sf_dir):
    return judge.audit_summary(_scored(spark, sf_dir))


# --------------------------------------------------------------------------
# a judge's JSON answers: accepted, or rejected with a reason
# --------------------------------------------------------------------------
# Test answers over ``documents``: by id, a text that is no JSON, a missing
# score, a word for a score, a score out of range, or a good answer.
ANSWER_SQL = """CASE doc_id % 7 WHEN 0 THEN coalesce(text, '')
  WHEN 1 THEN '{"correctness": 4, "groundedness": 3.5, "helpfulness": 4, "brand_consistency": 5}'
  WHEN 2 THEN '{"correctness": "good", "groundedness": 4, "helpfulness": 4, "brand_consistency": 4, "safety": 5}'
  ELSE '{"correctness": ' || CAST(1 + doc_id % 5 AS STRING) || ', "groundedness": "4.5", "helpfulness": ' ||
       CAST(doc_id % 6 AS STRING) || '.5, "brand_consistency": 3.25, "safety": 5, "reasoning": "r' ||
       CAST(doc_id AS STRING) || '"}' END"""


def _answers_sql() -> str:
    dims = fixed.JUDGE_DIMENSIONS
    obj = "CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END"
    nums = ", ".join(f"CASE WHEN is_obj THEN TRY_CAST(json_extract_string(raw, '$.{d}') AS DOUBLE) END AS j_{d}" for d in dims)
    absent = "concat_ws(', ', " + ", ".join(f"CASE WHEN j_{d} IS NULL THEN '{d}' END" for d in dims) + ")"
    outside = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT (j_{d} BETWEEN 1 AND 5) THEN '{d}' END" for d in dims) + ")"
    total = " + ".join(f"j_{d}" for d in dims)
    return f"""WITH a0 AS (SELECT doc_id, text, {ANSWER_SQL} AS raw FROM documents),
a1 AS (SELECT *, {obj} AS is_obj FROM a0), a2 AS (SELECT *, {nums} FROM a1),
a3 AS (SELECT *, CASE WHEN NOT is_obj THEN 'not a JSON object' WHEN {absent} <> '' THEN 'not a number: ' || {absent}
                 WHEN {outside} <> '' THEN 'out of range: ' || {outside} END AS reject_reason FROM a2),
a4 AS (SELECT *, {_rubric_sql("'AUTO_HANDLE'", sq.nn('text'), "''")} FROM a3),
answers AS (SELECT doc_id, raw, reject_reason, CASE WHEN reject_reason IS NULL THEN 'judge' ELSE 'rubric' END AS score_source,
  CASE WHEN reject_reason IS NULL THEN round(({total}) / 5.0, 2) ELSE average_score END AS average_score,
  CASE WHEN reject_reason IS NULL THEN coalesce(json_extract_string(raw, '$.reasoning'), {sq.lit(fixed.JUDGE_REASONING_DEFAULT)})
       ELSE reasoning END AS reasoning FROM a4)"""


def _answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(ANSWER_SQL).alias("raw"))
    return judge.scored_answers(d, "raw", judge.rubric(F.lit(fixed.AUTO_HANDLE), F.col("text"), F.lit("")))


@query("judge_answers", lambda: f"{_answers_sql()} SELECT doc_id, score_source, average_score, reasoning FROM answers")
def q_judge_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", "score_source", "score.average_score", "score.reasoning")


@query("judge_rejects", lambda: f"{_answers_sql()} SELECT doc_id, raw, reject_reason FROM answers WHERE reject_reason IS NOT NULL")
def q_judge_rejects(spark, sf_dir):
    return judge.rejected_answers(_answers(spark, sf_dir)).select("doc_id", "raw", "reject_reason")


# --------------------------------------------------------------------------
# agreement: label-derived "human" scores vs the rubric on documents
# --------------------------------------------------------------------------
# Test pairing over the driver tables: a document is read as a reply; the
# rubric judges it (long documents are routed as escalations), and the
# ``labels`` row supplies the second rater by this fixed mapping.
HUMAN_FROM_LABELS = {
    "correctness": "1.0 + 4.0 * quality",
    "groundedness": "3.5 + 1.0 * quality",
    "helpfulness": "4.0 + 0.5 * quality",
    "brand_consistency": "5.0 - 1.5 * toxic",
    "safety": "5.0 - 4.0 * toxic",
}


def _rated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lb = table(spark, sf_dir, "labels")
    j = d.join(lb, "doc_id")
    for dim, expr in HUMAN_FROM_LABELS.items():
        j = j.withColumn(f"human_{dim}", F.expr(expr).cast("double"))
    hs = [F.col(f"human_{d}") for d in fixed.JUDGE_DIMENSIONS]
    j = j.withColumn("human_average_score", F.round(sum(hs[1:], hs[0]) / 5.0, 2))
    action = F.when(F.col("n_chars") > fixed.JUDGE_MAX_REPLY_CHARS, F.lit(fixed.ESCALATE)).otherwise(F.lit(fixed.AUTO_HANDLE))
    return j.withColumn("score", judge.rubric(action, F.col("text"), F.lit("")))


def _agreement_sql() -> str:
    dims = fixed.JUDGE_DIMENSIONS + ["average_score"]
    human = {d: f"CAST({e} AS DOUBLE)" for d, e in HUMAN_FROM_LABELS.items()}
    hsum = " + ".join(f"({human[d]})" for d in fixed.JUDGE_DIMENSIONS)
    human["average_score"] = f"round(({hsum}) / 5.0, 2)"
    action = f"CASE WHEN n_chars > {fixed.JUDGE_MAX_REPLY_CHARS} THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END"
    long_parts = " UNION ALL ".join(f"SELECT {sq.lit(d)} AS dimension, {human[d]} AS h, {d} AS l FROM rated"
                                    for d in dims)

    def tier(x):
        return (f"(CASE WHEN {x} >= {fixed.TIER_EXCELLENT} THEN 'EXCELLENT' WHEN {x} >= {fixed.TIER_ACCEPTABLE} "
                f"THEN 'ACCEPTABLE' ELSE 'DEFICIENT' END)")

    ph = ", ".join(f"avg(CASE WHEN {tier('h')} = '{t}' THEN 1.0 ELSE 0.0 END) AS ph_{i}" for i, t in enumerate(fixed.TIERS))
    pl = ", ".join(f"avg(CASE WHEN {tier('l')} = '{t}' THEN 1.0 ELSE 0.0 END) AS pl_{i}" for i, t in enumerate(fixed.TIERS))
    pe = " + ".join(f"ph_{i} * pl_{i}" for i in range(len(fixed.TIERS)))
    return f"""WITH dl AS (SELECT d.doc_id, d.text, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
rated AS (SELECT *, {_rubric_sql(action, sq.nn('text'), "''")} FROM dl),
long AS ({long_parts}),
rh AS (SELECT dimension, h, sum(c) OVER (PARTITION BY dimension ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - (c - 1) / 2.0 AS r_h FROM (SELECT dimension, h, count(*) AS c FROM long GROUP BY ALL)),
rl AS (SELECT dimension, l, sum(c) OVER (PARTITION BY dimension ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - (c - 1) / 2.0 AS r_l FROM (SELECT dimension, l, count(*) AS c FROM long GROUP BY ALL)),
x AS (SELECT long.*, rh.r_h, rl.r_l FROM long JOIN rh USING (dimension, h) JOIN rl USING (dimension, l)),
a AS (SELECT dimension, count(*) AS n, avg(h) AS mh, avg(l) AS ml, stddev_pop(h) AS sh, stddev_pop(l) AS sl,
             covar_pop(h, l) AS cov, stddev_pop(r_h) AS srh, stddev_pop(r_l) AS srl, covar_pop(r_h, r_l) AS rcov,
             bool_and(abs(h - l) <= {fixed.ALLCLOSE_ATOL} + {fixed.ALLCLOSE_RTOL} * abs(l)) AS allclose,
             avg(abs(h - l)) AS mae, avg(CASE WHEN abs(h - l) >= {fixed.DISAGREEMENT_GAP} THEN 1.0 ELSE 0.0 END) AS disagree,
             avg(CASE WHEN {tier('h')} = {tier('l')} THEN 1.0 ELSE 0.0 END) AS po,
             bool_and({tier('h')} = {tier('l')}) AS same_tiers, {ph}, {pl}
      FROM x GROUP BY dimension),
b AS (SELECT *, (sh > {fixed.MIN_STD} AND sl > {fixed.MIN_STD} AND n >= 3) AS gate, {pe} AS pe FROM a)
SELECT dimension, n AS sample_size,
  CASE WHEN gate THEN printf('%.3f', cov / (sh * sl)) WHEN allclose THEN '1.000*' ELSE 'N/A' END AS pearson_r,
  CASE WHEN gate THEN printf('%.3f', rcov / (srh * srl)) WHEN allclose THEN '1.000*' ELSE 'N/A' END AS spearman_rho,
  CASE WHEN 1 - pe = 0 THEN (CASE WHEN same_tiers THEN '1.000*' ELSE '0.000' END)
       ELSE printf('%.3f', (po - pe) / (1 - pe)) END AS cohens_kappa,
  round(mae, 4) AS mean_absolute_error, round(disagree, 4) AS disagreement_rate,
  round(mh, 2) AS human_mean, round(ml, 2) AS llm_mean
FROM b"""


@query("agreement", _agreement_sql)
def q_agreement(spark, sf_dir):
    a = agreement.agreement(agreement.unpivot_scores(_rated(spark, sf_dir)))
    return a.drop("pearson_p_value", "spearman_p_value")


def _pvalues_sql() -> str:
    """p-values by a recursive query: one step of the continued fraction a turn."""
    base = _agreement_sql()
    cut = base.rindex("SELECT dimension, n AS sample_size")
    constant = "CASE WHEN allclose THEN '1.000*' ELSE 'N/A' END"
    return f"""{base[:cut].replace("WITH ", "WITH RECURSIVE ", 1).rstrip()},
co AS (SELECT dimension, 'pearson' AS which, cov / (sh * sl) AS r, n FROM b WHERE gate
  UNION ALL SELECT dimension, 'spearman', rcov / (srh * srl), n FROM b WHERE gate),
p0 AS (SELECT dimension, which, (n - 2) / 2.0 AS df2, (n - 2) / ((n - 2) + r * r * (n - 2) / (1 - r * r)) AS x FROM co WHERE abs(r) < 1),
p1 AS (SELECT *, x < (df2 + 1) / (df2 + 2.5) AS low,
  exp(lgamma(df2 + 0.5) - lgamma(df2) - lgamma(0.5) + df2 * ln(x) + 0.5 * ln(1 - x)) AS front FROM p0),
p2 AS (SELECT dimension, which, low, front, CASE WHEN low THEN df2 ELSE 0.5 END::DOUBLE AS a, CASE WHEN low THEN 0.5 ELSE df2 END::DOUBLE AS b,
  (CASE WHEN low THEN x ELSE 1 - x END)::DOUBLE AS x FROM p1),
cf(dimension, which, a, b, x, m, c, d, h, done) AS (
  SELECT dimension, which, a, b, x, 0, 1.0::DOUBLE, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)), false FROM p2
  UNION ALL (
    WITH e AS (SELECT *, (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS f,
        -(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS g FROM cf WHERE NOT done AND m < 500),
    o AS (SELECT *, 1 / (1 + f * d) AS d1, 1 + f / c AS c1 FROM e),
    z AS (SELECT *, 1 / (1 + g * d1) AS d2, 1 + g / c1 AS c2 FROM o)
    SELECT dimension, which, a, b, x, m + 1, c2, d2, h * d1 * c1 * d2 * c2, abs(d2 * c2 - 1) < 1e-15 FROM z)),
pv AS (SELECT dimension, which, round(CASE WHEN low THEN front * h / a ELSE 1 - front * h / a END, 6) AS p
  FROM p2 JOIN (SELECT dimension, which, last(h ORDER BY m) AS h FROM cf GROUP BY ALL) USING (dimension, which)),
pw AS (SELECT dimension, max(p) FILTER (which = 'pearson') AS pp, max(p) FILTER (which = 'spearman') AS sp FROM pv GROUP BY dimension)
SELECT dimension, n AS sample_size, CASE WHEN gate THEN printf('%.3f', cov / (sh * sl)) ELSE {constant} END AS pearson_r,
  CASE WHEN gate THEN coalesce(pp, 0.0) WHEN allclose THEN 0.0 ELSE 1.0 END::DOUBLE AS pearson_p_value,
  CASE WHEN gate THEN printf('%.3f', rcov / (srh * srl)) ELSE {constant} END AS spearman_rho,
  CASE WHEN gate THEN coalesce(sp, 0.0) WHEN allclose THEN 0.0 ELSE 1.0 END::DOUBLE AS spearman_p_value
FROM b LEFT JOIN pw USING (dimension)"""


@query("agreement_pvalues", _pvalues_sql)
def q_agreement_pvalues(spark, sf_dir):
    a = agreement.agreement(agreement.unpivot_scores(_rated(spark, sf_dir)))
    return a.select("dimension", "sample_size", "pearson_r", "pearson_p_value", "spearman_rho", "spearman_p_value")


@query("price_ranks", """WITH r AS (SELECT l_returnflag, l_extendedprice AS x, l_discount * l_extendedprice AS y,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount * l_extendedprice)
    + (count(*) OVER (PARTITION BY l_returnflag, l_discount * l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def q_price_ranks(spark, sf_dir):
    """Rank correlation of continuous values: prices and the discounts on them."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_discount") * F.col("l_extendedprice")).alias("saved"))
    return ranks.rank_correlation(rows, ["l_returnflag"], "l_extendedprice", "saved").select(
        "l_returnflag", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))
