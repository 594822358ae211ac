"""Files and saved artefacts read back, the generator slot, the audit of
predicted replies, and lookups in the taxonomy."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from supportlake import fixed, taxonomy
from supportlake.functions import text as tx
from supportlake.operators import agreement, golden, judge, labels, metrics, pairs, replies, tfidf
from supportlake.plans import oracle as sq
from supportlake.plans import triage as tr
from supportlake.plans.queries import _golden_cte, _labelled_cte, _pairs_cte, corpus
from supportlake.plans.queries_models import _all_systems, _comparison_sql, _heads_cte, _train_and_golden, _training_cte
from supportlake.plans.queries_pipeline import POL, _agreement_sql, _decision_cte, _decisions, _judged, _rated, _rubric_sql, evidence_reply_sql
from supportlake.plans.queries_pipeline import _judged_cte, _stripped
from supportlake.plans.registry import ORACLES, query
from supportlake.session import ensure_checkpoint_dir
from supportlake.sources import sinks
from supportlake.sources import tables as src


def _folder(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "artefacts", f"{name}-{uuid.uuid4().hex}")


# --------------------------------------------------------------------------
# files written and read back
# --------------------------------------------------------------------------


@query("raw_csv_tweets", lambda: f"""WITH tweets AS {src.tweet_view_sql()}
SELECT tweet_id, author_id, inbound, created_at, text, in_response_to_tweet_id FROM tweets""")
def q_raw_csv_tweets(spark, sf_dir):
    """The tweets as a raw export (parent ids as floats, empty where there is
    none), written as CSV and read by the raw reader; an empty export raises."""
    path = _folder(spark, "raw-tweets")
    t = src.tweets(spark, sf_dir)
    sinks.write_csv(t.select("tweet_id", "author_id", F.initcap(F.col("inbound").cast("string")).alias("inbound"), "created_at", "text",
                             F.lit(None).cast("string").alias("response_tweet_id"),
                             F.concat(F.col("in_response_to_tweet_id").cast("string"), F.lit(".0")).alias("in_response_to_tweet_id")), path)
    return pairs.require_rows(src.read_raw_tweets_csv(spark, path), "raw tweets")


@query("judged_jsonl", lambda: f"""WITH {_judged_cte()}
SELECT brand_tweet_id, true_action, reply, correctness, groundedness, average_score, reasoning FROM judged""")
def q_judged_jsonl(spark, sf_dir):
    """Judged replies through a JSON lines file under a fixed schema."""
    path = _folder(spark, "judged")
    df = _judged(spark, sf_dir)
    scored = df.withColumn("score", judge.rubric(F.col("true_action"), F.col("reply"), F.col("brand_text_raw")))
    sinks.write_jsonl(scored.select("brand_tweet_id", "true_action", "reply", "score"), path)
    back = spark.read.schema("brand_tweet_id long, true_action string, reply string, score struct<correctness: double, groundedness: double, "
                             "average_score: double, reasoning: string>").json(path)
    return back.select("brand_tweet_id", "true_action", "reply", "score.correctness", "score.groundedness", "score.average_score", "score.reasoning")


def _rater_sql() -> str:
    base = _agreement_sql()
    cut = base.rindex("SELECT dimension, n AS sample_size")
    return f"{base[:cut]} SELECT dimension, n AS sample_size, round(mae, 4) AS mean_absolute_error, round(mh, 2) AS human_mean, round(ml, 2) AS llm_mean FROM b"


@query("rater_import", _rater_sql)
def q_rater_import(spark, sf_dir):
    """Human ratings exported as a rater table, imported from the CSV and
    compared with the rubric."""
    path = _folder(spark, "raters")
    rated = _rated(spark, sf_dir).withColumn("id", F.col("doc_id").cast("long"))
    schema = src.HUMAN_VALIDATION_SCHEMA
    given = {"val_id": F.concat(F.lit("val_"), F.col("id").cast("string")), "customer_tweet_id": F.col("id"),
             "customer_text": F.regexp_replace(F.substring("text", 1, 80), "\\s+", " ")}
    given |= {f.name: F.col(f.name) for f in schema if f.name in rated.columns}
    sinks.write_csv(rated.select(*[given.get(f.name, F.lit("note, \"quoted\"").cast(f.dataType)).alias(f.name) for f in schema]), path)
    human = src.read_human_validation_csv(spark, path).drop("customer_text")
    a = agreement.agreement(agreement.unpivot_scores(human.join(rated.select("id", "score"), human["customer_tweet_id"] == F.col("id"))))
    return a.select("dimension", "sample_size", "mean_absolute_error", "human_mean", "llm_mean")


@query("saved_index_evidence", lambda: ORACLES["triage_evidence"])
def q_saved_index_evidence(spark, sf_dir):
    """Evidence found in a history index that was saved and loaded."""
    path = _folder(spark, "index")
    sinks.save_index(tr.history_index(corpus(spark, sf_dir), write=False), path)
    index = sinks.load_index(spark, path)
    msgs = index.select(F.col("doc_id").alias("id"), F.col("customer_text").alias("message"), "embedding")
    found = tr.retrieve(msgs, index, exclude_same_id=True).select("id", F.posexplode("evidence").alias("rank", "e"))
    return found.select("id", (F.col("rank") + 1).cast("long").alias("rank"), "e.similarity", "e.customer_tweet_id", "e.brand_tweet_id",
                        "e.query", "e.resolution", F.array_join("e.links", ";").alias("links"))


@query("saved_model_scores", lambda: f"""WITH RECURSIVE {_golden_cte()}, {_training_cte()}, {_heads_cte()}
SELECT eval_id, pred_intent, confidence AS intent_confidence FROM tf_long""")
def q_saved_model_scores(spark, sf_dir):
    """Predictions of an intent head that was fitted, saved and loaded."""
    train, g = _train_and_golden(spark, sf_dir)
    path = _folder(spark, "head")
    tfidf.fit_text_classifier(train, "customer_text", "weak_intent", stopwords=fixed.ENGLISH_STOPWORDS).save(spark, path)
    model = tfidf.TextClassifier.load(spark, path)
    return tfidf.predict_text_classifier(model, g.select("eval_id", "customer_text"), "customer_text").select(
        "eval_id", F.col("pred_label").alias("pred_intent"), F.col("pred_confidence").alias("intent_confidence"))


@query("summary_file", lambda: f"""WITH s AS ({_comparison_sql(True)})
SELECT system, (SELECT max(n) FROM s) AS dataset_size, {len(fixed.INTENTS)} AS num_intents, accuracy, macro_f1, weighted_f1, escalate_f1, tp, fp, tn, fn FROM s""")
def q_summary_file(spark, sf_dir):
    """The benchmark summary as a nested JSON file, read back under a fixed schema."""
    path = _folder(spark, "summary")
    summary = metrics.summary_json(_all_systems(spark, sf_dir)[1], fixed.INTENTS)
    summary.write.mode("error").text(path)
    intent = "struct<accuracy: double, macro_f1: double, weighted_f1: double>"
    esc = "struct<escalate_f1: double, tp: long, fp: long, tn: long, fn: long>"
    back = spark.read.schema(f"dataset_size long, num_intents int, systems map<string, struct<intent: {intent}, escalation: {esc}>>").json(path)
    rows = back.select("dataset_size", "num_intents", F.explode("systems").alias("system", "s"))
    return rows.select("system", "dataset_size", "num_intents", "s.intent.*", "s.escalation.*")


# --------------------------------------------------------------------------
# generator slot
# --------------------------------------------------------------------------


def local_generator():
    """A generator for tests of the slot: answers with the end of the prompt;
    every seventh length raises, every fifth gives nothing."""

    def answer(prompt: str) -> str | None:
        if len(prompt) % 7 == 0:
            raise ValueError("refused")
        return None if len(prompt) % 5 == 0 else f"{len(prompt)}: {prompt[-60:]}"

    return lambda prompts: [answer(p) for p in prompts]


def _generated_sql() -> str:
    body = ORACLES["prompt_text"]
    cut = body.index("SELECT brand_tweet_id, ", body.index("lk AS"))
    return f"""{body[:cut].rstrip()},
prompts AS ({body[cut:]}),
fallback AS ({ORACLES["reply_template"]})
SELECT brand_tweet_id, CASE WHEN length(prompt) % 7 = 0 OR length(prompt) % 5 = 0 THEN {_stripped('reply')}
    ELSE {_stripped("length(prompt) || ': ' || right(prompt, 60)")} END AS reply,
  CASE WHEN length(prompt) % 7 = 0 OR length(prompt) % 5 = 0 THEN 'template' ELSE 'generator' END AS reply_source,
  CASE WHEN length(prompt) % 7 = 0 THEN 'ValueError' WHEN length(prompt) % 5 = 0 THEN 'no answer' END AS reply_error
FROM prompts JOIN fallback USING (brand_tweet_id)"""


@query("generated_replies", _generated_sql)
def q_generated_replies(spark, sf_dir):
    """Replies of a local generator that fails on some prompts; there the
    template stands in."""
    df = _judged(spark, sf_dir)
    df = df.select("brand_tweet_id", F.col("reply").alias("template_reply"), replies.prompt_text(
        F.col("customer_text"), F.col("weak_intent"), F.col("weak_score") / 10.0, F.col("true_action"), F.col("ground_truth_reason"),
        F.col("evidence")).alias("prompt"))
    return replies.generate_with(df, local_generator).select("brand_tweet_id", "reply", "reply_source", "reply_error")


# --------------------------------------------------------------------------
# audit of a seeded sample of predicted replies, with examples
# --------------------------------------------------------------------------
AUDITED, EXAMPLES = 50, 5


def _audit_sql() -> str:
    dims = [*fixed.JUDGE_DIMENSIONS, "average_score"]
    status = " ".join(f"WHEN dimension = '{d}' THEN CASE WHEN average >= {t} THEN 'PASS' ELSE '{below}' END" for d, t, below in fixed.JUDGE_TARGETS)
    each = " UNION ALL ".join(f"SELECT '{d}' AS dimension, id, {d} AS score, reply FROM j" for d in dims)
    return f"""WITH {_decision_cte()}, {evidence_reply_sql()},
pred AS (SELECT a.id, a.action, a.reply, p.brand_text FROM answered a JOIN pairs p ON p.brand_tweet_id = a.id),
smp AS (SELECT * FROM pred ORDER BY md5('{fixed.SAMPLE_SEED}:' || id), id LIMIT {AUDITED}),
j AS (SELECT id, reply, {_rubric_sql('action', 'reply', 'brand_text')} FROM smp),
u AS ({each}),
m AS (SELECT dimension, avg(score) AS average, count(*) AS n FROM u GROUP BY 1),
x AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY score, id) AS rank FROM u)
SELECT dimension, round(average, 2) AS average, n, CASE {status} END AS status, rank, id, score, reply FROM m JOIN x USING (dimension) WHERE rank <= {EXAMPLES}"""


@query("audit_examples", _audit_sql)
def q_audit_examples(spark, sf_dir):
    """Rubric audit of a seeded sample of predicted actions and replies (the
    reference reply is the evidence), with the worst rows of every dimension."""
    index = tr.history_index(corpus(spark, sf_dir))     # holds the pairs, written once
    refs = index.select(F.col("brand_tweet_id").alias("id"), "brand_text")
    pred = _decisions(spark, sf_dir, index).select("id", "action", "reply").join(refs, "id")
    sample = golden.seeded_sample(pred, AUDITED, "id")
    scored = sample.withColumn("score", judge.rubric(F.col("action"), F.col("reply"), F.col("brand_text")))
    a = judge.audit_with_examples(scored, "id", EXAMPLES, extra=["reply"])
    return a.select("dimension", "average", "n", "status", F.inline("examples")).select(
        "dimension", "average", "n", "status", F.col("rank").cast("long").alias("rank"), "id", "score", "reply")


# --------------------------------------------------------------------------
# bounded training sample, taxonomy lookups, text helpers
# --------------------------------------------------------------------------
TRAINING_ROWS = 1_000          # of the seeded sample; the published run takes 4,000 of far more rows


@query("majority_sample", lambda: f"""WITH {_golden_cte()}, {_training_cte()},
s AS (SELECT * FROM tl ORDER BY md5('{fixed.SAMPLE_SEED}:' || brand_tweet_id), brand_tweet_id LIMIT {TRAINING_ROWS})
SELECT weak_intent, true_action, count(*) AS n FROM s GROUP BY ALL""")
def q_majority_sample(spark, sf_dir):
    """What the baselines are fitted on when the training rows are bounded."""
    train, _ = _train_and_golden(spark, sf_dir)
    return golden.seeded_sample(train, TRAINING_ROWS).groupBy("weak_intent", "true_action").agg(F.count(F.lit(1)).alias("n"))


@query("intent_listing", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')},
t(intent_ord, name, description, keywords, auto_handle_eligible) AS (VALUES {", ".join(
    f"({i}, {sq.lit(r[0])}, {sq.lit(r[1])}, {sq.lit(';'.join(r[2]))}, {str(r[4]).lower()})" for i, r in enumerate(fixed.TAXONOMY))})
SELECT intent_ord, name, t.description, keywords, auto_handle_eligible, count(weak_intent) AS n_messages
FROM t LEFT JOIN lab ON lab.weak_intent = t.name GROUP BY ALL""")
def q_intent_listing(spark, sf_dir):
    """The intents with their keywords and how many messages they have."""
    n = labels.weak_labels(corpus(spark, sf_dir)).groupBy(F.col("weak_intent").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    listing = taxonomy.list_intents(spark).withColumn("keywords", F.array_join("keywords", ";"))
    return listing.join(n, "name", "left").withColumn("n_messages", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


@query("described_decisions", lambda: f"""WITH {_decision_cte()},
t(name, description) AS (VALUES {", ".join(f"({sq.lit(r[0])}, {sq.lit(r[1])})" for r in fixed.TAXONOMY)}),
d AS (SELECT id, CASE WHEN action = 'ESCALATE' AND id % 3 = 0 THEN 'UNKNOWN' ELSE intent END AS intent FROM decision)
SELECT id, intent, coalesce(description, '') AS intent_description FROM d LEFT JOIN t ON t.name = d.intent""")
def q_described_decisions(spark, sf_dir):
    """Decisions with the description of their intent; an unknown one has none."""
    known = F.when((F.col("action") == fixed.ESCALATE) & (F.col("id") % 3 == 0), F.lit("UNKNOWN")).otherwise(F.col("intent"))
    return taxonomy.describe_intent(_decisions(spark, sf_dir).select("id", known.alias("intent")))


#: messages over the conversations that clean to nothing, or hold the replacement character
_ODD_MESSAGE = {0: "'@someone  @other '", 1: "'@a ' || chr(65533) || 's ' || text", 2: "text", 3: "'  ' || text || ' &amp; @b'"}
_ODD_SQL = "CASE (conv_id + turn) % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _ODD_MESSAGE.items()) + " END"


@query("odd_messages", lambda: f"""WITH m AS (SELECT conv_id, turn, {_ODD_SQL} AS raw FROM conversations)
SELECT conv_id, turn, CASE WHEN {sq.clean('raw', False)} = '' THEN coalesce(raw, '') ELSE {sq.clean('raw', False)} END AS message,
  CASE WHEN length(raw) > 40 THEN raw[1:40] || '...' ELSE raw END AS preview FROM m""")
def q_odd_messages(spark, sf_dir):
    """Messages as triage takes them: cleaned, or as they came where cleaning
    leaves nothing; and their shortened form."""
    raw = F.expr(_ODD_SQL.replace("chr(65533)", "decode(unhex('EFBFBD'), 'UTF-8')"))
    m = src.table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return m.select("conv_id", "turn", tr.message_text("raw").alias("message"), tx.truncate_ellipsis("raw", 40).alias("preview"))


@query("links_back", lambda: f"""WITH {_pairs_cte()},
l AS (SELECT brand_tweet_id, {sq.links('brand_text_raw')} AS ls FROM pairs)
SELECT brand_tweet_id, i::INTEGER AS place, ls[i + 1] AS link FROM l, unnest(range(len(ls))) u(i)""")
def q_links_back(spark, sf_dir):
    """Links stored as one string and taken apart again."""
    stored = corpus(spark, sf_dir).select("brand_tweet_id", tx.links_to_string("links").alias("links"))
    return stored.select("brand_tweet_id", F.posexplode(tx.links_from_string("links")).alias("place", "link"))
