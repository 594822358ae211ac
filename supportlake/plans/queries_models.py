"""TF-IDF weights, text classifier heads, linear probe, majority baseline
predictions and the three-system comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.operators import classify, golden, labels, metrics, pairs, tfidf
from supportlake.plans import logistic_sql
from supportlake.plans import oracle as sq
from supportlake.plans import triage
from supportlake.plans.queries import _golden_cte, _labelled_cte, _pairs_cte, corpus, written_corpus
from supportlake.plans.queries_pipeline import _decision_cte, evidence_reply_sql
from supportlake.plans.registry import query
from supportlake.session import cut_lineage
from supportlake.sources.tables import table


def _tfidf_cte(source: str = "conversations", ids: str = "conv_id, turn") -> str:
    stop = sq.str_list(fixed.ENGLISH_STOPWORDS)
    return f"""d AS (
  SELECT {ids}, list_filter(regexp_extract_all(lower(coalesce(text, '')), {sq.lit(tfidf.TOKEN_PATTERN)}),
                                    lambda t: NOT list_contains({stop}, t)) AS toks FROM {source}),
t AS (SELECT {ids}, unnest(list_concat(toks, CASE WHEN len(toks) >= 2 THEN
        list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE []::VARCHAR[] END)) AS term
      FROM d),
tf AS (SELECT {ids}, term, count(*) AS tf FROM t GROUP BY ALL),
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term),
v AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + df)) + 1.0 AS idf
      FROM st ORDER BY total DESC, term LIMIT {fixed.TFIDF_MAX_FEATURES}),
w AS (SELECT tf.*, v.df, v.idf, (1.0 + ln(tf.tf)) * v.idf AS raw FROM tf JOIN v USING (term)),
weights AS (SELECT {ids}, term, tf, df, round(idf, 6) AS idf,
       round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY {ids})), 6) AS weight FROM w)"""


@query("tfidf_weights", lambda: f"WITH {_tfidf_cte()} SELECT * FROM weights")
def q_tfidf_weights(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    w = tfidf.tfidf_weights(c, ["conv_id", "turn"], "text", fixed.ENGLISH_STOPWORDS, fixed.TFIDF_MAX_FEATURES)
    return w.select("conv_id", "turn", "term", "tf", "df", F.round("idf", 6).alias("idf"),
                    F.round("weight", 6).alias("weight"))


@query("tfidf_vectors", lambda: f"WITH {_tfidf_cte()} SELECT conv_id, turn, term, weight FROM weights")
def q_tfidf_vectors(spark, sf_dir):
    """The classifier's feature vectors, one row per entry."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    vocab = tfidf.fit_vocabulary(c, "text", fixed.TFIDF_MAX_FEATURES, fixed.ENGLISH_STOPWORDS)
    raw = vocab.features(c, "text").select("conv_id", "turn", tfidf.vector_fields(F.col("_features")).alias("f"))
    entries = raw.select("conv_id", "turn", F.explode(F.arrays_zip("f.indices", "f.values")).alias("e"))
    names = spark.createDataFrame(list(enumerate(vocab.terms)), "i int, term string")
    return entries.join(F.broadcast(names), entries["e.indices"] == names["i"]).select(
        "conv_id", "turn", "term", F.round("e.values", 6).alias("weight"))


@query("tfidf_documents", lambda: f"""WITH {_tfidf_cte("documents", "doc_id")}
SELECT doc_id, count(*) AS n_terms, round(sum(weight * weight), 6) AS squares, round(max(weight), 6) AS top_weight
FROM weights GROUP BY doc_id""")
def q_tfidf_documents(spark, sf_dir):
    """Weights of whole documents (up to 20,000 words), summed up per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = tfidf.tfidf_weights(d, ["doc_id"], "text", fixed.ENGLISH_STOPWORDS, fixed.TFIDF_MAX_FEATURES)
    w = w.withColumn("weight", F.round("weight", 6))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squares"),
                                   F.round(F.max("weight"), 6).alias("top_weight"))


@query("class_weights", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')},
c AS (SELECT weak_intent, count(*) AS n FROM lab GROUP BY 1)
SELECT weak_intent, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS class_weight FROM c""")
def q_class_weights(spark, sf_dir):
    """Balanced weight of every intent's rows."""
    w = tfidf.balanced_weights(cut_lineage(labels.weak_labels(corpus(spark, sf_dir)).select("weak_intent")), "weak_intent")
    return w.groupBy("weak_intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("class_weight"), 6).alias("class_weight"))


def _train_and_golden(spark, sf_dir, c=None):
    c = written_corpus(spark, sf_dir) if c is None else c
    # both tables feed several ML passes: write them once to the shared
    # checkpoint folder instead of recomputing the lineage per pass
    g = cut_lineage(golden.golden_set(c))
    train = cut_lineage(labels.weak_labels(pairs.without_ids(c, g)))
    return train, g


def _heads(train):
    """Intent and action heads.  The stop words are a parameter: the short list
    that the SQL knows as well."""
    stop = fixed.ENGLISH_STOPWORDS
    return (tfidf.fit_text_classifier(train, "customer_text", "weak_intent", stopwords=stop),
            tfidf.fit_text_classifier(train, "customer_text", "true_action", stopwords=stop))


def _head_cte(name: str, label: str) -> str:
    """The fit of one head on ``tl``: distinct texts, weighted by their rows.  Two
    classes have one weight vector, which two of half its size stand for."""
    reg = "(CASE WHEN (SELECT count(*) FROM {0}_names) = 2 THEN 2.0 ELSE 1.0 END) / (SELECT count(*) FROM tl)".format(name)
    return f"""{name}_names AS (SELECT {label} AS name, row_number() OVER (ORDER BY {label}) - 1 AS c, count(*) AS n FROM tl GROUP BY 1),
{name}_rows AS (SELECT customer_text, c, count(*) / ((SELECT count(*) FROM {name}_names) * any_value(n)) AS w
  FROM tl JOIN {name}_names ON name = {label} GROUP BY customer_text, c),
{name}_train AS (SELECT row_number() OVER (ORDER BY customer_text, c) AS i, c AS y, w, x FROM {name}_rows JOIN vectors USING (customer_text)),
{logistic_sql.fit_cte(name, f"{name}_train", f"SELECT count(*) FROM {name}_names", reg, 900, 4.0, 0.94)},
{logistic_sql.predict_cte(name, "asked")}"""


def _training_cte() -> str:
    """CTEs ``hist`` and ``tl``: the labelled pairs outside ``golden``."""
    return f"""hist AS (SELECT * FROM pairs WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM golden)),
{_labelled_cte('hist', name='tl')}"""


def _heads_cte() -> str:
    """CTE ``tf_long`` (eval_id, pred_intent, confidence, pred_action): the
    TF-IDF heads fitted on ``tl``, on ``golden``."""
    stop = sq.str_list(fixed.ENGLISH_STOPWORDS)
    return f"""texts AS (SELECT customer_text, sum(m)::BIGINT AS m FROM (SELECT customer_text, count(*) AS m FROM tl GROUP BY 1
  UNION ALL SELECT DISTINCT customer_text, 0 FROM golden) GROUP BY 1),
words AS (SELECT customer_text, m, list_filter(regexp_extract_all(lower(customer_text), {sq.lit(tfidf.TOKEN_PATTERN)}),
  lambda t: NOT list_contains({stop}, t)) AS toks FROM texts),
counted AS (SELECT customer_text, m, term, count(*) AS tf FROM (SELECT customer_text, m, unnest(list_concat(toks, CASE WHEN len(toks) >= 2 THEN
  list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE []::VARCHAR[] END)) AS term FROM words) GROUP BY ALL),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM tl)) / (1.0 + sum(m))) + 1.0 AS idf FROM counted WHERE m > 0 GROUP BY term
  ORDER BY sum(tf * m) DESC, term LIMIT {fixed.TFIDF_MAX_FEATURES}),
entry AS (SELECT customer_text, term, (1.0 + ln(tf)) * idf AS raw FROM counted JOIN vocab USING (term)),
unit AS (SELECT customer_text, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY customer_text)) AS u FROM entry),
vectors AS (SELECT customer_text, list(coalesce(u, 0.0)::DOUBLE ORDER BY term) AS x
  FROM (SELECT customer_text, term FROM texts, vocab) LEFT JOIN unit USING (customer_text, term) GROUP BY customer_text),
asked AS (SELECT DISTINCT customer_text AS id, x FROM golden JOIN vectors USING (customer_text)),
{_head_cte("hi", "weak_intent")},
{_head_cte("ha", "true_action")},
tf_long AS (SELECT g.eval_id, n.name AS pred_intent, round(i.p, 4) AS confidence, m.name AS pred_action FROM golden g
  JOIN hi_pred i ON i.id = g.customer_text JOIN hi_names n ON n.c = i.c JOIN ha_pred a ON a.id = g.customer_text JOIN ha_names m ON m.c = a.c)"""


@query("tfidf_logreg", lambda: f"""WITH RECURSIVE {_golden_cte()}, {_training_cte()}, {_heads_cte()}
SELECT eval_id, true_intent, pred_intent, confidence AS intent_confidence, pred_action FROM tf_long JOIN golden USING (eval_id)""")
def q_tfidf_logreg(spark, sf_dir):
    """Intent and action heads trained on weak labels outside the golden set,
    evaluated on the golden set."""
    train, g = _train_and_golden(spark, sf_dir)
    m_int, m_act = _heads(train)
    pi = tfidf.predict_text_classifier(m_int, g.select("eval_id", "customer_text", "true_intent"), "customer_text")
    pa = tfidf.predict_text_classifier(m_act, g.select("eval_id", "customer_text"), "customer_text")
    return pi.select("eval_id", "true_intent", F.col("pred_label").alias("pred_intent"),
                     F.col("pred_confidence").alias("intent_confidence")).join(
        pa.select("eval_id", F.col("pred_label").alias("pred_action")), "eval_id")


PROBE_C = 1.5


def _probe(spark, sf_dir):
    """(model, data with class weights of the training rows, their number)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x))
    data = e.select("vec_id", F.col("label").cast("double").alias("label"),
                    (F.crc32(F.col("vec_id").cast("string")) % 5 == 0).alias("held_out"),
                    F.transform("embedding", lambda x: x / norm).alias("unit"))
    data = data.withColumn("features", array_to_vector("unit"))
    train = tfidf.balanced_weights(data.where("NOT held_out"), "label")
    n = train.count()
    lr = LogisticRegression(weightCol="class_weight", regParam=1.0 / (PROBE_C * max(n, 1)), standardization=False,
                            maxIter=tfidf.MAX_STEPS, tol=tfidf.TOLERANCE, family="multinomial")
    return lr.fit(train), data, train, n


def _probe_cte() -> str:
    return f"""emb AS (SELECT vec_id, label, {logistic_sql.crc32_sql("vec_id::VARCHAR")} % 5 = 0 AS held_out, embedding::DOUBLE[] AS v FROM embeddings),
every AS (SELECT vec_id AS id, label, held_out, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS x FROM emb),
lp_train AS (SELECT row_number() OVER (ORDER BY id) AS i, label AS y, 1.0 / ((SELECT count(DISTINCT label) FROM every WHERE NOT held_out)
  * count(*) OVER (PARTITION BY label)) AS w, x FROM every WHERE NOT held_out),
{logistic_sql.fit_cte("lp", "lp_train", "SELECT count(DISTINCT y) FROM lp_train", f"1.0 / ({PROBE_C} * (SELECT count(*) FROM lp_train))", 500, 4.0, 0.9)},
{logistic_sql.predict_cte("lp", "every")}"""


@query("linear_probe", lambda: f"""WITH RECURSIVE {_probe_cte()}
SELECT id AS vec_id, held_out, label::INTEGER AS true_label, c::INTEGER AS pred_label, round(p, 4) AS confidence FROM lp_pred JOIN every USING (id)""")
def q_linear_probe(spark, sf_dir):
    """Weighted logistic probe (C = 1.5) on unit embeddings, label + probability.
    It learns from the rows whose crc32(vec_id) mod 5 is not 0 and predicts all;
    ``held_out`` marks the others."""
    from pyspark.ml.functions import vector_to_array

    model, data, _, _ = _probe(spark, sf_dir)
    return model.transform(data).select("vec_id", "held_out", F.col("label").cast("int").alias("true_label"),
                                        F.col("prediction").cast("int").alias("pred_label"),
                                        F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"))


@query("probe_certificate", lambda: f"""WITH RECURSIVE {_probe_cte()},
own AS (SELECT t.y, t.w, list_inner_product(f.w[t.y * (f.f + 1) + 1:t.y * (f.f + 1) + f.f], t.x) + f.w[(t.y + 1) * (f.f + 1)] AS z,
  list_sum(list_transform(range(f.k), lambda c: exp(list_inner_product(f.w[c * (f.f + 1) + 1:c * (f.f + 1) + f.f], t.x) + f.w[(c + 1) * (f.f + 1)]))) AS s
  FROM lp_train t, lp_fit f)
SELECT y::INTEGER AS class, round(sum(w * (ln(s) - z)), 5) AS loss_share, true AS at_minimum FROM own GROUP BY y""")
def q_probe_certificate(spark, sf_dir):
    """The probe's loss by class, and whether the gradient at its weights is zero."""
    model, _, train, n = _probe(spark, sf_dir)
    g = tfidf.loss_gradient(train, model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(),
                            1.0 / (PROBE_C * max(n, 1)), "unit")
    return g.select("class", F.round("loss_share", 5).alias("loss_share"),
                    ((F.col("coef_gradient") < 1e-5) & (F.abs("intercept_gradient") < 1e-5)).alias("at_minimum"))


_LONG = ("system", "eval_id", "true_intent", "true_action", "pred_intent", "pred_action", "confidence", "reply")


def _rule_systems(spark, c, train, g):
    """Majority baseline and triage agent on the golden set; the agent's history
    leaves the golden messages out."""
    maj = classify.fit_majority(train, "weak_intent", "true_action", order_col="brand_tweet_id")
    pm = classify.predict_majority(g.select("eval_id", "true_intent", "true_action"), maj).select(
        F.lit("majority_baseline").alias("system"), "eval_id", "true_intent", "true_action", "pred_intent", "pred_action",
        F.col("pred_confidence").alias("confidence"), F.lit(None).cast("string").alias("reply"))
    msgs = g.select(F.col("brand_tweet_id").alias("id"), F.col("customer_text").alias("message"))
    history = triage.history_index(pairs.without_ids(c, g))
    agent = triage.triage(msgs, history, triage.prototype_index(spark)).select("id", "intent", "action", "confidence", "reply")
    pg = g.join(agent, g["brand_tweet_id"] == agent["id"]).select(
        F.lit("support_agent").alias("system"), "eval_id", "true_intent", "true_action",
        F.col("intent").alias("pred_intent"), F.col("action").alias("pred_action"), "confidence", "reply")
    return pm.unionByName(pg)


def _learned_system(train, g):
    m_int, m_act = _heads(train)
    pi = tfidf.predict_text_classifier(m_int, g.select("eval_id", "customer_text", "true_intent", "true_action"), "customer_text")
    pa = tfidf.predict_text_classifier(m_act, g.select("eval_id", "customer_text"), "customer_text").select(
        "eval_id", F.col("pred_label").alias("pred_action"))
    return pi.join(pa, "eval_id").select(
        F.lit("tfidf_logistic_regression").alias("system"), "eval_id", "true_intent", "true_action",
        F.col("pred_label").alias("pred_intent"), "pred_action", F.col("pred_confidence").alias("confidence"),
        F.lit(None).cast("string").alias("reply"))


def _all_systems(spark, sf_dir):
    c = written_corpus(spark, sf_dir)
    train, g = _train_and_golden(spark, sf_dir, c)
    rules = _rule_systems(spark, c, train, g).select(*_LONG)
    return g, cut_lineage(rules.unionByName(_learned_system(train, g).select(*_LONG)))


def _compare(long):
    """Intent summary and escalation metrics per system, one grouped aggregation each."""
    summ = metrics.intent_summary(metrics.pair_counts(long, "true_intent", "pred_intent", ["system"]), ["system"])
    esc = metrics.escalation_metrics(long, "true_action", "pred_action", ["system"]).withColumnRenamed(
        "accuracy", "action_accuracy")
    return summ.join(esc, "system")


def _systems_cte(learned: bool) -> str:
    """CTE ``long``: predictions of the systems on the golden set."""
    heads = f", {_heads_cte()}" if learned else ""
    tf = """
  UNION ALL SELECT 'tfidf_logistic_regression', g.eval_id, g.true_intent, g.true_action, t.pred_intent, t.pred_action, t.confidence, NULL
  FROM golden g JOIN tf_long t USING (eval_id)""" if learned else ""
    return f"""WITH RECURSIVE {_decision_cte(_golden_cte() + """,
hist AS (SELECT * FROM pairs WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM golden))""", "golden", "hist")},
{evidence_reply_sql("hist")},
{_labelled_cte('hist', name='tl')}{heads},
mi AS (SELECT weak_intent AS i FROM tl GROUP BY 1 ORDER BY count(*) DESC, min(brand_tweet_id) LIMIT 1),
ma AS (SELECT true_action AS a FROM tl GROUP BY 1 ORDER BY count(*) DESC, min(brand_tweet_id) LIMIT 1),
long AS (SELECT 'majority_baseline' AS system, eval_id, true_intent, true_action, i AS pred_intent, a AS pred_action, NULL::DOUBLE AS confidence,
    NULL::VARCHAR AS reply FROM golden, mi, ma
  UNION ALL SELECT 'support_agent', g.eval_id, g.true_intent, g.true_action, d.intent, d.action, d.confidence, d.reply
  FROM golden g JOIN answered d ON g.brand_tweet_id = d.id{tf})"""


def _comparison_sql(learned: bool) -> str:
    return f"""{_systems_cte(learned)},
labs AS (SELECT system, true_intent AS label FROM long UNION SELECT system, pred_intent FROM long),
f AS (SELECT l.system, l.label, count(*) FILTER (true_intent = l.label) AS support,
        2.0 * count(*) FILTER (true_intent = l.label AND pred_intent = l.label)
          / (count(*) FILTER (true_intent = l.label) + count(*) FILTER (pred_intent = l.label)) AS f1
      FROM labs l JOIN long ON long.system = l.system GROUP BY 1, 2),
s AS (SELECT system, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM f GROUP BY 1),
c AS (SELECT system, count(*) AS n, avg(CASE WHEN true_intent = pred_intent THEN 1.0 ELSE 0.0 END) AS acc,
        avg(CASE WHEN true_action = pred_action THEN 1.0 ELSE 0.0 END) AS act,
        count(*) FILTER (true_action = 'ESCALATE' AND pred_action = 'ESCALATE') AS tp,
        count(*) FILTER (true_action <> 'ESCALATE' AND pred_action = 'ESCALATE') AS fp,
        count(*) FILTER (true_action <> 'ESCALATE' AND pred_action <> 'ESCALATE') AS tn,
        count(*) FILTER (true_action = 'ESCALATE' AND pred_action <> 'ESCALATE') AS fn FROM long GROUP BY 1)
SELECT system, round(acc, 4) AS accuracy, macro_f1, weighted_f1, n, round(act, 4) AS action_accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS escalate_precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS escalate_recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS escalate_f1,
  round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END, 4) AS false_auto_handle_rate,
  round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0.0 END, 4) AS false_escalation_rate, tp, fp, tn, fn
FROM c JOIN s USING (system)"""


@query("system_comparison", lambda: _comparison_sql(True))
def q_system_comparison(spark, sf_dir):
    """Majority baseline, TF-IDF heads and the triage agent on the golden set."""
    return _compare(_all_systems(spark, sf_dir)[1])


@query("rule_systems", lambda: _comparison_sql(False))
def q_rule_systems(spark, sf_dir):
    """The two systems of the comparison that SQL can express."""
    c = written_corpus(spark, sf_dir)
    return _compare(cut_lineage(_rule_systems(spark, c, *_train_and_golden(spark, sf_dir, c))))


@query("prediction_table", lambda: f"""{_systems_cte(True)}
SELECT golden.*, m.pred_intent AS majority_pred_intent, t.pred_intent AS tfidf_pred_intent, s.pred_intent AS agent_pred_intent,
  s.confidence AS agent_confidence, m.pred_action AS majority_pred_action, t.pred_action AS tfidf_pred_action, s.pred_action AS agent_pred_action,
  s.reply AS agent_reply
FROM golden JOIN long m ON m.eval_id = golden.eval_id AND m.system = 'majority_baseline'
  JOIN long t ON t.eval_id = golden.eval_id AND t.system = 'tfidf_logistic_regression'
  JOIN long s ON s.eval_id = golden.eval_id AND s.system = 'support_agent'""")
def q_prediction_table(spark, sf_dir):
    """Golden columns with every system's prediction beside them."""
    g, long = _all_systems(spark, sf_dir)
    prefix = {"majority_baseline": "majority", "tfidf_logistic_regression": "tfidf", "support_agent": "agent"}

    def of(system: str, col: str):
        return F.max(F.when(F.col("system") == system, F.col(col)))

    wide = long.groupBy("eval_id").agg(
        *[of(s, "pred_intent").alias(f"{p}_pred_intent") for s, p in prefix.items()],
        of("support_agent", "confidence").alias("agent_confidence"),
        *[of(s, "pred_action").alias(f"{p}_pred_action") for s, p in prefix.items()],
        of("support_agent", "reply").alias("agent_reply"))
    return g.join(wide, "eval_id")


@query("benchmark_summary")
def q_benchmark_summary(spark, sf_dir):
    """The comparison as one nested JSON object."""
    return metrics.summary_json(_all_systems(spark, sf_dir)[1], fixed.INTENTS)
