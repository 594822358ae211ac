"""Registered queries (one per operator of the inventory) with oracle SQL.

Each query reads the driver's tables (or the tweet view Spark derives from
``events``) in full.  Oracle SQL is an independent DuckDB spelling of the
same definition over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake import fixed
from supportlake.functions import text as tx
from supportlake.functions.encoders import with_keyword_counts
from supportlake.operators import brands, golden, labels, pairs
from supportlake.plans import oracle as sq
from supportlake.plans.registry import query
from supportlake.session import cut_lineage
from supportlake.sources.tables import table, tweet_view_sql, tweets
from supportlake.taxonomy import taxonomy_df

# --------------------------------------------------------------------------
# shared pieces
# --------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.conversation_pairs(tweets(spark, sf_dir))


def written_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' ids and cleaned texts as a table, for queries that read them more than once."""
    return cut_lineage(corpus(spark, sf_dir).select("customer_tweet_id", "brand_tweet_id", "customer_text", "brand_text", "links"))


def golden_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.golden_set(corpus(spark, sf_dir))


def _pairs_cte() -> str:
    return f"""tweets AS {tweet_view_sql()},
replies AS (
  SELECT tweet_id AS brand_tweet_id, author_id AS brand, text AS brand_text_raw, created_at AS created_at_brand,
         in_response_to_tweet_id AS parent_id
  FROM tweets WHERE NOT inbound AND in_response_to_tweet_id IS NOT NULL),
pairs_raw AS (
  SELECT p.tweet_id AS customer_tweet_id, r.brand_tweet_id, p.text AS customer_text_raw,
         {sq.clean('p.text', False)} AS customer_text, r.brand_text_raw,
         {sq.clean('r.brand_text_raw', True)} AS brand_text, {sq.links_str('r.brand_text_raw')} AS links,
         r.brand, p.created_at AS created_at_customer, r.created_at_brand
  FROM replies r JOIN tweets p ON r.parent_id = p.tweet_id
  WHERE {sq.is_english('p.text')} AND {sq.is_english('r.brand_text_raw')}),
pairs AS (SELECT * FROM pairs_raw
  WHERE length(customer_text) >= {fixed.MIN_CLEAN_LENGTH} AND length(brand_text) >= {fixed.MIN_CLEAN_LENGTH})"""


def _labelled_cte(src: str, text: str = "customer_text", name: str = "lab") -> str:
    act, why = sq.gt_action("weak_intent", text)
    return f"""{name}_s AS (SELECT *, {sq.score_list(text)} AS _sc FROM {src}),
{name}_l AS (SELECT * EXCLUDE (_sc), list_max(_sc) AS weak_score,
   CASE WHEN list_max(_sc) >= {fixed.MIN_LABEL_SCORE} THEN {sq.best_intent('_sc')} END AS weak_intent FROM {name}_s),
{name} AS (SELECT *, {act} AS true_action, {why} AS ground_truth_reason FROM {name}_l WHERE weak_intent IS NOT NULL)"""


def _golden_cte() -> str:
    return f"""{_pairs_cte()},
gcand AS (SELECT * FROM pairs WHERE {sq.word_count('customer_text')} >= {fixed.GOLDEN_MIN_WORDS}),
gfirst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_tweet_id ORDER BY brand_tweet_id) AS _r
                          FROM gcand) WHERE _r = 1),
{_labelled_cte('gfirst', name='glab')},
granked AS (SELECT *, row_number() OVER (PARTITION BY weak_intent ORDER BY brand_tweet_id) AS _rn FROM glab),
golden AS (
  SELECT 'eval_' || lower(substr(weak_intent, 1, 3)) || '_' || lpad(CAST(_rn AS VARCHAR), 3, '0') AS eval_id,
         customer_tweet_id, brand_tweet_id, customer_text, brand_text AS reference_reply, links AS reference_links,
         weak_intent AS true_intent, true_action, ground_truth_reason,
         {sq.lit(fixed.GOLDEN_ANNOTATOR)} AS annotator_id, {sq.lit(fixed.GOLDEN_STATUS)} AS annotation_status
  FROM granked WHERE _rn <= {fixed.GOLDEN_PER_INTENT})"""


def _pairs_out(df: DataFrame) -> DataFrame:
    return df.withColumn("links", tx.links_to_string("links"))


# --------------------------------------------------------------------------
# A / B / C: scans, filters, joins
# --------------------------------------------------------------------------


#: rows of the prefix and pairs of the cap, small enough to cut the test tables
PREFIX_ROWS, MOST_PAIRS = 4_000, 500


def _profile_sql(tweets: str) -> str:
    return f"""WITH tweets AS {tweets},
j AS (SELECT r.author_id AS brand, r.text AS text_brand, p.tweet_id AS ptid, p.text AS text_cust
      FROM tweets r LEFT JOIN tweets p ON r.in_response_to_tweet_id = p.tweet_id
      WHERE NOT r.inbound AND r.in_response_to_tweet_id IS NOT NULL),
f AS (SELECT *, ptid IS NOT NULL AS paired,
             (ptid IS NOT NULL AND {sq.is_english('text_brand')} AND {sq.is_english('text_cust')}) AS eng FROM j),
a AS (SELECT brand, count(*) AS sample_replies, count(*) FILTER (WHERE paired) AS paired_conversations,
             count(*) FILTER (WHERE eng) AS english_pairs,
             count(*) FILTER (WHERE eng AND {sq.dm_flag('text_brand')}) AS dm,
             count(*) FILTER (WHERE eng AND {sq.link_flag('text_brand')}) AS lk,
             sum(CASE WHEN eng THEN length(text_cust) END) AS cl, sum(CASE WHEN eng THEN length(text_brand) END) AS bl
      FROM f GROUP BY brand HAVING count(*) FILTER (WHERE paired) > 0)
SELECT brand, sample_replies, paired_conversations, english_pairs,
       round(english_pairs / greatest(paired_conversations, 1) * 100, 1) AS english_pct,
       round(CASE WHEN english_pairs > 0 THEN dm / english_pairs ELSE 0.0 END * 100, 1) AS dm_redirect_pct,
       round(CASE WHEN english_pairs > 0 THEN lk / english_pairs ELSE 0.0 END * 100, 1) AS link_pct,
       round(CASE WHEN english_pairs > 0 THEN cl / english_pairs ELSE 0.0 END, 1) AS avg_cust_length,
       round(CASE WHEN english_pairs > 0 THEN bl / english_pairs ELSE 0.0 END, 1) AS avg_brand_length
FROM a ORDER BY english_pairs DESC, brand"""


@query("brand_profile", lambda: _profile_sql(tweet_view_sql()))
def q_brand_profile(spark, sf_dir):
    return brands.brand_profile(tweets(spark, sf_dir))


@query("prefix_profile", lambda: _profile_sql(f"(SELECT * FROM {tweet_view_sql()} ORDER BY tweet_id LIMIT {PREFIX_ROWS})"))
def q_prefix_profile(spark, sf_dir):
    """Profile of the first tweets by id."""
    return brands.brand_profile(tweets(spark, sf_dir), first_rows=PREFIX_ROWS)


@query("pairs_capped", lambda: f"WITH {_pairs_cte()} SELECT * FROM pairs ORDER BY brand_tweet_id LIMIT {MOST_PAIRS}")
def q_pairs_capped(spark, sf_dir):
    """The first pairs by reply id."""
    return _pairs_out(pairs.conversation_pairs(tweets(spark, sf_dir), max_pairs=MOST_PAIRS))


@query("conversation_pairs", lambda: f"WITH {_pairs_cte()} SELECT * FROM pairs")
def q_conversation_pairs(spark, sf_dir):
    return _pairs_out(corpus(spark, sf_dir))


@query("parent_semi", lambda: f"""WITH tweets AS {tweet_view_sql()}
SELECT t.tweet_id, t.author_id, t.inbound FROM tweets t
WHERE t.tweet_id IN (SELECT in_response_to_tweet_id FROM tweets
                     WHERE NOT inbound AND in_response_to_tweet_id IS NOT NULL)""")
def q_parent_semi(spark, sf_dir):
    return pairs.answered_parents(tweets(spark, sf_dir)).select("tweet_id", "author_id", "inbound")


@query("golden_anti", lambda: f"""WITH {_golden_cte()}
SELECT customer_tweet_id, brand_tweet_id, customer_text FROM pairs
WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM golden)""")
def q_golden_anti(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.without_ids(c, golden.golden_set(c)).select("customer_tweet_id", "brand_tweet_id", "customer_text")


@query("english_turns", lambda: f"""SELECT role, count(*) AS n_turns,
  count(*) FILTER (WHERE {sq.is_english('text')}) AS english_turns,
  CAST(sum({sq.stopword_hits('text')}) AS BIGINT) AS stopword_hits
FROM conversations GROUP BY role""")
def q_english_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(tx.is_english("text")).alias("english_turns"),
        F.sum(tx.stopword_hits("text")).cast("bigint").alias("stopword_hits"),
    )


@query("english_documents", lambda: f"""SELECT lang, {sq.is_english('text')} AS is_english, count(*) AS n_docs,
  round(avg({sq.ascii_ratio('text')}), 6) AS avg_ascii_ratio
FROM documents GROUP BY ALL""")
def q_english_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", tx.is_english("text").alias("is_english")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(tx.ascii_ratio("text")), 6).alias("avg_ascii_ratio"))


@query("clean_text", lambda: f"""WITH tweets AS {tweet_view_sql()}
SELECT tweet_id, CASE WHEN inbound THEN {sq.clean('text', False)} ELSE {sq.clean('text', True)} END AS clean_text,
       {sq.links_str('text')} AS links, {sq.dm_flag('text')} AS dm, {sq.word_count('text')} AS n_words
FROM tweets""")
def q_clean_text(spark, sf_dir):
    t = tweets(spark, sf_dir)
    return t.select("tweet_id", tx.clean_text("text", ~F.col("inbound")).alias("clean_text"),
                    tx.links_to_string(tx.extract_links("text")).alias("links"),
                    tx.dm_flag("text").alias("dm"), tx.word_count("text").alias("n_words"))


@query("page_text", lambda: f"""SELECT page_id, length({sq.clean('html', False)}) AS clean_len,
  len({sq.links('html')}) AS n_links, {sq.link_flag('html')} AS has_link
FROM pages""")
def q_page_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.length(tx.clean_text("html")).alias("clean_len"),
                    F.size(tx.extract_links("html")).alias("n_links"), tx.link_flag("html").alias("has_link"))


# --------------------------------------------------------------------------
# D / E / H / I: labels, policy, histograms, golden sets
# --------------------------------------------------------------------------


@query("keyword_scores", lambda: f"""WITH tweets AS {tweet_view_sql()},
s AS (SELECT tweet_id, {sq.score_list('text')} AS sc FROM tweets WHERE inbound),
u AS (SELECT tweet_id, unnest(range(1, 11)) AS pos, unnest(sc) AS score FROM s)
SELECT tweet_id, {sq.str_list(fixed.INTENTS)}[pos] AS intent, score FROM u WHERE score > 0""")
def q_keyword_scores(spark, sf_dir):
    t = tweets(spark, sf_dir).where("inbound")
    kc = with_keyword_counts(t.select("tweet_id", "text"), "text")
    s = kc.select("tweet_id", F.posexplode(labels.score_array_from_counts(F.col("_kc"))).alias("pos", "score"))
    names = F.array(*[F.lit(i) for i in fixed.INTENTS])
    return s.where(F.col("score") > 0).select("tweet_id", F.element_at(names, (F.col("pos") + 1).cast("int")).alias("intent"), "score")


@query("weak_labels", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')}
SELECT customer_tweet_id, brand_tweet_id, weak_intent, weak_score, true_action, ground_truth_reason FROM lab""")
def q_weak_labels(spark, sf_dir):
    return labels.weak_labels(corpus(spark, sf_dir)).select(
        "customer_tweet_id", "brand_tweet_id", "weak_intent", "weak_score", "true_action", "ground_truth_reason")


@query("gt_action", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')}
SELECT weak_intent, true_action, ground_truth_reason, count(*) AS n FROM lab GROUP BY ALL""")
def q_gt_action(spark, sf_dir):
    return labels.weak_labels(corpus(spark, sf_dir)).groupBy("weak_intent", "true_action", "ground_truth_reason").agg(
        F.count(F.lit(1)).alias("n"))


@query("class_histogram", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')},
c AS (SELECT weak_intent AS intent, count(*) AS n FROM lab GROUP BY 1)
SELECT intent, n, round(n / sum(n) OVER (), 6) AS share FROM c""")
def q_class_histogram(spark, sf_dir):
    from supportlake.operators.classify import class_histogram
    return class_histogram(labels.weak_labels(corpus(spark, sf_dir)), "weak_intent")


@query("majority", lambda: f"""WITH {_golden_cte()},
pool AS (SELECT * FROM pairs WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM golden)),
{_labelled_cte('pool', name='tl')},
ic AS (SELECT weak_intent, count(*) AS n, min(brand_tweet_id) AS first_seen FROM tl GROUP BY 1),
ac AS (SELECT true_action, count(*) AS n, min(brand_tweet_id) AS first_seen FROM tl GROUP BY 1),
mi AS (SELECT weak_intent AS majority_intent, n / (SELECT sum(n) FROM ic) AS intent_share FROM ic
       ORDER BY n DESC, first_seen LIMIT 1),
ma AS (SELECT true_action AS majority_action FROM ac ORDER BY n DESC, first_seen LIMIT 1)
SELECT majority_intent, round(intent_share, 6) AS intent_share, majority_action FROM mi, ma""")
def q_majority(spark, sf_dir):
    from supportlake.operators.classify import fit_majority
    c = corpus(spark, sf_dir)
    train = labels.weak_labels(pairs.without_ids(c, golden.golden_set(c)))
    m = fit_majority(train, "weak_intent", "true_action", order_col="brand_tweet_id")
    return m.select("majority_intent", F.round("intent_share", 6).alias("intent_share"), "majority_action")


@query("golden_quota", lambda: f"WITH {_golden_cte()} SELECT * FROM golden")
def q_golden_quota(spark, sf_dir):
    return golden_of(spark, sf_dir)


@query("golden_check", lambda: f"""WITH {_golden_cte()},
spine AS (SELECT unnest({sq.str_list(fixed.INTENTS)}) AS intent),
c AS (SELECT true_intent AS intent, count(*) AS n FROM golden GROUP BY 1)
SELECT s.intent, coalesce(c.n, 0) AS n, coalesce(c.n, 0) = {fixed.GOLDEN_PER_INTENT} AS ok
FROM spine s LEFT JOIN c ON s.intent = c.intent""")
def q_golden_check(spark, sf_dir):
    return golden.golden_check(golden_of(spark, sf_dir), taxonomy_df(spark))


@query("annotation_sample", lambda: f"""WITH {_golden_cte()},
pool AS (SELECT * FROM pairs WHERE customer_tweet_id NOT IN (SELECT customer_tweet_id FROM golden)),
s AS (SELECT *, md5('{fixed.SAMPLE_SEED}:' || CAST(brand_tweet_id AS VARCHAR)) AS k FROM pool
      ORDER BY k, brand_tweet_id LIMIT {fixed.ANNOTATION_SAMPLE_SIZE})
SELECT 'human_task_' || lpad(CAST(row_number() OVER (ORDER BY k, brand_tweet_id) AS VARCHAR), 3, '0') AS task_id,
       customer_tweet_id, customer_text, brand_text AS historical_brand_reply,
       {sq.lit(fixed.PENDING)} AS assigned_intent, {sq.lit(fixed.PENDING)} AS assigned_action,
       {sq.lit(fixed.PENDING)} AS escalation_reason, {sq.lit(fixed.PENDING_ANNOTATOR)} AS annotator_id,
       {sq.lit(fixed.PENDING)} AS annotation_status
FROM s""")
def q_annotation_sample(spark, sf_dir):
    c = written_corpus(spark, sf_dir)
    return golden.annotation_template(c, golden.golden_set(c))


@query("corpus_stats", lambda: f"""WITH {_pairs_cte()}, {_labelled_cte('pairs')}
SELECT (SELECT count(*) FROM pairs) AS n_pairs,
       (SELECT count(DISTINCT customer_tweet_id) FROM pairs) AS n_customer_messages,
       (SELECT count(*) FROM lab) AS n_labelled,
       (SELECT count(DISTINCT weak_intent) FROM lab) AS n_intents""")
def q_corpus_stats(spark, sf_dir):
    """Index/corpus statistics as one summary row (rows, messages, intents)."""
    c = corpus(spark, sf_dir)
    lab = labels.weak_labels(c)
    a = c.agg(F.count(F.lit(1)).alias("n_pairs"),
              F.count_distinct("customer_tweet_id").alias("n_customer_messages")).withColumn("_one", F.lit(1))
    b = lab.agg(F.count(F.lit(1)).alias("n_labelled"),
                F.count_distinct("weak_intent").alias("n_intents")).withColumn("_one", F.lit(1))
    return a.join(b, "_one").drop("_one")
